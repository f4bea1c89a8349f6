"""Sharding: a two-pass external shuffle of documents, in DataFrame operations only.

Pass one scatters rows into memory-sized buckets by seeded hashes (Spark's own
exchange writes the buckets to disk). Pass two puts each bucket into a fixed
order, applies a seeded Fisher-Yates shuffle (Spark's ``shuffle`` function) and
writes it as one file of its shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabfold.llm.common import scratch_path, set_aside

#: text bytes that one bucket holds on average; a task keeps a few copies of it
BUCKET_BYTES = 32 << 20
OWN = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "bucket", "pos"]


def rendezvous(key: Column, n: int, seed: int) -> Column:
    """Shard of a key among ``n``: the one with the largest seeded hash. Only the
    key and ``n`` decide, and going to ``n + 1`` moves rows only into the new shard."""
    draws = [F.struct(F.xxhash64(F.lit(seed), key, F.lit(i)).alias("h"), F.lit(i).alias("i")) for i in range(n)]
    return F.array_max(F.array(*draws))["i"]


def shard_documents(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text",
                    bucket_bytes: int = BUCKET_BYTES, seed: int = 20240517, path: str | None = None) -> DataFrame:
    """Write ``docs`` as shuffled shards and return them as read back.

    Law ``key``: the key and the number of shards decide the shard (rendezvous
    hashing), ``grown_shard`` is the shard among ``n_shards + 1``. Within a shard
    a hash of key and whole text picks the bucket, so rows that share a key still
    spread. Each bucket is one partition (``repartitionById``), sorted and then
    shuffled with the seed, so a task that runs again writes the same rows in the
    same order. The files lie at ``path`` as ``shard=K/part-*``, with every input
    column and the columns bucket and pos; ``slot`` counts on over the buckets of
    a shard, from 0 without gaps.

    Defined cases: a null key is a key like any other; a null text has size 1 and
    crc 0, an empty one the same; repeated rows are all kept; an empty table gives
    no rows; input columns named like the result's come back as ``<name>_in``; a
    text longer than ``bucket_bytes`` makes its bucket larger by that text.
    """
    spark = docs.sparkSession
    docs = set_aside(docs, OWN)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    total = docs.agg(F.sum(size)).first()[0] or 0
    per_shard = max(1, math.ceil(total / n_shards / bucket_bytes))
    buckets = n_shards * per_shard
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), size.alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        rendezvous(F.col(key), n_shards, seed).alias("shard"), rendezvous(F.col(key), n_shards + 1, seed).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), F.col(text)), F.lit(per_shard)).cast("int").alias("part"))
    rows = rows.withColumn("bucket", F.col("shard") * per_shard + F.col("part"))
    one = F.struct("row", "size", "text_crc32", "shard", "grown_shard")
    gathered = rows.repartitionById(buckets, F.col("bucket")).groupBy("bucket").agg(F.collect_list(one).alias("rows"))
    order = [f for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    if len(order) == len(docs.columns):
        in_order = F.array_sort("rows")
    else:  # columns without an order: the others decide, rows equal in all of them are alike in the result
        by = lambda r: F.struct(*[r["row"][f.name] for f in order])
        in_order = F.array_sort("rows", lambda x, y: F.when(by(x) < by(y), -1).when(by(x) > by(y), 1).otherwise(0))
    mixed = gathered.select("bucket", F.posexplode(F.shuffle(in_order, seed)).alias("pos", "r"))
    path = path or scratch_path(spark, "shards")
    mixed.select("r.row.*", "r.size", "r.text_crc32", "r.grown_shard", "bucket", "pos", "r.shard").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    fields = [*docs.schema.fields, *T.StructType.fromDDL("size long, text_crc32 long, grown_shard int, bucket int, pos int, shard int").fields]
    out = spark.read.schema(T.StructType(fields)).parquet(path)
    per_bucket = out.groupBy("bucket").agg(F.first("shard").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row for each bucket
    offsets = per_bucket.select("bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    if buckets <= 1 << 20:  # one small row for each bucket
        offsets = F.broadcast(offsets)
    return out.join(offsets, "bucket").withColumn("slot", F.col("before") + F.col("pos")).withColumn("law", F.lit("key")).drop("before")
