"""Apply fitted tables to arriving rows with Structured Streaming.

The reference reads whole files only; nothing here adds an operator. What it
shows is that every ``apply_*`` step is a stream-static join or a column
expression, so the tables fitted on training rows (batch) score new rows as
they land (stream) with exactly the same code. The stream runs with an
``availableNow`` trigger and a checkpoint location, so a restart resumes
where it stopped and never re-emits a file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabfold.operators import encode as E
from tabfold.session import ensure_checkpoint_dir
from tabfold.sources.tables import entity, table


def encode_stream(orders_stream: DataFrame, customers: DataFrame, table_: DataFrame, prior: DataFrame,
                  levels: dict) -> DataFrame:
    """Stream-static joins: attach the customer, the smoothed target encoding
    of its nation and the one-hot columns of its segment."""
    x = orders_stream.join(customers, orders_stream.o_custkey == customers.c_custkey, "inner") \
        .select(F.col("o_orderkey").alias("key"), F.col("c_nationkey").alias("nation"),
                F.col("c_mktsegment").alias("segment"))
    x = E.apply_target_encode(x, table_, prior, "nation", "te_nation")
    return E.apply_onehot(x, levels)


def score_stream_once(spark: SparkSession, sf_dir: str, checkpoint: str, query_name: str = "tabfold_stream") -> DataFrame:
    """Fit on the batch training rows, then process all order files available
    now through the stream; returns the rows this run wrote, as Parquet below
    ``spark.checkpoint.dir``."""
    e = entity(spark, sf_dir)
    tr = e.where(F.col("part") == "train")
    t, prior = E.fit_target_encode(tr, "nation", "y", min_samples_leaf=20, smoothing=5)
    levels = E.fit_onehot(tr, ["segment"])
    orders = table(spark, sf_dir, "orders")
    # a file stream watches a folder: the table folder, filtered to the orders file(s)
    stream = spark.readStream.schema(orders.schema).option("pathGlobFilter", "orders*.parquet") \
        .option("maxFilesPerTrigger", 1).parquet(sf_dir)
    out = encode_stream(stream, table(spark, sf_dir, "customer"), t, prior, levels)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream/{query_name}-{uuid.uuid4().hex}"
    q = (out.writeStream.format("parquet").queryName(query_name).outputMode("append").option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)
