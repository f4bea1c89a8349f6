"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabfold.session import ensure_checkpoint_dir

WORKER_BYTES = 8 << 20  #: bytes of rows that go to a Python worker at a time, a row at least
ROW_GROUP_BYTES = 16 << 20  #: bytes of a row group where rows are long


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to Python workers ``WORKER_BYTES`` at a time: Spark's own bound is a number of rows, with
    which rows of megabytes would come a whole partition at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(WORKER_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored(df: DataFrame, name: str, long_rows: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and
    what was written outlives the executor that wrote it. With ``long_rows``, sizes are
    looked at after each row: Parquet's writer otherwise holds 100 before it does, and
    readers hold a row group."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    out = df.write.option("compression", "zstd")
    if long_rows:
        out = out.options(**{"parquet.block.size": ROW_GROUP_BYTES, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1})
    with small_batches(spark):
        out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the folder of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/llm/" in path:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files that no DataFrame refers to any more.
    Python's references reach the JVM's side in the background, so it takes two turns."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.5)
        spark._jvm.System.gc()


def set_aside(df: DataFrame, reserved: list[str]) -> DataFrame:
    """Rename input columns that clash (in any case) with an operator's own
    columns: ``x`` becomes ``x_in``, or ``x_in_in`` where that is taken too."""
    taken = {c.lower() for c in df.columns} | {c.lower() for c in reserved}
    for c in df.columns:
        if c.lower() in {r.lower() for r in reserved}:
            new = f"{c}_in"
            while new.lower() in taken:
                new += "_in"
            taken.add(new.lower())
            df = df.withColumnRenamed(c, new)
    return df


def with_text(df: DataFrame, text: str) -> tuple[DataFrame, int]:
    """``df`` and the position of its text as a string: the column itself where it
    is one, so that tasks hold each text once."""
    names = df.columns
    if dict(df.dtypes).get(text) == "string":
        return df, names.index(text)
    return df.withColumn("_text", F.col(text).cast("string")), len(names)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list of longs.

    Returns (node, component) for every node of the list, component = smallest
    node reachable. Alternating large-star and small-star steps: each step is a
    pre-aggregated ``min`` per node joined back to the edges, so a node with a
    third of the edges is one row of the aggregate and a splittable key of the
    join. Nothing but the count and a checksum of the edges reaches the driver.
    An empty list gives an empty table; self loops and repeats are allowed.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    nodes_alone = e.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    e = stored(e.where("u <> v").distinct(), "edges")
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
        if not before[0]:
            break
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every remaining edge points from a larger to a smaller node
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = stored(small, "edges")
        dropped(e)
        e = new
    stars = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    centres = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.union(centres).union(nodes_alone).groupBy("node").agg(F.min("component").alias("component"))
