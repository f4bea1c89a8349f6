"""File sources and sinks.

Writers never funnel a table through one task (no ``coalesce(1)``): outputs
are directories of part files written by all tasks. Score files carry their
model/run in the path (partition columns), not in a header row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabfold.functions.exprs import as_list
from tabfold.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/io/{name}-{uuid.uuid4().hex[:12]}"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, null_values=("",),
             trim: bool = False) -> DataFrame:
    """Header CSV with a declared schema (no inference pass); text
    equal to any of ``null_values`` (after trimming if ``trim``) becomes NULL."""
    r = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
    if trim:
        r = r.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    df = r.csv(path)
    nulls = list(null_values)
    fix = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            v = F.trim(F.col(f.name)) if trim else F.col(f.name)
            fix[f.name] = F.when(v.isin(nulls), F.lit(None)).otherwise(v)
    return df.withColumns(fix) if fix else df


def write_csv(df: DataFrame, path: str, compression: str | None = None) -> str:
    """CSV directory with a header in every part file (all tasks write)."""
    df.write.mode("overwrite").option("header", True).csv(path, compression=compression)
    return path


def read_scores(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Many score files -> one long table with the source file path."""
    df = spark.read.schema(schema).option("header", True).csv(glob)
    return df.withColumn("file", F.col("_metadata.file_path"))


def tag_family(df: DataFrame, patterns: dict[str, str], col: str = "file", out: str = "family",
               default: str = "other") -> DataFrame:
    """Family by the first substring of the file name that matches."""
    expr = None
    for fam, pat in patterns.items():
        cond = F.col(col).contains(pat)
        expr = F.when(cond, F.lit(fam)) if expr is None else expr.when(cond, F.lit(fam))
    return df.withColumn(out, expr.otherwise(F.lit(default)) if expr is not None else F.lit(default))


def write_submission(df: DataFrame, path: str, key: str, flag: str) -> str:
    """Two columns, the decision cast to int, header CSV part files."""
    return write_csv(df.select(F.col(key), F.col(flag).cast("int").alias(flag)), path)


def write_oof(df: DataFrame, root: str, partition_cols=("model", "run")) -> str:
    """Scores as parquet partitioned by model and run; rewriting one
    (model, run) replaces only that partition (dynamic overwrite)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*as_list(partition_cols)).parquet(root))
    return root


def save_features(df: DataFrame, path: str) -> str:
    """Persist an engineered table for reuse (lineage cut by the write)."""
    df.write.mode("overwrite").parquet(path)
    return path
