"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfold.functions.exprs import as_list


def stack_train_test(train: DataFrame, test: DataFrame, marker: str = "is_train") -> DataFrame:
    """Stack by name; columns missing on one side (the label on test) are
    NULL; a marker column records the origin."""
    return train.withColumn(marker, F.lit(1)).unionByName(
        test.withColumn(marker, F.lit(0)), allowMissingColumns=True)


def split_by_marker(df: DataFrame, marker: str = "is_train") -> tuple[DataFrame, DataFrame]:
    """Undo U1."""
    return (df.where(F.col(marker) == 1).drop(marker), df.where(F.col(marker) == 0).drop(marker))


def is_subset(a: DataFrame, b: DataFrame, key) -> DataFrame:
    """One row: are all keys of ``a`` in ``b``? (anti-join count = 0)."""
    key = as_list(key)
    missing = a.select(*key).distinct().join(b.select(*key).distinct(), key, "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("n_missing")).withColumn("is_subset", F.col("n_missing") == 0)


def level_diff(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """U4: levels of ``col`` present in ``a`` but not in ``b``."""
    return a.select(col).where(F.col(col).isNotNull()).distinct() \
        .join(b.select(col).distinct(), col, "left_anti")


def distinct_rows(df: DataFrame, cols=None) -> DataFrame:
    """U5."""
    return df.dropDuplicates(as_list(cols) or None)
