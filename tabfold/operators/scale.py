"""Scalers (K1-K3): one-row fitted tables, applied by broadcast of that row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfold.functions.exprs import as_list, safe_div
from tabfold.functions.ranking import quantiles


def fit_minmax(df: DataFrame, cols) -> DataFrame:
    """K1."""
    cols = as_list(cols)
    return df.agg(*[F.min(F.col(k).cast("double")).alias(f"{k}__a") for k in cols],
                  *[F.max(F.col(k).cast("double")).alias(f"{k}__b") for k in cols])


def fit_standard(df: DataFrame, cols, ddof: int = 0) -> DataFrame:
    """K2: mean and std; ``ddof=0`` population (sklearn), ``ddof=1`` sample (R)."""
    cols = as_list(cols)
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    return df.agg(*[F.avg(F.col(k).cast("double")).alias(f"{k}__a") for k in cols],
                  *[sd(F.col(k).cast("double")).alias(f"{k}__s") for k in cols])


def fit_robust(df: DataFrame, cols, q_lo: float = 0.25, q_hi: float = 0.75) -> DataFrame:
    """K3: median and inter-quartile range (exact percentiles)."""
    cols = as_list(cols)
    q = quantiles(df, cols, [q_lo, 0.5, q_hi])  # exact, scale-safe; one row per column
    wide = q.groupBy().pivot("column", cols).agg(F.first("q1").alias("a"), F.first(F.col("q2") - F.col("q0")).alias("s"))
    return wide.select(*[F.col(f"{k}_a").alias(f"{k}__a") for k in cols], *[F.col(f"{k}_s").alias(f"{k}__s") for k in cols])


def apply_scaler(df: DataFrame, fitted: DataFrame, cols, kind: str) -> DataFrame:
    """(x - a) / s, where s is (max - min) for minmax. A zero scale leaves the
    centred value unscaled (sklearn convention: scale 0 -> 1)."""
    cols = as_list(cols)
    x = df.crossJoin(F.broadcast(fitted))  # one row
    for k in cols:
        a = F.col(f"{k}__a")
        s = (F.col(f"{k}__b") - a) if kind == "minmax" else F.col(f"{k}__s")
        s = F.when((s == 0) | s.isNull(), F.lit(1.0)).otherwise(s)
        x = x.withColumn(k, safe_div(F.col(k).cast("double") - a, s))
    return x.drop(*fitted.columns)
