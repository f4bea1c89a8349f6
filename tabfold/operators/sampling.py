"""Sampling, splits and folds.

Every random pick is keyed by md5(key || seed): repeatable, independent of
partitioning and of task retries, and checkable in SQL. Exact-size picks use
``hashed_rank`` (md5-prefix sub-buckets + offsets), so even a class holding a
third of all rows is ranked by many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabfold.functions.exprs import as_list, hash_unit, order_hash
from tabfold.functions.ranking import hashed_rank, join_null_safe, prefix_sums
from tabfold.operators.joins import bounded


def _ranked(df: DataFrame, key: str, seed, by=None) -> DataFrame:
    x = df.withColumn("_h", order_hash(key, seed))
    return hashed_rank(x, "_h", by=by, tiebreak=key, out="_rank").drop("_h")


def class_sizes(df: DataFrame, y: str) -> DataFrame:
    return df.groupBy(y).agg(F.count(F.lit(1)).alias("_n_class"))


def undersample(df: DataFrame, y: str, key: str, ratio: float = 1.0, seed=42,
                minority=1) -> DataFrame:
    """All minority rows plus the first round(ratio * n_minority)
    majority rows in md5 order."""
    n_min = df.where(F.col(y) == minority).agg(F.count(F.lit(1)).alias("_nmin"))
    maj = _ranked(df.where(F.col(y) != minority), key, seed, by=y).crossJoin(F.broadcast(n_min))
    maj = maj.where(F.col("_rank") < F.round(F.col("_nmin") * ratio)).drop("_rank", "_nmin")
    return df.where(F.col(y) == minority).unionByName(maj)


def oversample(df: DataFrame, y: str, times: int, minority=1) -> DataFrame:
    """Minority rows repeated ``times`` times (copy id in ``_copy``)."""
    rep = F.when(F.col(y) == minority, F.sequence(F.lit(1), F.lit(times))).otherwise(F.array(F.lit(1)))
    return df.withColumn("_copy", F.explode(rep))


@F.pandas_udf(T.IntegerType())
def _poisson_quantile(u: pd.Series, lam: pd.Series) -> pd.Series:
    """Inverse Poisson CDF, vectorised over an Arrow batch."""
    uu, ll = u.to_numpy(dtype="float64"), lam.to_numpy(dtype="float64")
    k = np.zeros(len(uu), dtype="int64")
    p = np.exp(-ll)
    cdf = p.copy()
    active = uu > cdf
    kmax = int(np.max(ll) + 12 * np.sqrt(np.max(ll) + 1) + 20) if len(ll) else 0
    for i in range(1, kmax + 1):
        if not active.any():
            break
        p = p * ll / i
        cdf = cdf + p
        k = np.where(active, i, k)
        active = active & (uu > cdf)
    return pd.Series(k.astype("int32"))


def bootstrap(df: DataFrame, key: str, frac: float, seed=42) -> DataFrame:
    """Sampling with replacement: each row appears Poisson(frac) times,
    the count drawn from md5(key, seed) (keyed, so retries agree)."""
    k = _poisson_quantile(hash_unit(key, seed), F.lit(float(frac)))
    x = df.withColumn("_k", k)
    return x.where(F.col("_k") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_k")))).drop("_k")


def shuffle(df: DataFrame, key: str, seed=42) -> DataFrame:
    """Rows in md5 order (only where order matters downstream)."""
    return df.orderBy(order_hash(key, seed), key)


def sample_n(df: DataFrame, key: str, n: int, seed=42) -> DataFrame:
    """``n`` rows chosen by md5 order (the limit is the sampling feature)."""
    return df.orderBy(order_hash(key, seed), key).limit(n)


def split(df: DataFrame, key: str, fractions: list[float], seed=42, by=None, names=None) -> DataFrame:
    """Exact-size split into parts by md5 rank (inside each ``by``
    class if given): row with rank r in a group of n goes to part i when
    round(n * cum_i-1) <= r < round(n * cum_i). Adds column ``part``."""
    names = names or [str(i) for i in range(len(fractions))]
    by = as_list(by)
    x = _ranked(df, key, seed, by=by or None)
    n = x.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")) if by else x.agg(F.count(F.lit(1)).alias("_n"))
    x = join_null_safe(x, bounded(n), by) if by else x.crossJoin(F.broadcast(n))
    cum, expr = 0.0, None
    for i, frac in enumerate(fractions):
        cum += frac
        hi = F.round(F.col("_n") * F.lit(cum)) if i < len(fractions) - 1 else F.col("_n")
        cond = F.col("_rank") < hi
        expr = F.when(cond, F.lit(names[i])) if expr is None else expr.when(cond, F.lit(names[i]))
    return x.withColumn("part", expr).drop("_rank", "_n")


def add_fold(df: DataFrame, key: str, k: int, seed=42, by=None, out: str = "fold") -> DataFrame:
    """fold = md5 rank mod k (inside each class for stratified folds,
    so per-class fold sizes differ by at most one)."""
    x = _ranked(df, key, seed, by=by)
    return x.withColumn(out, F.pmod(F.col("_rank"), F.lit(k)).cast("int")).drop("_rank")


def add_fold_modulo(df: DataFrame, order: str, k: int, out: str = "fold") -> DataFrame:
    """Row position in ``order`` (0-based) mod k, contiguous-free."""
    one = df.withColumn("_one", F.lit(1))
    x = prefix_sums(one, order, ["_one"], inclusive=False)
    return x.withColumn(out, F.pmod(F.col("_one_cum"), F.lit(k)).cast("int")).drop("_one", "_one_cum")


def cv_plan(df: DataFrame, key: str, seeds: list, k: int, by=None) -> DataFrame:
    """Repeated CV: (key, seed, fold) for every seed (union of keyed
    fold assignments)."""
    parts = [add_fold(df.select(key, *as_list(by)), key, k, seed=s, by=by).withColumn("seed", F.lit(s))
             for s in seeds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(key, "seed", "fold")


def with_weight(df: DataFrame, y: str, weights: dict | str = "balanced", out: str = "weight") -> DataFrame:
    """Class weights, either a dict or ``balanced`` = n / (k * n_class)."""
    if isinstance(weights, dict):
        m = F.create_map(*[x for kk, v in weights.items() for x in (F.lit(kk), F.lit(float(v)))])
        return df.withColumn(out, F.coalesce(m[F.col(y)], F.lit(1.0)))
    cs = class_sizes(df, y)
    tot = cs.agg(F.sum("_n_class").alias("_tot"), F.count(F.lit(1)).alias("_k"))
    cs = cs.crossJoin(tot).select(y, (F.col("_tot") / (F.col("_k") * F.col("_n_class"))).alias(out))
    return df.join(F.broadcast(cs), y, "left")  # one row per label value (a 0/1 label: two rows)
