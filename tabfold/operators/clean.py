"""Cleaning and imputation (C1-C23). Fitted values are one-row or per-group
tables learned on training rows and applied to any rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabfold.functions.exprs import as_list, c, hash_unit, numeric_columns
from tabfold.functions.ranking import join_null_safe, pin_partitions, quantiles, range_partition
from tabfold.operators.joins import bounded
from tabfold.operators.profile import corr_matrix


# ------------------------------------------------------------- constants

def fill_const(df: DataFrame, values: dict) -> DataFrame:
    """Per-column constant (cast to the column's type)."""
    types = dict(df.dtypes)
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v).cast(types[k])) for k, v in values.items()})


def _apply_one_row(df: DataFrame, fitted: DataFrame, cols: list[str]) -> DataFrame:
    """Fill nulls from a one-row table of fitted values (``<col>`` columns)."""
    f = fitted.select(*[F.col(x).alias(f"_fit_{x}") for x in cols])
    x = df.crossJoin(F.broadcast(f))  # exactly one row
    # coalesce widens the type if needed (an int column filled with 3.5 -> double)
    x = x.withColumns({k: F.coalesce(F.col(k), F.col(f"_fit_{k}")) for k in cols})
    return x.drop(*[f"_fit_{k}" for k in cols])


def fit_mode(df: DataFrame, cols) -> DataFrame:
    """Most frequent non-null value per column (ties -> smallest value),
    as a one-row table. Counts are a partial aggregate; no group is collected."""
    cols = as_list(cols)
    out = None
    for x in cols:
        vc = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        one = vc.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias(x))
        out = one if out is None else out.crossJoin(one)
    return out


def _one_row_quantile(df: DataFrame, cols: list[str], p: float) -> DataFrame:
    """One row, one column per input column: its exact p-quantile."""
    q = quantiles(df, cols, [p])
    return q.groupBy().pivot("column", cols).agg(F.first("q0"))


def fit_median(df: DataFrame, cols, exact: bool = True) -> DataFrame:
    """Median per column (exact linear interpolation via the scale-safe
    ``quantiles``, or the bounded-memory sketch)."""
    cols = as_list(cols)
    if exact:
        return _one_row_quantile(df, cols, 0.5)
    return df.agg(*[F.percentile_approx(F.col(x), 0.5, 10000).alias(x) for x in cols])


def fit_mean(df: DataFrame, cols) -> DataFrame:
    """C4."""
    return df.agg(*[F.avg(x).alias(x) for x in as_list(cols)])


def apply_fill(df: DataFrame, fitted: DataFrame, cols=None) -> DataFrame:
    cols = as_list(cols) or fitted.columns
    return _apply_one_row(df, fitted, cols)


# ------------------------------------------------------------- forward fill

def ffill(df: DataFrame, cols, order, by=None, ranges: int | None = None) -> DataFrame:
    """Replace NULL by the last non-null value in ``order`` (inside ``by``).

    Rows are range-partitioned on (by, order) so a hot group is split over
    several tasks; the last non-null of each earlier range is carried in."""
    cols, order, by = as_list(cols), as_list(order), as_list(by)
    ranged = pin_partitions(range_partition(df, [F.col(b) for b in by] + [c(o) for o in order], ranges))
    okey = F.struct(*[c(o) for o in order])
    per = ranged.groupBy("_rid", *by).agg(*[
        F.max_by(F.col(x), F.when(F.col(x).isNotNull(), okey)).alias(f"_last_{x}") for x in cols])
    w = Window.partitionBy(*by).orderBy("_rid").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select("_rid", *by, *[F.last(f"_last_{x}", ignorenulls=True).over(w).alias(f"_carry_{x}")
                                      for x in cols])  # at most #ranges + #groups rows
    x = join_null_safe(ranged, carry, ["_rid", *by], "left")
    wi = Window.partitionBy("_rid", *by).orderBy(*[c(o) for o in order]) \
        .rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({k: F.coalesce(F.last(F.col(k), ignorenulls=True).over(wi), F.col(f"_carry_{k}"))
                       for k in cols})
    return x.drop("_rid", *[f"_carry_{k}" for k in cols])


# ------------------------------------------------------------- conditional

def fill_when(df: DataFrame, col: str, rules: list[tuple[Column, object]], default=None) -> DataFrame:
    """NULL filled by the first rule whose condition holds."""
    expr = None
    for cond, v in rules:
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    if default is not None:
        expr = expr.otherwise(F.lit(default))
    return df.withColumn(col, F.coalesce(F.col(col), expr))


def fit_group_mode(df: DataFrame, col: str, keys) -> tuple[DataFrame, DataFrame]:
    """Mode of ``col`` inside each key group (ties -> smallest value) and
    the global mode as fallback."""
    keys = as_list(keys)
    vc = df.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("_v")) \
        .agg(F.count(F.lit(1)).alias("_n"))
    grp = vc.groupBy(*keys).agg(F.min_by("_v", F.struct(-F.col("_n"), F.col("_v"))).alias("group_mode"))
    return grp, fit_mode(df, col)


def apply_group_mode(df: DataFrame, grp: DataFrame, glob: DataFrame, col: str, keys) -> DataFrame:
    keys = as_list(keys)
    x = df.join(bounded(grp), keys, "left").crossJoin(F.broadcast(glob.select(F.col(col).alias("_g"))))
    t = dict(df.dtypes)[col]
    return x.withColumn(col, F.coalesce(F.col(col), F.col("group_mode").cast(t), F.col("_g").cast(t))) \
        .drop("group_mode", "_g")


def fill_random_level(df: DataFrame, col: str, levels: list, key: str, seed) -> DataFrame:
    """NULL replaced by a level chosen uniformly, keyed by md5(key, seed)
    so reruns and retried tasks choose the same level."""
    arr = F.array(*[F.lit(v) for v in levels])
    idx = (F.floor(hash_unit(key, seed) * len(levels)) + 1).cast("int")
    return df.withColumn(col, F.coalesce(F.col(col), F.element_at(arr, idx)))


# ------------------------------------------------------------- levels

def null_as_level(df: DataFrame, col: str, prefix: str = "", na: str = "NA", out: str | None = None) -> DataFrame:
    """C11: NULL becomes its own level, ``prefix`` + value."""
    return df.withColumn(out or col, F.concat(F.lit(prefix), F.coalesce(F.col(col).cast("string"), F.lit(na))))


def blank_to(df: DataFrame, col: str, value=None) -> DataFrame:
    """Blank (after trim) -> NULL or a level."""
    return df.withColumn(col, F.when(F.trim(F.col(col)) == "", F.lit(value)).otherwise(F.col(col)))


def fit_cap(df: DataFrame, cols, q: float = 0.99) -> DataFrame:
    """Upper cap at the (exact) q-quantile, one-row table."""
    return _one_row_quantile(df, as_list(cols), q)


def apply_cap(df: DataFrame, caps: DataFrame, cols) -> DataFrame:
    cols = as_list(cols)
    x = df.crossJoin(F.broadcast(caps.select(*[F.col(k).alias(f"_cap_{k}") for k in cols])))
    x = x.withColumns({k: F.least(F.col(k), F.col(f"_cap_{k}")) for k in cols})
    return x.drop(*[f"_cap_{k}" for k in cols])


def clip(df: DataFrame, col: str, lo=None, hi=None) -> DataFrame:
    """C14."""
    v = F.col(col)
    if hi is not None:
        v = F.least(v, F.lit(hi))
    if lo is not None:
        v = F.greatest(v, F.lit(lo))
    return df.withColumn(col, v)


def collapse_tail(df: DataFrame, col: str, k, label=None) -> DataFrame:
    """Values >= k become one level (``label`` or k)."""
    return df.withColumn(col, F.when(F.col(col) >= k, F.lit(label if label is not None else k))
                         .otherwise(F.col(col)))


def keep_levels(df: DataFrame, col: str, keep: list, other) -> DataFrame:
    """Levels outside ``keep`` become ``other`` (NULL stays NULL)."""
    return df.withColumn(col, F.when(F.col(col).isNull(), F.col(col))
                         .when(F.col(col).isin(keep), F.col(col)).otherwise(F.lit(other)))


def recode(df: DataFrame, col: str, mapping: dict, out: str | None = None) -> DataFrame:
    """C17: dictionary recode; unmapped values unchanged."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn(out or col, F.coalesce(m[F.col(col)], F.col(col)))


# ------------------------------------------------------------- column drops

def constant_columns(df: DataFrame, nulls_count: bool = False) -> DataFrame:
    """Columns with fewer than two distinct values (NULL counted as a
    value if ``nulls_count``). One aggregation pass; returns ``(column)``."""
    aggs = []
    for x in df.columns:
        lo, hi = F.min(x), F.max(x)  # enough to tell none, one and more values
        n = F.when(lo.isNull(), 0).when(lo == hi, 1).otherwise(2)
        if nulls_count:
            n = n + F.max(F.col(x).isNull().cast("int"))
        aggs.append(n.alias(x))
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).alias("n"))
                                         for x in df.columns]))).where(F.col("n") < 2).select("column")


def high_null_columns(df: DataFrame, label: str, threshold: float = 0.67) -> DataFrame:
    """Columns whose null share on labelled rows exceeds ``threshold``."""
    lab = df.where(F.col(label).isNotNull())
    one = lab.agg(*[F.avg(F.col(x).isNull().cast("double")).alias(x) for x in df.columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).alias("null_share"))
                                         for x in df.columns]))).where(F.col("null_share") > threshold)


def correlated_columns(df: DataFrame, cols, threshold: float = 0.985) -> list[str]:
    """C20: columns to drop. The columns are walked in order; one that is still
    kept removes every partner whose correlation with it exceeds ``threshold``.
    The walk is over the strong pairs of the correlation table."""
    cols = as_list(cols)
    strong = corr_matrix(df, cols).where((F.col("corr") > threshold) & (F.col("col_a") != F.col("col_b")))
    partners: dict[str, set[str]] = {}
    for r in strong.select("col_a", "col_b").collect():  # at most one row per pair of columns
        partners.setdefault(r["col_a"], set()).add(r["col_b"])
    gone: dict[str, None] = {}
    for kept in cols:
        if kept not in gone:
            gone |= dict.fromkeys(x for x in cols if x in partners.get(kept, ()) and x not in gone)
    return list(gone)


def low_variance(df: DataFrame, cols=None, threshold: float = 0.01) -> DataFrame:
    """Numeric columns with sample std below ``threshold``."""
    cols = as_list(cols) or numeric_columns(df)
    one = df.agg(*[F.stddev_samp(F.col(x).cast("double")).alias(x) for x in cols])
    return one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).alias("std"))
                                         for x in cols]))).where(F.col("std") < threshold)
