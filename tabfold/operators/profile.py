"""Profiling and exploratory aggregates.

Reports over many columns are computed in one aggregation pass and then
unpivoted, never one job per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabfold.functions.exprs import as_list, c, melt_one_row, numeric_columns, safe_div
from tabfold.functions.ranking import join_null_safe, quantiles
from tabfold.operators.joins import bounded


def shape(df: DataFrame) -> DataFrame:
    """One row (n_rows, n_cols)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def describe(df: DataFrame, cols=None, exact: bool = True) -> DataFrame:
    """Count, mean, std (sample), min, quartiles, max per numeric column.
    Quartiles are exact and scale-safe (``ranking.quantiles``); ``exact=False``
    uses the bounded-memory sketch instead."""
    cols = as_list(cols) or numeric_columns(df)
    aggs, metrics = [], {}
    for x in cols:
        v = F.col(x).cast("double")
        aggs += [F.count(v).alias(f"{x}__count"), F.avg(v).alias(f"{x}__mean"),
                 F.stddev_samp(v).alias(f"{x}__std"), F.min(v).alias(f"{x}__min"), F.max(v).alias(f"{x}__max")]
        if not exact:
            aggs.append(F.percentile_approx(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10000).alias(f"{x}__q"))
        metrics[x] = ["count", "mean", "std", "min", "max"]
    one = df.agg(*aggs)
    base = melt_one_row(one, metrics)
    if exact:
        q = quantiles(df, cols, [0.25, 0.5, 0.75]).select(
            "column", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"))
    else:
        q = one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("column"), *[
            F.col(f"{x}__q")[i].alias(n) for i, n in enumerate(["q25", "q50", "q75"])]) for x in cols])))
    return base.join(q, "column", "left")


def describe_strings(df: DataFrame, cols) -> DataFrame:
    """Count, unique, top (most frequent; ties to the smaller value), freq."""
    cols = as_list(cols)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(x).alias("column"), F.col(x).cast("string").alias("value")) for x in cols
    ])).alias("s")).select("s.*").where(F.col("value").isNotNull())
    vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return vc.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value"))).alias("_top"),
    ).select("column", "count", "unique", F.col("_top.value").alias("top"), F.col("_top.n").alias("freq"))


def schema_report(df: DataFrame) -> DataFrame:
    """Dtype and non-null count per column."""
    one = df.agg(*[F.count(F.col(f.name)).alias(f.name) for f in df.schema.fields])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
                 F.col(f.name).alias("non_null")) for f in df.schema.fields])))


def null_report(df: DataFrame, cols=None) -> DataFrame:
    """P5: null count and percent per column, sorted by count desc, name."""
    cols = as_list(cols) or df.columns
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.sum(F.col(x).isNull().cast("long")).alias(x) for x in cols])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(x).alias("column"), F.col(x).alias("nulls"),
                 (F.col(x) * 100.0 / F.col("_n")).alias("pct")) for x in cols]))) \
        .orderBy(F.col("nulls").desc(), "column")


def null_columns(df: DataFrame) -> DataFrame:
    """Columns that have at least one null."""
    return null_report(df).where(F.col("nulls") > 0).select("column")


def blank_report(df: DataFrame, cols) -> DataFrame:
    """Count of blank (empty after trim) strings per column."""
    cols = as_list(cols)
    one = df.agg(*[F.sum((F.trim(F.col(x)) == "").cast("long")).alias(x) for x in cols])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(x).alias("column"), F.coalesce(F.col(x), F.lit(0)).alias("blanks")) for x in cols])))


def is_unique(df: DataFrame, key) -> DataFrame:
    """Distinct keys == rows."""
    keys = as_list(key)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(*[c(k) for k in keys]).alias("n_keys")) \
        .withColumn("unique", F.col("n_rows") == F.col("n_keys"))


def null_patterns(df: DataFrame, cols) -> DataFrame:
    """Frequency of each combination of missing columns."""
    cols = as_list(cols)
    return df.groupBy(*[F.col(x).isNull().cast("int").alias(f"{x}_missing") for x in cols]) \
        .agg(F.count(F.lit(1)).alias("n"))


def nunique(df: DataFrame, cols=None, approx: bool = False) -> DataFrame:
    """P10: distinct non-null values per column (HLL sketch if ``approx``)."""
    cols = as_list(cols) or df.columns
    f = (lambda x: F.approx_count_distinct(x)) if approx else (lambda x: F.count_distinct(x))
    one = df.agg(*[f(F.col(x)).alias(x) for x in cols])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(x).alias("column"), F.col(x).alias("nunique")) for x in cols])))


def uniques(df: DataFrame, col: str) -> DataFrame:
    """Distinct values (rows, not a driver-side list)."""
    return df.select(col).distinct()


def value_counts(df: DataFrame, col, dropna: bool = False) -> DataFrame:
    """Count and share per value; rows with any null kept unless ``dropna``."""
    cols = as_list(col)
    x = df.na.drop("any", subset=cols) if dropna else df
    g = x.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    tot = x.agg(F.count(F.lit(1)).alias("_tot"))
    return g.crossJoin(F.broadcast(tot)).select(*cols, "n", (F.col("n") / F.col("_tot")).alias("share"))


def class_balance(df: DataFrame, y: str) -> DataFrame:
    """Share of each label value."""
    return value_counts(df, y)


def share_of_parent(df: DataFrame, parent, child) -> DataFrame:
    """Count of (parent, child) and its percent of the parent's count.
    The window runs over the aggregated counts, not the rows."""
    parent, child = as_list(parent), as_list(child)
    g = df.groupBy(*parent, *child).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct_of_parent",
                        F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*parent)))


def group_size(df: DataFrame, by) -> DataFrame:
    """P15."""
    return df.groupBy(*as_list(by)).agg(F.count(F.lit(1)).alias("n"))


def group_means(df: DataFrame, by, cols=None) -> DataFrame:
    """Mean of every numeric column per group."""
    by = as_list(by)
    cols = as_list(cols) or numeric_columns(df, exclude=by)
    return df.groupBy(*by).agg(*[F.avg(x).alias(f"mean_{x}") for x in cols])


def event_rate(df: DataFrame, col, y: str) -> DataFrame:
    """Label mean x 100 and count per level."""
    return df.groupBy(*as_list(col)).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(F.col(y).cast("double")) * 100).alias("event_rate"))


def crosstab(df: DataFrame, a: str, b: str, levels_b: list, margins: bool = True,
             normalize: str | None = None) -> DataFrame:
    """Counts of ``a`` x ``b`` with "All" margins (one ``cube`` pass);
    ``normalize="row"`` divides each cell by its row total."""
    g = df.cube(F.col(a).cast("string").alias(a), F.col(b).cast("string").alias(b)) \
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_gid"))
    if not margins:
        g = g.where(F.col("_gid") == 0)
    g = g.select(F.when(F.col("_gid").bitwiseAND(2) > 0, F.lit("All")).otherwise(F.col(a)).alias(a),
                 F.when(F.col("_gid").bitwiseAND(1) > 0, F.lit("All")).otherwise(F.col(b)).alias(b), "n")
    cols = [str(v) for v in levels_b] + (["All"] if margins else [])
    wide = g.groupBy(a).pivot(b, cols).agg(F.first("n"))
    wide = wide.select(a, *[F.coalesce(F.col(x), F.lit(0)).alias(x) for x in cols])
    if normalize == "row":
        tot = F.col("All") if margins else sum((F.col(x) for x in cols), F.lit(0))
        wide = wide.select(a, *[(F.col(x) / tot).alias(x) for x in cols])
    return wide


def pivot_mean(df: DataFrame, index: str, columns: str, values: str, levels: list | None = None) -> DataFrame:
    """Mean of ``values`` for index x column level. Without a fitted level
    list the pivot finds the levels itself (one extra distinct job)."""
    g = df.groupBy(index)
    return (g.pivot(columns, levels) if levels else g.pivot(columns)).agg(F.avg(values))


def count_where(df: DataFrame, cond, by=None) -> DataFrame:
    """Number and share of rows meeting ``cond``."""
    cond = F.expr(cond) if isinstance(cond, str) else cond
    g = df.groupBy(*as_list(by)) if by else df.groupBy()
    return g.agg(F.count_if(cond).alias("n_true"), F.count(F.lit(1)).alias("n"),
                 F.avg(cond.cast("double")).alias("share"))


def corr_matrix(df: DataFrame, cols) -> DataFrame:
    """P25: Pearson correlation of every pair (long form, both orders and the
    diagonal), all pairs in one aggregation pass."""
    cols = as_list(cols)
    aggs, names = [], []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            aggs.append(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}"))
            names.append((a, b))
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"{a}__{b}").alias("corr"))
            for a, b in names]
    rows += [F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), F.col(f"{a}__{b}").alias("corr"))
             for a, b in names]
    rows += [F.struct(F.lit(a).alias("col_a"), F.lit(a).alias("col_b"), F.lit(1.0).alias("corr"))
             for a in cols]
    return one.select(F.inline(F.array(*rows)))


def corr_with(df: DataFrame, cols, y: str) -> DataFrame:
    """Correlation of each column with the label, sorted by value desc."""
    cols = as_list(cols)
    one = df.agg(*[F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias(x) for x in cols])
    return one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).alias("corr"))
                                         for x in cols]))).orderBy(F.col("corr").desc(), "column")


def skewness(df: DataFrame, cols) -> DataFrame:
    """Population skewness and its absolute value."""
    cols = as_list(cols)
    one = df.agg(*[F.skewness(F.col(x).cast("double")).alias(x) for x in cols])
    return one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).alias("skew"),
                                                  F.abs(F.col(x)).alias("abs_skew")) for x in cols])))


def box_summary(df: DataFrame, col: str, by=None, k: float = 1.5) -> DataFrame:
    """Five numbers, IQR fences and outlier count per group. Quartiles
    come from the scale-safe exact ``quantiles``; the fences (one row per
    group) are joined back to count the rows outside them."""
    by = as_list(by)
    v = F.col(col).cast("double")
    mm = df.groupBy(*by).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))
    qs = quantiles(df, [col], [0.25, 0.5, 0.75], by=by).select(
        *by, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    q = join_null_safe(mm, qs, by) if by else mm.crossJoin(qs)
    q = q.withColumn("lo_fence", F.col("q1") - k * (F.col("q3") - F.col("q1"))) \
         .withColumn("hi_fence", F.col("q3") + k * (F.col("q3") - F.col("q1")))
    base = df.select(*by, v.alias("_v"))
    fences = q.select(*by, "lo_fence", "hi_fence")
    joined = join_null_safe(base, bounded(fences), by) if by else base.crossJoin(F.broadcast(fences))
    out = joined.groupBy(*by).agg(
        F.count_if((F.col("_v") < F.col("lo_fence")) | (F.col("_v") > F.col("hi_fence"))).alias("outliers"))
    res = join_null_safe(q, out, by, "left") if by else q.crossJoin(out)
    return res.select(*by, "min", "q1", "median", "q3", "max", "n", "lo_fence", "hi_fence", "outliers")


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int, by=None) -> DataFrame:
    """Fixed-width bins (``width_bucket``) with count and density per group."""
    by = as_list(by)
    b = F.expr(f"width_bucket({col}, {float(lo)}, {float(hi)}, {int(bins)})").alias("bin")
    g = df.where(F.col(col).isNotNull()).groupBy(*by, b).agg(F.count(F.lit(1)).alias("n"))
    tot = g.groupBy(*by).agg(F.sum("n").alias("_t"))
    width = (hi - lo) / bins
    j = join_null_safe(g, bounded(tot), by) if by else g.crossJoin(F.broadcast(tot))
    return j.select(*by, "bin", "n", (F.col("n") / F.col("_t") / F.lit(width)).alias("density"))


def cat_by_class(df: DataFrame, col: str, y: str) -> DataFrame:
    """Counts per (level, class) and the class share inside the level."""
    return share_of_parent(df, col, y).withColumnRenamed("pct_of_parent", "pct_in_level")


def zscore_outliers(df: DataFrame, cols, thr: float = 3.0) -> DataFrame:
    """Rows with |z| > thr in any column (mean/std of the whole table)."""
    cols = as_list(cols)
    st = df.agg(*[F.avg(x).alias(f"_m_{x}") for x in cols], *[F.stddev_samp(x).alias(f"_s_{x}") for x in cols])
    x = df.crossJoin(F.broadcast(st))  # one-row side
    cond = F.lit(False)
    for k in cols:
        cond = cond | (F.abs(safe_div(F.col(k) - F.col(f"_m_{k}"), F.col(f"_s_{k}"))) > thr)
    return x.where(cond).select(*df.columns)
