"""Feature selection by statistics.

All per-feature statistics run on one melted table ``(feature, value, y)``,
so many columns cost one shuffle, not one job each. Ranks come from counts
per distinct value plus range-split running sums.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabfold.functions.exprs import as_list, digamma, erfc, safe_div
from tabfold.functions.ranking import prefix_sums, quantiles
from tabfold.operators import evaluate as V
from tabfold.operators.joins import bounded
from tabfold.session import cut_lineage


def melt(df: DataFrame, cols, y: str, keep_null_values: bool = False) -> DataFrame:
    """(feature, value double, y) for every non-null value (nulls dropped,
    as ``dropna`` does before the tests)."""
    cols = as_list(cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "feature string, value double, y int")
    long = df.select(F.col(y).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(x).alias("feature"), F.col(x).cast("double").alias("value")) for x in cols
    ])).alias("s")).select("s.feature", "s.value", "y")
    return long if keep_null_values else long.where(F.col("value").isNotNull())


def ranksum(df: DataFrame, cols, y: str, min_n: int = 20) -> DataFrame:
    """Wilcoxon rank-sum z of class 0 against class 1 per feature
    (average ranks over ties, no tie correction), two-sided normal p;
    p = 2 when a class has fewer than ``min_n`` values."""
    long = melt(df, cols, y).where(F.col("y").isNotNull())
    cnt = long.groupBy("feature", "value").agg(F.count_if(F.col("y") == 0).alias("c0"),
                                               F.count_if(F.col("y") == 1).alias("c1"))
    cnt = cnt.withColumn("c", F.col("c0") + F.col("c1"))
    cum = prefix_sums(cnt, "value", ["c"], by="feature", inclusive=False)
    avg_rank = F.col("c_cum") + (F.col("c") + 1) / 2.0
    st = cum.groupBy("feature").agg(F.sum(F.col("c0") * avg_rank).alias("_s"), F.sum("c0").alias("n0"),
                                    F.sum("c1").alias("n1"))
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    z = (F.col("_s") - n0 * (n0 + n1 + 1) / 2.0) / F.sqrt(n0 * n1 * (n0 + n1 + 1) / 12.0)
    out = st.select("feature", "n0", "n1", z.alias("z"))
    return out.withColumn("p", F.when((F.col("n0") >= min_n) & (F.col("n1") >= min_n),
                                      erfc(F.abs(F.col("z")) / F.lit(math.sqrt(2.0)))).otherwise(F.lit(2.0)))


def class_diff(df: DataFrame, cols, y: str, mean_df: DataFrame | None = None) -> DataFrame:
    """|mean0 - mean1| for 0/1 features, else |median0 - median1|;
    ``diff_norm`` = |diff / mean of the feature over ``mean_df`` (default df)|."""
    long = melt(df, cols, y).where(F.col("y").isNotNull())
    g = long.groupBy("feature").agg(
        F.avg(F.when(F.col("y") == 0, F.col("value"))).alias("mean0"),
        F.avg(F.when(F.col("y") == 1, F.col("value"))).alias("mean1"),
        F.count_if(~F.col("value").isin(0.0, 1.0)).alias("_non01"),
        F.min("value").alias("_min"), F.max("value").alias("_max"))
    # exact class medians, scale-safe: one quantile pass over (feature, class) groups
    med = quantiles(long, ["value"], [0.5], by=["feature", "y"]) \
        .groupBy("feature").agg(F.first(F.when(F.col("y") == 0, F.col("q0")), ignorenulls=True).alias("med0"),
                                F.first(F.when(F.col("y") == 1, F.col("q0")), ignorenulls=True).alias("med1"))
    g = g.join(med, "feature", "left")
    binary = (F.col("_non01") == 0) & (F.col("_min") < F.col("_max"))
    diff = F.when(binary, F.abs(F.col("mean0") - F.col("mean1"))).otherwise(F.abs(F.col("med0") - F.col("med1")))
    means = melt(mean_df if mean_df is not None else df, cols, y).groupBy("feature").agg(F.avg("value").alias("_mean"))
    return g.select("feature", diff.alias("diff")).join(means, "feature") \
        .select("feature", "diff", F.abs(safe_div(F.col("diff"), F.col("_mean"))).alias("diff_norm"))


def same_distribution(df: DataFrame, cols, y: str, alpha: float = 0.05, norm_thr: float = 0.5) -> DataFrame:
    """Features to drop: (diff = 0 and p > alpha) or (diff_norm < norm_thr
    and p > alpha). Returns ``(feature, diff, diff_norm, p, rule)``."""
    t = class_diff(df, cols, y).join(ranksum(df, cols, y).select("feature", "p"), "feature")
    rule = F.when((F.col("diff") == 0) & (F.col("p") > alpha), F.lit("no_difference")) \
        .when((F.col("diff_norm") < norm_thr) & (F.col("p") > alpha), F.lit("small_difference"))
    return t.withColumn("rule", rule).where(F.col("rule").isNotNull())


def drift_report(stacked: DataFrame, cols, label: str, alpha: float = 0.05, norm_thr: float = 1.0) -> DataFrame:
    """train/test drift: the same tests with "is labelled" as the group;
    a feature is flagged if p < alpha and diff_norm > norm_thr, and it shows no
    class difference (class diff_norm = 0) on the labelled rows."""
    marked = stacked.withColumn("_lab", F.col(label).isNotNull().cast("int"))
    drift = class_diff(marked, cols, "_lab").join(ranksum(marked, cols, "_lab").select("feature", "p"), "feature")
    bad = drift.where((F.col("p") < alpha) & (F.col("diff_norm") > norm_thr))
    cls = class_diff(stacked.where(F.col(label).isNotNull()), cols, label, mean_df=stacked) \
        .select("feature", F.col("diff_norm").alias("class_diff_norm"))
    return bad.join(cls, "feature").where(F.col("class_diff_norm") == 0)


def select_by_iv(iv: DataFrame, lo: float = 0.02, hi: float = 0.8) -> DataFrame:
    """Keep features with lo <= IV <= hi (explicit bounds)."""
    return iv.where((F.col("iv") >= lo) & (F.col("iv") <= hi))


def mutual_info(df: DataFrame, cols, y: str) -> DataFrame:
    """Mutual information (nats) between each discrete (or pre-binned)
    feature and the label: sum p(x,y) ln(p(x,y) / (p(x) p(y)))."""
    long = melt(df, cols, y, keep_null_values=True).where(F.col("y").isNotNull())
    j = long.groupBy("feature", "value", "y").agg(F.count(F.lit(1)).alias("n_xy"))
    nx = j.groupBy("feature", "value").agg(F.sum("n_xy").alias("n_x"))
    ny = j.groupBy("feature", "y").agg(F.sum("n_xy").alias("n_y"))
    n = j.groupBy("feature").agg(F.sum("n_xy").alias("n"))
    # null feature values form their own level: null-safe equality on value
    nx = nx.withColumnRenamed("feature", "_f").withColumnRenamed("value", "_v")
    x = j.join(nx, (F.col("feature") == F.col("_f")) & F.col("value").eqNullSafe(F.col("_v"))) \
        .drop("_f", "_v").join(ny, ["feature", "y"]).join(n, "feature")
    term = F.col("n_xy") / F.col("n") * F.log(F.col("n_xy") * F.col("n") / (F.col("n_x") * F.col("n_y")))
    return x.groupBy("feature").agg(F.sum(term).alias("mutual_info"))


def _kth_in_class(points: DataFrame, k: int, rows: int) -> DataFrame:
    """(feature, y, v, c, r): distinct values of each class with their counts and the distance
    from a value to the k-th nearest other row of its class (k - 1 of few rows).

    Positions in the class cut it into buckets of ``rows`` rows; each bucket borrows the k
    rows before and after it, so a window inside a bucket sees all candidates and no class
    is one task. A value with over k copies is at distance 0 and needs no neighbours;
    others enter the buckets at most k + 1 times."""
    counts = points.groupBy("feature", "y", "v").agg(F.count(F.lit(1)).alias("c"))
    size = counts.groupBy("feature", "y").agg(F.sum("c").alias("n_class"))
    counts = counts.join(bounded(size), ["feature", "y"]).where("n_class > 1") \
        .withColumn("k", F.least(F.lit(k).cast("long"), F.col("n_class") - 1))
    few = counts.withColumn("copies", F.least("c", F.col("k") + 1))
    placed = prefix_sums(few, "v", ["copies"], by=["feature", "y"], inclusive=False, suffix="_before")
    each = placed.select("feature", "y", "v", "c", "n_class", "k", F.posexplode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("nr", "_"), "copies_before") \
        .withColumn("pos", F.col("copies_before") + F.col("nr")).drop("_", "copies_before")
    own = F.floor(F.col("pos") / rows)
    at = F.pmod("pos", F.lit(rows))
    to = F.array(own, F.when(at < k, own - 1), F.when(at >= rows - k, own + 1))
    dealt = each.withColumn("own", own).withColumn("bucket", F.explode(F.filter(to, lambda b: b.isNotNull() & (b >= 0))))
    w = Window.partitionBy("feature", "y", "bucket").orderBy("pos")
    near = F.collect_list("v").over(w.rowsBetween(-k, k))
    gaps = F.array_sort(F.transform(near, lambda x: F.abs(x - F.col("v"))))  # its own distance 0 comes first
    found = dealt.withColumn("r", F.element_at(gaps, (F.col("k") + 1).cast("int"))).where("bucket = own and nr = 0")
    return found.select("feature", "y", "v", "c", "n_class", "k", "r")


def mutual_info_continuous(df: DataFrame, cols, y: str, k: int = 3, bucket_rows: int = 100_000) -> DataFrame:
    """X7 for continuous features: (feature, mutual_info) in nats by the nearest-neighbour
    estimator for a discrete label.

    For each row, d is the distance to its k-th nearest row of the same class in one feature, and
    m the number of rows of any class between value - d and value + d (itself included; rows
    at the same value, if d is 0). The estimate is psi(n) + mean psi(k) - mean psi(class size) - mean psi(m),
    0 at least. Classes of at most k rows use their size less one; classes of one row
    and rows with a null or NaN value or a null label are left out.

    Both steps run on sorted, range-split distinct values: d from windows with borrowed
    rows, m as the difference of two running counts, read at the interval's ends by
    sorting them in among the values."""
    if not 0 < k <= bucket_rows:
        raise ValueError("k is at least 1 and at most bucket_rows")
    points = melt(df, cols, y).where(F.col("y").isNotNull() & ~F.isnan("value")) \
        .select("feature", "y", (F.col("value") + F.lit(0.0)).alias("v"))
    near = cut_lineage(_kth_in_class(points, k, bucket_rows))
    # one row per value and per interval end; an end has no weight of its own. tag orders what lies at
    # one place: an open interval's left end comes after equal values, its right end before them
    values = near.groupBy("feature", "v").agg(F.sum("c").alias("w")).select("feature", F.col("v").alias("x"), F.lit(1).alias("tag"), "w")
    still = F.col("r") == 0
    left = near.select("feature", (F.col("v") - F.col("r")).alias("x"), F.when(still, 0).otherwise(2).alias("tag"))
    right = near.select("feature", (F.col("v") + F.col("r")).alias("x"), F.when(still, 2).otherwise(0).alias("tag"))
    ends = left.union(right).distinct().withColumn("w", F.lit(0).cast("long"))
    running = prefix_sums(values.union(ends).groupBy("feature", "x", "tag").agg(F.sum("w").alias("w")), ["x", "tag"], ["w"], by=["feature"], inclusive=True).select("feature", "x", "tag", "w_cum")
    running = cut_lineage(running.where("tag <> 1"))
    at = lambda x, tag, name: running.select("feature", F.col("x").alias(x), F.col("tag").alias(tag), F.col("w_cum").alias(name))
    m = near.withColumns({"xl": F.col("v") - F.col("r"), "tl": F.when(still, 0).otherwise(2), "xr": F.col("v") + F.col("r"), "tr": F.when(still, 2).otherwise(0)}) \
        .join(at("xl", "tl", "below"), ["feature", "xl", "tl"]).join(at("xr", "tr", "upto"), ["feature", "xr", "tr"]) \
        .withColumn("m", F.greatest(F.col("upto") - F.col("below"), F.lit(1)))
    parts = m.groupBy("feature").agg(*[(F.sum(F.col("c") * digamma(F.col(x))) / F.sum("c")).alias(f"p_{x}") for x in ("k", "n_class", "m")], F.sum("c").alias("n"))
    return parts.select("feature", F.greatest(F.lit(0.0), digamma(F.col("n")) + F.col("p_k") - F.col("p_n_class") - F.col("p_m")).alias("mutual_info"))


def feature_gini(df: DataFrame, cols, y: str) -> DataFrame:
    """2 * AUC - 1 of every feature used alone as a score."""
    long = melt(df, cols, y).where(F.col("y").isNotNull())
    return V.auc(long, "y", "value", by="feature").select("feature", (2 * F.col("auc") - 1).alias("gini"))


def top_k(table: DataFrame, col: str, k: int, name: str = "feature") -> DataFrame:
    """The k largest rows of a (small) importance table, ties by name."""
    return table.orderBy(F.col(col).desc(), F.col(name)).limit(k)
