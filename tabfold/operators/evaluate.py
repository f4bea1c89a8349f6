"""Evaluation (V1-V16) over (y, p) or (y, pred) columns.

Every metric is one aggregation pass or a pass over a table whose size is
bounded by the cutoff grid or by the number of distinct scores:
* cutoff sweeps bucket each score by the grid (exact float comparisons), count
  per bucket, then take suffix sums over <= grid-size rows;
* AUC / ROC / PR use counts per distinct score and range-split running sums
  (no one-partition window over the rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabfold.functions.exprs import as_list, c, safe_div
from tabfold.functions.ranking import join_null_safe, prefix_sums
from tabfold.operators.joins import bounded


def _z(x: Column) -> Column:
    """Metric convention: an undefined ratio (0/0) is 0."""
    return F.coalesce(x, F.lit(0.0))


def confusion_counts(df: DataFrame, y: str, pred, by=None) -> DataFrame:
    """V1: tp, fp, tn, fn (one pass; per ``by`` group if given)."""
    pr = c(pred)
    yy = F.col(y)
    g = df.groupBy(*as_list(by)) if by else df.groupBy()
    return g.agg(F.count_if((yy == 1) & (pr == 1)).alias("tp"), F.count_if((yy == 0) & (pr == 1)).alias("fp"),
                 F.count_if((yy == 0) & (pr == 0)).alias("tn"), F.count_if((yy == 1) & (pr == 0)).alias("fn"))


def metrics_from_counts(cm: DataFrame, keep=()) -> DataFrame:
    """V2-V5: accuracy, per-class precision/recall/f1, support, weighted F1."""
    tp, fp, tn, fn = F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")
    n = tp + fp + tn + fn
    p1, r1 = _z(safe_div(tp, tp + fp)), _z(safe_div(tp, tp + fn))
    p0, r0 = _z(safe_div(tn, tn + fn)), _z(safe_div(tn, tn + fp))
    f1_1 = _z(safe_div(2 * p1 * r1, p1 + r1))
    f1_0 = _z(safe_div(2 * p0 * r0, p0 + r0))
    s1, s0 = tp + fn, tn + fp
    return cm.select(*keep, "tp", "fp", "tn", "fn",
                     safe_div((tp + tn).cast("double"), n.cast("double")).alias("accuracy"),
                     p1.alias("precision"), r1.alias("recall"), f1_1.alias("f1"),
                     p0.alias("precision_0"), r0.alias("recall_0"), f1_0.alias("f1_0"),
                     s1.alias("support_1"), s0.alias("support_0"),
                     _z(safe_div(f1_1 * s1 + f1_0 * s0, n.cast("double"))).alias("f1_weighted"))


def decide(p, cutoff: float, inclusive: bool = False) -> Column:
    """0/1 decision, p > c (or p >= c when ``inclusive``)."""
    return ((c(p) >= cutoff) if inclusive else (c(p) > cutoff)).cast("int")


def f1_at(df: DataFrame, y: str, p: str, cutoff: float, inclusive: bool = False, by=None) -> DataFrame:
    """V6."""
    cm = confusion_counts(df, y, decide(p, cutoff, inclusive), by=by)
    return metrics_from_counts(cm, keep=as_list(by))


# ------------------------------------------------------------------ sweeps

def grid_values(spark, start: float, step: float, n: int) -> DataFrame:
    """Uniform cutoff grid c_i = start + i * step, i = 0..n-1 (bounded: n rows)."""
    return spark.range(n).select(F.col("id").alias("i"),
                                 (F.lit(float(start)) + F.col("id").cast("double") * F.lit(float(step))).alias("cutoff"))


def _cut(i: Column, start: float, step: float) -> Column:
    return F.lit(float(start)) + i.cast("double") * F.lit(float(step))


def grid_bucket(p: Column, start: float, step: float, n: int, inclusive: bool) -> Column:
    """Number of grid cutoffs c_i with c_i < p (``inclusive``: c_i <= p),
    computed from floor((p - start) / step) and corrected by exact
    comparisons with the neighbouring grid values (floor may be off by one)."""
    below = (lambda cc: cc <= p) if inclusive else (lambda cc: cc < p)
    j = F.least(F.greatest(F.floor((p - F.lit(float(start))) / F.lit(float(step))), F.lit(-1)), F.lit(n - 1))
    j = j.cast("long")
    base = F.when((j >= 0) & ~below(_cut(j, start, step)), j).otherwise(j + 1)
    return F.when((j + 1 <= n - 1) & below(_cut(j + 1, start, step)), j + 2).otherwise(base)


def sweep(df: DataFrame, y: str, p: str, start: float, step: float, n: int,
          inclusive: bool = False, by=None) -> DataFrame:
    """V7/V9: confusion counts and metrics at every cutoff of a uniform grid
    in one pass over the scores. Output per (by, cutoff)."""
    by = as_list(by)
    spark = df.sparkSession
    b = df.select(*by, F.col(y).alias("_y"), grid_bucket(F.col(p), start, step, n, inclusive).alias("_b"))
    cnt = b.groupBy(*by, "_b").agg(F.count_if(F.col("_y") == 1).alias("_pos"),
                                   F.count_if(F.col("_y") == 0).alias("_neg"))
    tot = cnt.groupBy(*by).agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    # dense bucket ids 0..n per group (groups x grid rows: bounded by the grid)
    buckets = spark.range(n + 1).select(F.col("id").alias("_b"))
    dense = tot.select(*by).crossJoin(F.broadcast(buckets)) if by else buckets
    dense = join_null_safe(dense, cnt, [*by, "_b"], "left").fillna(0, ["_pos", "_neg"])
    # rows predicted positive at cutoff i are those with bucket > i: suffix sums
    w = Window.partitionBy(*by).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, 0)
    suf = dense.select(*by, (F.col("_b") - 1).alias("i"), F.sum("_pos").over(w).alias("tp"),
                       F.sum("_neg").over(w).alias("fp"))
    grid = grid_values(spark, start, step, n)
    keyed = tot.crossJoin(F.broadcast(grid)) if by else grid.crossJoin(F.broadcast(tot))
    out = join_null_safe(keyed, suf, [*by, "i"]).select(*by, "cutoff", "tp", "fp", "_P", "_N")
    out = out.select(*by, "cutoff", "tp", "fp", (F.col("_N") - F.col("fp")).alias("tn"),
                     (F.col("_P") - F.col("tp")).alias("fn"))
    return metrics_from_counts(out, keep=[*by, "cutoff"]).select(
        *by, "cutoff", "tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1")


def best_cutoff(sweep_df: DataFrame, by=None, metric: str = "f1") -> DataFrame:
    """V8: the cutoff with the highest metric; ties -> the smallest cutoff.
    Runs over the sweep table (grid-size rows per group)."""
    by = as_list(by)
    g = sweep_df.groupBy(*by) if by else sweep_df.groupBy()
    return g.agg(F.min_by(F.struct("cutoff", metric), F.struct(-F.col(metric), F.col("cutoff"))).alias("_b")) \
        .select(*by, F.col("_b.cutoff").alias("cutoff"), F.col(f"_b.{metric}").alias(metric))


# ------------------------------------------------------------------ rank metrics

def score_counts(df: DataFrame, y: str, p: str, by=None) -> DataFrame:
    """Positives and negatives per distinct score (partial aggregate)."""
    return df.groupBy(*as_list(by), F.col(p).alias("p")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))


def auc(df: DataFrame, y: str, p: str, by=None) -> DataFrame:
    """Exact ROC AUC with ties counted one half:
    sum_v pos_v * (neg below v + neg_v / 2) / (P * N)."""
    by = as_list(by)
    sc = score_counts(df, y, p, by)
    cum = prefix_sums(sc, "p", ["neg"], by=by or None, inclusive=False)
    g = cum.groupBy(*by) if by else cum.groupBy()
    return g.agg(safe_div(F.sum(F.col("pos") * (F.col("neg_cum") + F.col("neg") * 0.5)),
                          F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"))


def roc_points(df: DataFrame, y: str, p: str, by=None) -> DataFrame:
    """One (threshold, fpr, tpr) point per distinct score, predicting
    positive for p >= threshold."""
    by = as_list(by)
    sc = score_counts(df, y, p, by)
    cum = prefix_sums(sc, "p", ["pos", "neg"], by=by or None, ascending=False, inclusive=True)
    tot = sc.groupBy(*by).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    x = join_null_safe(cum, bounded(tot), by) if by else cum.crossJoin(F.broadcast(tot))
    return x.select(*by, F.col("p").alias("threshold"), F.col("pos_cum").alias("tp"), F.col("neg_cum").alias("fp"),
                    safe_div(F.col("neg_cum").cast("double"), F.col("_N")).alias("fpr"),
                    safe_div(F.col("pos_cum").cast("double"), F.col("_P")).alias("tpr"))


def pr_points(df: DataFrame, y: str, p: str, by=None) -> DataFrame:
    """Precision and recall at each distinct score threshold (p >= t)."""
    return roc_points(df, y, p, by).select(
        *as_list(by), "threshold", safe_div(F.col("tp").cast("double"), F.col("tp") + F.col("fp")).alias("precision"),
        F.col("tpr").alias("recall"))


def average_precision(df: DataFrame, y: str, p: str, by=None) -> DataFrame:
    """AP = sum over thresholds of (R_i - R_{i-1}) * P_i
    = (1/P) * sum_v pos_v * precision(>= v)."""
    by = as_list(by)
    sc = score_counts(df, y, p, by)
    cum = prefix_sums(sc, "p", ["pos", "neg"], by=by or None, ascending=False, inclusive=True)
    g = cum.groupBy(*by) if by else cum.groupBy()
    return g.agg(safe_div(F.sum(F.col("pos") * F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))),
                          F.sum("pos").cast("double")).alias("average_precision"))


# ------------------------------------------------------------------ summaries

def fold_summary(fold_metrics: DataFrame, metric: str, by=None) -> DataFrame:
    """Mean and (population) std of a metric over folds."""
    g = fold_metrics.groupBy(*as_list(by)) if by else fold_metrics.groupBy()
    return g.agg(F.avg(metric).alias(f"{metric}_mean"), F.stddev_pop(metric).alias(f"{metric}_std"),
                 F.count(F.lit(1)).alias("n_folds"))


def battery(df: DataFrame, y: str, p: str, cutoff: float, by) -> DataFrame:
    """roc_auc and per-class precision/recall/f1 per group (e.g. per
    model and split), in two aggregation passes."""
    by = as_list(by)
    m = f1_at(df, y, p, cutoff, by=by).select(*by, F.col("precision").alias("precision_1"),
                                              F.col("recall").alias("recall_1"), F.col("f1").alias("f1_1"),
                                              "precision_0", "recall_0", "f1_0")
    return join_null_safe(m, auc(df, y, p, by=by).withColumnRenamed("auc", "roc_auc"), by)


def positive_share(df: DataFrame, pred, by=None) -> DataFrame:
    """Mean of the 0/1 decision."""
    g = df.groupBy(*as_list(by)) if by else df.groupBy()
    return g.agg(F.avg(c(pred).cast("double")).alias("positive_share"))


def matched_cutoff(oof: DataFrame, test: DataFrame, p: str, cutoff: float) -> DataFrame:
    """Test cutoff giving the test set the OOF positive share at
    ``cutoff``: with k = round(share * n_test), the k-th largest test score
    (rows with p >= it are the k predicted positives, up to ties)."""
    share = oof.agg(F.avg((F.col(p) > cutoff).cast("double")).alias("_share"))
    n = test.agg(F.count(F.lit(1)).alias("_n"))
    k = share.crossJoin(n).select(F.round(F.col("_share") * F.col("_n")).cast("long").alias("_k"), "_share")
    sc = test.groupBy(F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("_c"))
    cum = prefix_sums(sc, "p", ["_c"], ascending=False, inclusive=True)
    x = cum.crossJoin(F.broadcast(k)).where(F.col("_c_cum") >= F.col("_k"))
    return x.agg(F.max("p").alias("test_cutoff"), F.first("_share").alias("oof_share"),
                 F.first("_k").alias("k"))
