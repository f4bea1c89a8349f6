"""Blends, votes and decision rules (B1-B16) over the long score table
``(key, split, model, run, fold, p)``. Each blend is one ``groupBy(key)``
aggregate (partial aggregation map-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabfold.functions.exprs import as_list, c, safe_div
from tabfold.operators import evaluate as V


def blend(long: DataFrame, how: str = "mean", weights: dict | None = None, key="key",
          model: str = "model", p: str = "p", out: str = "p_blend") -> DataFrame:
    """Mean, weighted mean, harmonic (n / sum 1/p; any p <= 0 -> 0) or
    geometric (exp(mean ln p); any p <= 0 -> 0) blend per key."""
    keys = as_list(key)
    g = long.groupBy(*keys)
    pv = F.col(p).cast("double")
    if how == "mean" and not weights:
        return g.agg(F.avg(pv).alias(out))
    if how == "mean":
        m = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        w = F.coalesce(m[F.col(model)], F.lit(0.0))
        return g.agg(safe_div(F.sum(w * pv), F.sum(w)).alias(out))
    if how == "hmean":
        return g.agg(F.when(F.min(pv) <= 0, F.lit(0.0))
                     .otherwise(F.count(pv) / F.sum(1.0 / F.when(pv > 0, pv))).alias(out))
    if how == "gmean":
        return g.agg(F.when(F.min(pv) <= 0, F.lit(0.0))
                     .otherwise(F.exp(F.avg(F.log(F.when(pv > 0, pv))))).alias(out))
    raise ValueError(how)


def vote(long: DataFrame, cutoff: float, weights: dict | None = None, key="key", model: str = "model",
         p: str = "p", out: str = "vote") -> DataFrame:
    """Weighted hard vote of per-model decisions p > cutoff; the class
    with the larger weight total wins, a tie goes to the smaller class (0)."""
    keys = as_list(key)
    d = V.decide(p, cutoff)
    if weights:
        m = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        w = F.coalesce(m[F.col(model)], F.lit(0.0))
    else:
        w = F.lit(1.0)
    return long.groupBy(*keys).agg(F.sum(w * d).alias("_w1"), F.sum(w * (1 - d)).alias("_w0")) \
        .select(*keys, (F.col("_w1") > F.col("_w0")).cast("int").alias(out))


def majority(long: DataFrame, pred: str, key="key", out: str = "majority") -> DataFrame:
    """round(mean of 0/1 decisions), half to even (as NumPy rounds)."""
    keys = as_list(key)
    return long.groupBy(*keys).agg(F.bround(F.avg(F.col(pred).cast("double")), 0).cast("int").alias(out))


def rule_vote(expr: Column) -> Column:
    """An explicit boolean rule over model decisions, as 0/1."""
    return expr.cast("int")


def shifted_round(p, shift: float) -> Column:
    """round(p + shift) half to even, i.e. decide(p, 0.5 - shift) except at ties."""
    return F.bround(c(p) + F.lit(shift), 0).cast("int")


def select_models(metrics: DataFrame, metric: str, threshold: float, exclude=()) -> DataFrame:
    """Models whose recorded metric exceeds ``threshold``, minus
    excluded names, best first."""
    x = metrics.where(F.col(metric) > threshold)
    if exclude:
        x = x.where(~F.col("model").isin(list(exclude)))
    return x.orderBy(F.col(metric).desc(), "model")


def override(pred, rules: list[tuple[Column, int]]) -> Column:
    """Business rules force a decision; first matching rule wins."""
    expr = None
    for cond, v in rules:
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr.otherwise(c(pred)) if expr is not None else c(pred)


def compare_scores(long: DataFrame, y: str = "y", p: str = "p", key="key", model: str = "model") -> DataFrame:
    """AUC of every base model and of their mean blend, best first.
    Blended scores are rounded to 12 digits so that equal blends tie no matter
    in which order the engine summed the model scores."""
    base = V.auc(long, y, p, by=model).withColumnRenamed(model, "name")
    lab = long.groupBy(*as_list(key)).agg(F.first(y).alias(y))
    bl = blend(long, "mean", key=key, model=model, p=p).join(lab, as_list(key)) \
        .withColumn("p_blend", F.round("p_blend", 12))
    ens = V.auc(bl, y, "p_blend").withColumn("name", F.lit("mean_blend"))
    return base.unionByName(ens).orderBy(F.col("auc").desc(), "name")


def tune_blend(wide: DataFrame, y: str, p_a: str, p_b: str, weights: list[float],
               start: float, step: float, n: int) -> DataFrame:
    """Weight w of ``w * p_a + (1 - w) * p_b`` and cutoff chosen on F1.

    Each row is expanded by the (literal, bounded) weight list and bucketed
    by the cutoff grid inside the same stage; the partial aggregate per
    (w, bucket) means the expansion never reaches the shuffle."""
    x = wide.select(F.col(y), F.col(p_a), F.col(p_b), F.explode(F.array(*[F.lit(float(w)) for w in weights])).alias("w"))
    x = x.select(y, "w", (F.col("w") * F.col(p_a) + (1 - F.col("w")) * F.col(p_b)).alias("_pb"))
    sw = V.sweep(x, y, "_pb", start, step, n, by="w")
    return sw.groupBy().agg(F.min_by(F.struct("w", "cutoff", "f1"),
                                     F.struct(-F.col("f1"), F.col("w"), F.col("cutoff"))).alias("b")) \
        .select("b.w", "b.cutoff", "b.f1")
