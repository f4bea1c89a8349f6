"""Checked queries: evaluation (V) and ensembles / decision rules (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabfold.operators import ensemble as B
from tabfold.operators import evaluate as V
from tabfold.plans.registry import register
from tabfold.sources.tables import (ENTITY_SQL, SCORES_LONG_SQL, SCORES_WIDE_SQL, entity, scores_long,
                                    scores_wide, with_ctes)

SW = with_ctes(SCORES_WIDE_SQL)
SL = with_ctes(SCORES_LONG_SQL)


def _metrics_sql(src: str, keep: str = "", rnd: bool = True) -> str:
    """SQL twin of ``metrics_from_counts`` over a CTE with tp, fp, tn, fn.
    ``rnd=False`` for intermediate tables (argmax, std): no rounding."""
    k = f"{keep}, " if keep else ""
    r = (lambda e: f"round({e}, 6)") if rnd else (lambda e: e)
    return f"""
SELECT {k}tp, fp, tn, fn, {r("(tp + tn) / (tp + fp + tn + fn)")} AS accuracy,
  {r("p1")} AS precision, {r("r1")} AS recall, {r("f1_1")} AS f1,
  {r("p0")} AS precision_0, {r("r0")} AS recall_0, {r("f1_0")} AS f1_0,
  tp + fn AS support_1, tn + fp AS support_0,
  {r("coalesce((f1_1 * (tp + fn) + f1_0 * (tn + fp)) / nullif(tp + fp + tn + fn, 0), 0.0)")} AS f1_weighted
FROM (SELECT *, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0.0) AS f1_1,
             coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0.0) AS f1_0 FROM (
  SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r1,
            coalesce(tn / nullif(tn + fn, 0), 0.0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0.0) AS r0
  FROM {src}))"""


def _cm_sql(pred: str, src: str, by: str = "") -> str:
    g = f" GROUP BY {by}" if by else ""
    k = f"{by}, " if by else ""
    return (f"(SELECT {k}count(*) FILTER (WHERE y = 1 AND {pred}) AS tp, count(*) FILTER (WHERE y = 0 AND {pred}) AS fp, "
            f"count(*) FILTER (WHERE y = 0 AND NOT ({pred})) AS tn, count(*) FILTER (WHERE y = 1 AND NOT ({pred})) AS fn "
            f"FROM {src}{g})")


@register("v1_v5_confusion_report", SW + _metrics_sql(_cm_sql("p_m1 > 0.3", "sw WHERE split = 'oof'")))
def q_v1(spark, d):
    """Confusion counts, accuracy, per-class precision/recall/F1, support, weighted F1."""
    s = scores_wide(spark, d).where(F.col("split") == "oof")
    return V.f1_at(s, "y", "p_m1", 0.3)


@register("v6_f1_at_cutoff_inclusive", SL + _metrics_sql(_cm_sql("p >= 0.3", "sl WHERE split = 'oof'", "model"),
                                                         "model"))
def q_v6(spark, d):
    """Metrics at p >= 0.3 per model."""
    s = scores_long(spark, d).where(F.col("split") == "oof")
    return V.f1_at(s, "y", "p", 0.3, inclusive=True, by="model")


def _sweep_sql(src: str, start: float, step: float, n: int, op: str, by: str = "", rnd: bool = True) -> str:
    k = f"{by}, " if by else ""
    gb = f"{by}, " if by else ""
    cnt = (f"(SELECT {k}g.cutoff, count(*) FILTER (WHERE s.y = 1 AND s.p {op} g.cutoff) AS tp, "
           f"count(*) FILTER (WHERE s.y = 0 AND s.p {op} g.cutoff) AS fp, "
           f"count(*) FILTER (WHERE s.y = 0 AND NOT (s.p {op} g.cutoff)) AS tn, "
           f"count(*) FILTER (WHERE s.y = 1 AND NOT (s.p {op} g.cutoff)) AS fn "
           f"FROM (SELECT CAST({start!r} AS DOUBLE) + CAST(i AS DOUBLE) * CAST({step!r} AS DOUBLE) AS cutoff "
           f"FROM range(0, {n}) t(i)) g CROSS JOIN {src} s GROUP BY {gb}g.cutoff)")
    m = _metrics_sql(cnt, (by + ", cutoff") if by else "cutoff", rnd=rnd)
    cut = "round(cutoff, 6) AS cutoff" if rnd else "cutoff"
    return (f"SELECT {k}{cut}, tp, fp, tn, fn, accuracy, precision, recall, f1 FROM ({m})")


@register("v7_v9_cutoff_sweep", SW + _sweep_sql("(SELECT y, p_m1 AS p FROM sw WHERE split = 'oof')", 0.0, 0.01, 101, ">"))
def q_v7(spark, d):
    """TP/FP/TN/FN and metrics at 101 cutoffs 0..1 in one pass (p > c)."""
    s = scores_wide(spark, d).where(F.col("split") == "oof")
    return V.sweep(s, "y", "p_m1", 0.0, 0.01, 101)


@register("v7b_sweep_per_model_inclusive",
          SL + _sweep_sql("(SELECT model, y, p FROM sl WHERE split = 'oof')", 0.1, 0.005, 80, ">=", by="model"))
def q_v7b(spark, d):
    """Per-model sweep over 80 cutoffs from 0.1 by 0.005 (p >= c)."""
    s = scores_long(spark, d).where(F.col("split") == "oof")
    return V.sweep(s, "y", "p", 0.1, 0.005, 80, inclusive=True, by="model")


@register("v8_best_cutoff", SL + """,
sw8 AS (""" + _sweep_sql("(SELECT model, y, p FROM sl WHERE split = 'oof')", 0.0, 0.01, 101, ">", by="model",
                         rnd=False) + """)
SELECT model, round(arg_min(cutoff, (-f1, cutoff)), 6) AS cutoff, round(max(f1), 6) AS f1 FROM sw8 GROUP BY model
""")
def q_v8(spark, d):
    """Cutoff with the best F1 per model (first on ties)."""
    s = scores_long(spark, d).where(F.col("split") == "oof")
    return V.best_cutoff(V.sweep(s, "y", "p", 0.0, 0.01, 101, by="model"), by="model")


@register("v10_prevalence_matched_cutoff", SW + """,
sh AS (SELECT avg(CAST(p_m1 > 0.3 AS DOUBLE)) AS share FROM sw WHERE split = 'oof'),
kk AS (SELECT CAST(round(share * (SELECT count(*) FROM sw WHERE split = 'test')) AS BIGINT) AS k, share FROM sh),
cum AS (SELECT p_m1 AS p, sum(count(*)) OVER (ORDER BY p_m1 DESC) AS c FROM sw WHERE split = 'test' GROUP BY p_m1)
SELECT round(max(p), 6) AS test_cutoff, round(any_value(share), 6) AS oof_share, any_value(k) AS k
FROM cum CROSS JOIN kk WHERE c >= k
""")
def q_v10(spark, d):
    """Test cutoff giving the test rows the OOF positive share at 0.3."""
    s = scores_wide(spark, d)
    return V.matched_cutoff(s.where(F.col("split") == "oof"), s.where(F.col("split") == "test"), "p_m1", 0.3)


AUC_SQL = """
sc AS (SELECT model, split, p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
       FROM sl GROUP BY 1, 2, 3),
cum AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model, split ORDER BY p
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM sc),
au AS (SELECT model, split, sum(pos * (nb + neg * 0.5)) / (sum(pos) * sum(neg)) AS auc FROM cum GROUP BY 1, 2)"""


@register("v11_auc_exact_ties", SL + "," + AUC_SQL + "\nSELECT model, split, round(auc, 6) AS auc FROM au")
def q_v11(spark, d):
    """Exact ROC AUC with tied scores counted one half, per model and split."""
    return V.auc(scores_long(spark, d), "y", "p", by=["model", "split"])


@register("v12_roc_points", SW + """,
sc AS (SELECT p_m2 AS p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
       FROM sw WHERE split = 'oof' GROUP BY 1),
c AS (SELECT p, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp,
             sum(pos) OVER () AS tot_pos, sum(neg) OVER () AS tot_neg FROM sc)
SELECT round(p, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(fp / tot_neg, 6) AS fpr,
       round(tp / tot_pos, 6) AS tpr FROM c
""")
def q_v12(spark, d):
    """ROC points (threshold, fpr, tpr), one per distinct score."""
    s = scores_wide(spark, d).where(F.col("split") == "oof")
    return V.roc_points(s, "y", "p_m2")


@register("v13_pr_curve", SW + """,
sc AS (SELECT p_m3 AS p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
       FROM sw WHERE split = 'oof' GROUP BY 1),
c AS (SELECT p, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp,
             sum(pos) OVER () AS tot_pos FROM sc)
SELECT round(p, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / tot_pos, 6) AS recall FROM c
""")
def q_v13(spark, d):
    """Precision and recall at each distinct score threshold."""
    s = scores_wide(spark, d).where(F.col("split") == "oof")
    return V.pr_points(s, "y", "p_m3")


@register("v13b_average_precision", SL + """,
sc AS (SELECT model, p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
       FROM sl WHERE split = 'oof' GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY p DESC) AS tp,
             sum(neg) OVER (PARTITION BY model ORDER BY p DESC) AS fp FROM sc)
SELECT model, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS average_precision FROM c GROUP BY model
""")
def q_v13b(spark, d):
    """Average precision per model."""
    s = scores_long(spark, d).where(F.col("split") == "oof")
    return V.average_precision(s, "y", "p", by="model")


@register("v14_fold_summary", SL + """,
fm AS (""" + _metrics_sql(_cm_sql("p > 0.3", "sl WHERE split = 'oof'", "model, fold"), "model, fold", rnd=False) + """)
SELECT model, round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std, count(*) AS n_folds
FROM fm GROUP BY model
""")
def q_v14(spark, d):
    """Mean and population std of fold F1 per model."""
    s = scores_long(spark, d).where(F.col("split") == "oof")
    return V.fold_summary(V.f1_at(s, "y", "p", 0.3, by=["model", "fold"]), "f1", by="model")


@register("v15_metric_battery", SL + "," + AUC_SQL + """,
m AS (""" + _metrics_sql(_cm_sql("p > 0.3", "sl", "model, split"), "model, split") + """)
SELECT m.model, m.split, precision AS precision_1, recall AS recall_1, f1 AS f1_1, precision_0, recall_0, f1_0,
       round(au.auc, 6) AS roc_auc FROM m JOIN au USING (model, split)
""")
def q_v15(spark, d):
    """AUC and per-class precision/recall/F1 for every model on OOF and test."""
    return V.battery(scores_long(spark, d), "y", "p", 0.3, by=["model", "split"])


@register("v16_positive_share", SL + """
SELECT model, round(avg(CAST(p > 0.3 AS DOUBLE)), 6) AS positive_share FROM sl WHERE split = 'test' GROUP BY model
""")
def q_v16(spark, d):
    """Share of predicted positives per model on test rows."""
    s = scores_long(spark, d).where(F.col("split") == "test")
    return V.positive_share(s, V.decide("p", 0.3), by="model")


# ------------------------------------------------------------------ B

@register("b1_mean_blend", SL + "SELECT key, round(avg(p), 6) AS p_blend FROM sl WHERE split = 'oof' GROUP BY key")
def q_b1(spark, d):
    """Mean of model scores per key."""
    return B.blend(scores_long(spark, d).where(F.col("split") == "oof"), "mean")


@register("b2_weighted_blend", SL + """
SELECT key, round(sum(w * p) / sum(w), 6) AS p_blend FROM (
  SELECT key, p, CASE model WHEN 'm1' THEN 2.0 WHEN 'm2' THEN 1.0 WHEN 'm3' THEN 3.0 ELSE 0.0 END AS w
  FROM sl WHERE split = 'oof') GROUP BY key
""")
def q_b2(spark, d):
    """Weighted soft vote, weights 2, 1, 3."""
    return B.blend(scores_long(spark, d).where(F.col("split") == "oof"), "mean", weights={"m1": 2, "m2": 1, "m3": 3})


@register("b3_harmonic_blend", SL + """
SELECT key, round(CASE WHEN min(p) <= 0 THEN 0.0 ELSE count(p) / sum(1.0 / p) END, 6) AS p_blend
FROM sl WHERE split = 'oof' GROUP BY key
""")
def q_b3(spark, d):
    """Harmonic mean of model scores (a zero score gives 0)."""
    return B.blend(scores_long(spark, d).where(F.col("split") == "oof"), "hmean")


@register("b4_geometric_blend", SL + """
SELECT key, round(CASE WHEN min(p) <= 0 THEN 0.0 ELSE exp(avg(ln(CASE WHEN p > 0 THEN p END))) END, 6) AS p_blend
FROM sl WHERE split = 'oof' GROUP BY key
""")
def q_b4(spark, d):
    """Geometric mean of model scores (a zero score gives 0)."""
    return B.blend(scores_long(spark, d).where(F.col("split") == "oof"), "gmean")


@register("b5_weighted_hard_vote", SL + """
SELECT key, CAST(sum(w * d) > sum(w * (1 - d)) AS INTEGER) AS vote FROM (
  SELECT key, CAST(p > 0.3 AS INTEGER) AS d, CASE model WHEN 'm1' THEN 1.0 WHEN 'm2' THEN 2.0 WHEN 'm3' THEN 1.0 END AS w
  FROM sl WHERE split = 'oof') GROUP BY key
""")
def q_b5(spark, d):
    """Weighted hard vote (weights 1, 2, 1), ties to class 0."""
    return B.vote(scores_long(spark, d).where(F.col("split") == "oof"), 0.3, weights={"m1": 1, "m2": 2, "m3": 1})


@register("b6_majority_vote", SL + """
SELECT key, CAST(round_even(avg(CAST(p > 0.3 AS DOUBLE)), 0) AS INTEGER) AS majority
FROM sl WHERE split = 'oof' GROUP BY key
""")
def q_b6(spark, d):
    """Majority of per-model decisions: round(mean), half to even."""
    s = scores_long(spark, d).where(F.col("split") == "oof").withColumn("d", V.decide("p", 0.3))
    return B.majority(s, "d")


@register("b7_b8_rule_vote", SW + """
SELECT key, CAST(p_m1 > 0.3 AS INTEGER) AS d1,
  CAST((p_m1 > 0.3) OR (p_m2 > 0.35) OR ((p_m3 > 0.4) AND (p_m1 > 0.2)) AS INTEGER) AS rule
FROM sw WHERE split = 'oof'
""")
def q_b7(spark, d):
    """Binarize (B8) and an explicit boolean rule a or b or (c and d)."""
    s = scores_wide(spark, d).where(F.col("split") == "oof")
    rule = (F.col("p_m1") > 0.3) | (F.col("p_m2") > 0.35) | ((F.col("p_m3") > 0.4) & (F.col("p_m1") > 0.2))
    return s.select("key", V.decide("p_m1", 0.3).alias("d1"), B.rule_vote(rule).alias("rule"))


@register("b9_shifted_rounding", SW + """
SELECT key, CAST(round_even(p_m1 + 0.2048, 0) AS INTEGER) AS flag FROM sw WHERE split = 'test'
""")
def q_b9(spark, d):
    """round(p + 0.2048), half to even."""
    s = scores_wide(spark, d).where(F.col("split") == "test")
    return s.select("key", B.shifted_round("p_m1", 0.2048).alias("flag"))


@register("b10_b13_select_models", SL + """,
m AS (""" + _metrics_sql(_cm_sql("p > 0.25", "sl WHERE split = 'oof'", "model"), "model", rnd=False) + """)
SELECT model, round(f1, 6) AS f1 FROM m WHERE f1 > 0.3 AND model NOT IN ('m3')
""")
def q_b10(spark, d):
    """Models whose recorded OOF F1 exceeds 0.3, minus an excluded name."""
    s = scores_long(spark, d).where(F.col("split") == "oof")
    met = V.f1_at(s, "y", "p", 0.25, by="model").select("model", "f1")
    return B.select_models(met, "f1", 0.3, exclude=["m3"])


@register("b14_override_rule", with_ctes(ENTITY_SQL) + """
SELECT key, CASE WHEN price >= 400000 THEN 1 WHEN rating = 5 AND price >= 300000 AND price < 400000 THEN 1
  ELSE CAST(price > 250000 AS INTEGER) END AS decision FROM emp
""")
def q_b14(spark, d):
    """Business rules force the decision; otherwise the score cutoff decides."""
    e = entity(spark, d)
    pred = (F.col("price") > 250000).cast("int")
    rule = B.override(pred, [(F.col("price") >= 400000, 1),
                             ((F.col("rating") == 5) & (F.col("price") >= 300000) & (F.col("price") < 400000), 1)])
    return e.select("key", rule.alias("decision"))


@register("b15_base_vs_ensemble", SL + """,
o AS (SELECT * FROM sl WHERE split = 'oof'),
sc AS (SELECT model, p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM o GROUP BY 1, 2),
bl AS (SELECT key, round(avg(p), 12) AS p, any_value(y) AS y FROM o GROUP BY key),
sb AS (SELECT 'mean_blend' AS model, p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
       FROM bl GROUP BY p),
al AS (SELECT * FROM sc UNION ALL SELECT * FROM sb),
cum AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY p
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM al)
SELECT model AS name, round(sum(pos * (nb + neg * 0.5)) / (sum(pos) * sum(neg)), 6) AS auc FROM cum GROUP BY model
""")
def q_b15(spark, d):
    """AUC of each base model and of their mean blend."""
    return B.compare_scores(scores_long(spark, d).where(F.col("split") == "oof"))


BLEND_W = [i * 0.1 for i in range(11)]


@register("b16_tune_blend_weights", SW + """,
x AS (SELECT y, w, w * p_m1 + (1 - w) * p_m2 AS p FROM sw
      CROSS JOIN (SELECT CAST(i AS DOUBLE) * CAST(0.1 AS DOUBLE) AS w FROM range(0, 11) t(i)) WHERE split = 'oof'),
sw16 AS (""" + _sweep_sql("x", 0.0, 0.02, 31, ">", by="w", rnd=False) + """)
SELECT round(arg_min(w, (-f1, w, cutoff)), 6) AS w, round(arg_min(cutoff, (-f1, w, cutoff)), 6) AS cutoff,
  round(max(f1), 6) AS f1
FROM sw16
""")
def q_b16(spark, d):
    """Blend weight (0..1 by 0.1) and cutoff (0..0.6 by 0.02) chosen by OOF F1."""
    s = scores_wide(spark, d).where(F.col("split") == "oof")
    return B.tune_blend(s, "y", "p_m1", "p_m2", BLEND_W, 0.0, 0.02, 31)
