"""Checked queries for the encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabfold.operators import encode as E
from tabfold.plans.registry import register
from tabfold.sources.tables import ENTITY_SQL, TEST_SQL, TRAIN_SQL, entity, train_test, with_ctes

EMP = with_ctes(ENTITY_SQL, TRAIN_SQL, TEST_SQL)


@register("e12_target_encode_smoothed", EMP + """,
pr AS (SELECT avg(y) AS prior FROM train),
st AS (SELECT nation, avg(y) AS mean, count(*) AS n FROM train WHERE nation IS NOT NULL GROUP BY nation),
sw AS (SELECT nation, mean, 1.0 / (1.0 + exp(-(n - 200) / 50.0)) AS w FROM st)
SELECT e.key, round(coalesce(pr.prior * (1 - sw.w) + sw.mean * sw.w, pr.prior), 6) AS te_nation
FROM emp e CROSS JOIN pr LEFT JOIN sw ON e.nation = sw.nation
""")
def q_e12(spark, d):
    """Smoothed target encoding of nation, fitted on train rows, applied to all."""
    e = entity(spark, d)
    tr = e.filter(F.col("part") == "train")
    table, prior = E.fit_target_encode(tr, "nation", "y", min_samples_leaf=200, smoothing=50)
    return E.apply_target_encode(e, table, prior, "nation", "te_nation").select("key", "te_nation")


LEVELS_SQL = """
lv AS (
  SELECT DISTINCT 'priority' AS "column", CAST(priority AS VARCHAR) AS level FROM {src} WHERE priority IS NOT NULL
  UNION SELECT DISTINCT 'segment', CAST(segment AS VARCHAR) FROM {src} WHERE segment IS NOT NULL
  UNION SELECT DISTINCT 'edu', CAST(edu AS VARCHAR) FROM {src} WHERE edu IS NOT NULL),
codes AS (SELECT "column", level,
  CAST(row_number() OVER (PARTITION BY "column" ORDER BY level) - 1 AS INTEGER) AS code FROM lv)"""


@register("e1_label_encode_fit", EMP + "," + LEVELS_SQL.format(src="train") +
          "\nSELECT * FROM codes")
def q_e1_fit(spark, d):
    """Label codes (sorted level position) for three text columns, fitted on train."""
    tr, _ = train_test(spark, d)
    return E.fit_label(tr, ["priority", "segment", "edu"])


@register("e4_label_apply_null_code", EMP + "," + LEVELS_SQL.format(src="train") + """
SELECT e.key,
  coalesce(p.code, CASE WHEN e.priority IS NULL THEN -1 END) AS priority,
  coalesce(s.code, CASE WHEN e.segment IS NULL THEN -1 END) AS segment,
  coalesce(u.code, CASE WHEN e.edu IS NULL THEN -1 END) AS edu
FROM emp e
LEFT JOIN (SELECT * FROM codes WHERE "column" = 'priority') p ON e.priority = p.level
LEFT JOIN (SELECT * FROM codes WHERE "column" = 'segment') s ON e.segment = s.level
LEFT JOIN (SELECT * FROM codes WHERE "column" = 'edu') u ON e.edu = u.level
""")
def q_e4(spark, d):
    """Apply train-fitted label codes to all rows; null -> -1, unseen -> null."""
    e = entity(spark, d)
    tr = e.filter(F.col("part") == "train")
    cols = ["priority", "segment", "edu"]
    fitted = E.fit_label(tr, cols)
    return E.apply_label(e.select("key", *cols), fitted, cols, null_code=-1, unseen_code=None)


@register("e2_label_encode_train_test", EMP + "," + LEVELS_SQL.format(
    src="(SELECT priority, segment, edu FROM train UNION ALL SELECT priority, segment, edu FROM test)") +
          "\nSELECT * FROM codes")
def q_e2(spark, d):
    """Label codes fitted on train stacked with test, so both get the same codes."""
    tr, te = train_test(spark, d)
    return E.fit_label(tr.unionByName(te, allowMissingColumns=True), ["priority", "segment", "edu"])


@register("e3_factorize_first_seen", EMP + """
SELECT CAST(nation AS VARCHAR) AS level,
  CAST(row_number() OVER (ORDER BY min(key), CAST(nation AS VARCHAR)) - 1 AS INTEGER) AS code
FROM emp WHERE nation IS NOT NULL GROUP BY nation
""")
def q_e3(spark, d):
    """Codes by first appearance in key order."""
    return E.fit_factorize(entity(spark, d), "nation", "key")


PRIORITY_ORDER = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "4-NOT SPECIFIED": 2, "5-LOW": 1}


@register("e5_ordinal_map", EMP + """
SELECT key, CASE priority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3
  WHEN '4-NOT SPECIFIED' THEN 2 WHEN '5-LOW' THEN 1 ELSE 0 END AS priority_ord,
  CASE WHEN edu IS NULL THEN NULL WHEN edu = '1-URGENT' THEN 1 ELSE 0 END AS edu_urgent
FROM emp
""")
def q_e5(spark, d):
    """Declared ordinal map with a default, and a binary code."""
    e = entity(spark, d)
    x = E.ordinal(e, "priority", PRIORITY_ORDER, default=0, out="priority_ord")
    x = x.withColumn("edu_urgent", F.when(F.col("edu").isNotNull(), (F.col("edu") == "1-URGENT").cast("int")))
    return x.select("key", "priority_ord", "edu_urgent")


@register("e7_frequency_rank_top3", EMP + """,
cnt AS (SELECT nation AS level, count(*) AS "count" FROM train WHERE nation IS NOT NULL GROUP BY nation),
top AS (SELECT level, "count", row_number() OVER (ORDER BY "count" DESC, level DESC) AS rank FROM cnt)
SELECT e.key, CAST(t.rank - 1 AS INTEGER) AS nation_code FROM emp e LEFT JOIN top t ON e.nation = t.level AND t.rank <= 3
""")
def q_e7(spark, d):
    """Top-3 most frequent nations coded 0..2 (ties to the larger level), rest null."""
    e = entity(spark, d)
    fitted = E.fit_freq_rank(e.filter(F.col("part") == "train"), "nation", 3)
    return E.apply_freq_rank(e, fitted, "nation", "nation_code").select("key", "nation_code")


@register("e8_onehot_fitted_levels", EMP + """
SELECT e.key,
  CAST(coalesce(e.segment = 'AUTOMOBILE', false) AS INTEGER) AS segment_AUTOMOBILE,
  CAST(coalesce(e.segment = 'BUILDING', false) AS INTEGER) AS segment_BUILDING,
  CAST(coalesce(e.segment = 'FURNITURE', false) AS INTEGER) AS segment_FURNITURE,
  CAST(coalesce(e.segment = 'HOUSEHOLD', false) AS INTEGER) AS segment_HOUSEHOLD,
  CAST(coalesce(e.segment = 'MACHINERY', false) AS INTEGER) AS segment_MACHINERY,
  CAST(coalesce(e.edu = '', false) AS INTEGER) AS edu_,
  CAST(coalesce(e.edu = '1-URGENT', false) AS INTEGER) AS "edu_1-URGENT",
  CAST(coalesce(e.edu = '2-HIGH', false) AS INTEGER) AS "edu_2-HIGH",
  CAST(coalesce(e.edu = '3-MEDIUM', false) AS INTEGER) AS "edu_3-MEDIUM",
  CAST(coalesce(e.edu = '4-NOT SPECIFIED', false) AS INTEGER) AS "edu_4-NOT SPECIFIED",
  CAST(coalesce(e.edu = '5-LOW', false) AS INTEGER) AS "edu_5-LOW",
  CAST(e.edu IS NULL AS INTEGER) AS edu_nan
FROM emp e
""")
def q_e8(spark, d):
    """One-hot with levels fitted on train, applied to all rows, plus a null dummy."""
    e = entity(spark, d)
    levels = E.fit_onehot(e.filter(F.col("part") == "train"), ["segment", "edu"])
    x = E.apply_onehot(e.select("key", "segment", "edu"), {"segment": levels["segment"]})
    return E.apply_onehot(x, {"edu": levels["edu"]}, dummy_na=True)


@register("e10_count_encode_scaled", EMP + """,
cnt AS (SELECT nation AS level, count(*) AS n FROM train GROUP BY nation),
mm AS (SELECT min(n) AS mn, max(n) AS mx FROM cnt)
SELECT e.key, round(coalesce((c.n - mm.mn) / nullif(mm.mx - mm.mn, 0), 0.0), 6) AS nation_count
FROM emp e LEFT JOIN cnt c ON e.nation = c.level CROSS JOIN mm
""")
def q_e10(spark, d):
    """Level counts on train, min-max scaled, attached to all rows."""
    e = entity(spark, d)
    t = E.fit_count_encode(e.filter(F.col("part") == "train"), "nation")
    return E.apply_count_encode(e, t, "nation", "nation_count").select("key", "nation_count")


@register("e11_target_mean_pairs", EMP + """,
tm AS (SELECT segment, priority, avg(y) AS mean FROM train GROUP BY segment, priority),
tn AS (SELECT segment, nation, avg(y) AS mean FROM train GROUP BY segment, nation)
SELECT e.key, round(a.mean, 6) AS tm_segment_priority, round(b.mean, 6) AS tm_segment_nation
FROM emp e LEFT JOIN tm a ON e.segment = a.segment AND e.priority = a.priority
LEFT JOIN tn b ON e.segment = b.segment AND e.nation = b.nation
""")
def q_e11(spark, d):
    """Label mean per pair of categories, fitted on train, joined on both keys."""
    e = entity(spark, d)
    tr = e.filter(F.col("part") == "train")
    for keys in (["segment", "priority"], ["segment", "nation"]):
        e = E.apply_target_mean(e, E.fit_target_mean(tr, keys, "y"), keys, "tm_" + "_".join(keys))
    return e.select("key", "tm_segment_priority", "tm_segment_nation")


@register("e13_woe_share_form", EMP + """,
g AS (SELECT priority AS level, CAST(sum(CAST(y = 0 AS BIGINT)) AS BIGINT) AS non_event,
             CAST(sum(CAST(y = 1 AS BIGINT)) AS BIGINT) AS event FROM train GROUP BY priority),
t AS (SELECT sum(CAST(y = 0 AS BIGINT)) AS non, sum(CAST(y = 1 AS BIGINT)) AS ev FROM train),
s AS (SELECT level, non_event, event, non_event / t.non AS sn, event / t.ev AS se FROM g CROSS JOIN t),
w AS (SELECT *, CASE WHEN non_event > 0 AND event > 0 THEN ln(sn / se) ELSE 0.0 END AS woe FROM s)
SELECT level, non_event, event, round(sn, 6) AS perc_non_event, round(se, 6) AS perc_event,
       round(woe, 6) AS woe, round((sn - se) * woe, 6) AS iv FROM w
""")
def q_e13(spark, d):
    """Weight of evidence, share form, per priority level on train."""
    tr, _ = train_test(spark, d)
    return E.fit_woe(tr, "priority", "y")


@register("e14_woe_odds_tail", EMP + """,
x AS (SELECT least(nation, 20) AS level, y FROM train),
g AS (SELECT level, CAST(sum(CAST(y = 0 AS BIGINT)) + CAST(level = 20 AS BIGINT) AS BIGINT) AS ne,
             CAST(sum(CAST(y = 1 AS BIGINT)) + CAST(level = 20 AS BIGINT) AS BIGINT) AS ev FROM x GROUP BY level)
SELECT level, ne AS non_event, ev AS event, round(ne / (ne + ev), 6) AS perc_non_event,
       round(ev / (ne + ev), 6) AS perc_event,
       round(CASE WHEN ne > 0 AND ev > 0 THEN ln(ne / ev) END, 6) AS woe FROM g
""")
def q_e14(spark, d):
    """Within-level odds WOE with nations >= 20 merged (+1/+1 on the merged level)."""
    tr, _ = train_test(spark, d)
    return E.collapse_woe_tail(tr, "nation", "y", 20)


@register("e15_information_value", EMP + """,
lv AS (SELECT 'priority' AS "column", CAST(priority AS VARCHAR) AS level, y FROM train
       UNION ALL SELECT 'segment', segment, y FROM train
       UNION ALL SELECT 'nation', CAST(nation AS VARCHAR), y FROM train
       UNION ALL SELECT 'rating', CAST(rating AS VARCHAR), y FROM train),
g AS (SELECT "column", level, sum(CAST(y = 0 AS BIGINT)) AS ne, sum(CAST(y = 1 AS BIGINT)) AS ev
      FROM lv GROUP BY "column", level),
t AS (SELECT sum(CAST(y = 0 AS BIGINT)) AS non, sum(CAST(y = 1 AS BIGINT)) AS evt FROM train)
SELECT "column", round(sum((ne / non - ev / evt) *
       CASE WHEN ne > 0 AND ev > 0 THEN ln((ne / non) / (ev / evt)) ELSE 0.0 END), 6) AS iv
FROM g CROSS JOIN t GROUP BY "column"
""")
def q_e15(spark, d):
    """Information value of four columns (nulls form their own level)."""
    tr, _ = train_test(spark, d)
    return E.information_value(tr, ["priority", "segment", "nation", "rating"], "y")


PRICE_EDGES = [0.0, 50000.0, 100000.0, 150000.0, 200000.0, 300000.0, 400000.0, 600000.0]


@register("e16_bin_custom_right_closed", EMP + """
SELECT key, CASE WHEN price > 0 AND price <= 50000 THEN 1 WHEN price > 50000 AND price <= 100000 THEN 2
  WHEN price > 100000 AND price <= 150000 THEN 3 WHEN price > 150000 AND price <= 200000 THEN 4
  WHEN price > 200000 AND price <= 300000 THEN 5 WHEN price > 300000 AND price <= 400000 THEN 6
  WHEN price > 400000 AND price <= 600000 THEN 7 END AS price_bin
FROM emp
""")
def q_e16(spark, d):
    """Right-closed custom intervals labelled 1..7 (pandas-cut semantics)."""
    e = entity(spark, d)
    return E.bin_edges(e, "price", PRICE_EDGES, out="price_bin").select("key", "price_bin")


QPROBS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99, 1.0]


@register("e17_quantile_bins", EMP + """,
q AS (SELECT list_sort(list_distinct(quantile_cont(acctbal, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99, 1.0]))) AS edges FROM train),
b AS (SELECT e.key, e.acctbal, q.edges,
        CASE WHEN e.acctbal < q.edges[1] OR e.acctbal > q.edges[len(q.edges)] THEN NULL
             WHEN e.acctbal = q.edges[1] THEN 1
             ELSE len(list_filter(q.edges, lambda x: x < e.acctbal)) END AS bin
      FROM emp e CROSS JOIN q)
SELECT key, CAST(bin AS INTEGER) AS acctbal_bin, round(edges[bin], 6) AS acctbal_bin_lower,
       round(edges[bin + 1], 6) AS acctbal_bin_upper FROM b
""")
def q_e17(spark, d):
    """Unique exact-quantile edges fitted on train; right-closed bins for all rows."""
    e = entity(spark, d)
    edges = E.fit_quantile_edges(e.filter(F.col("part") == "train"), "acctbal", QPROBS)
    return E.apply_quantile_bins(e.select("key", "acctbal"), edges, "acctbal", "acctbal_bin").drop("acctbal")


@register("e18_binned_woe", EMP + """,
q AS (SELECT list_sort(list_distinct(quantile_cont(price, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99, 1.0]))) AS edges FROM train),
b AS (SELECT t.y, q.edges, CASE WHEN t.price = q.edges[1] THEN 1
             ELSE len(list_filter(q.edges, lambda x: x < t.price)) END AS bin FROM train t CROSS JOIN q),
g AS (SELECT bin AS level, CAST(sum(CAST(y = 0 AS BIGINT)) AS BIGINT) AS ne, CAST(sum(CAST(y = 1 AS BIGINT)) AS BIGINT) AS ev,
             any_value(edges[bin]) AS lower, any_value(edges[bin + 1]) AS upper FROM b GROUP BY bin)
SELECT CAST(level AS INTEGER) AS level, ne AS non_event, ev AS event, round(ne / (ne + ev), 6) AS perc_non_event,
       round(ev / (ne + ev), 6) AS perc_event,
       round(CASE WHEN ne > 0 AND ev > 0 THEN ln(ne / ev) END, 6) AS woe,
       round(lower, 6) AS lower, round(upper, 6) AS upper FROM g
""")
def q_e18(spark, d):
    """Quantile bins of price, then within-bin odds WOE with interval bounds."""
    tr, _ = train_test(spark, d)
    return E.fit_binned_woe(tr, "price", "y", QPROBS)


@register("e19_equal_width_bins", EMP + """,
mm AS (SELECT min(acctbal) AS lo, max(acctbal) AS hi FROM train)
SELECT key, CAST(CASE WHEN acctbal < lo THEN 0 WHEN acctbal >= hi THEN 11
  ELSE floor(10 * (acctbal - lo) / (hi - lo)) + 1 END AS BIGINT) AS acctbal_wbin
FROM emp CROSS JOIN mm
""")
def q_e19(spark, d):
    """Ten equal-width bins between train min and max (0 below, 11 at/above max)."""
    e = entity(spark, d)
    mm = e.filter(F.col("part") == "train").agg(F.min("acctbal").alias("lo"), F.max("acctbal").alias("hi"))
    return e.crossJoin(F.broadcast(mm)).select(  # one-row side
        "key", F.expr("width_bucket(acctbal, lo, hi, 10)").cast("long").alias("acctbal_wbin"))


@register("e12b_target_encode_out_of_fold", EMP + """,
f AS (SELECT key, nation, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5(CAST(key AS VARCHAR) || '5'), key) - 1)
             % 5 AS INTEGER) AS fold FROM train),
enc AS (SELECT f.key, f.nation, f.fold,
          (SELECT avg(y) FROM f o WHERE o.fold <> f.fold) AS prior,
          (SELECT count(*) FROM f o WHERE o.fold <> f.fold AND o.nation = f.nation) AS n,
          (SELECT avg(y) FROM f o WHERE o.fold <> f.fold AND o.nation = f.nation) AS mean FROM f),
w AS (SELECT *, 1.0 / (1.0 + exp(-(n - 50) / 10.0)) AS w FROM enc)
SELECT key, fold, round(CASE WHEN nation IS NULL OR n = 0 THEN prior ELSE prior * (1 - w) + mean * w END, 6) AS te_nation
FROM w
""")
def q_e12b(spark, d):
    """Smoothed target encoding out of fold: each train row is encoded from
    the other four stratified folds only."""
    from tabfold.operators import sampling as R
    tr, _ = train_test(spark, d)
    tr = R.add_fold(tr.select("key", "nation", "y"), "key", 5, seed=5, by="y")
    t = E.fit_target_encode_oof(tr, "nation", "y", "fold", min_samples_leaf=50, smoothing=10)
    return E.apply_target_encode_oof(tr, t, "nation", "fold", "te_nation").select("key", "fold", "te_nation")
