"""Checked queries: features (F), scalers (K), sampling and folds (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabfold.functions.exprs import erfinv_sql
from tabfold.operators import features as FE
from tabfold.operators import sampling as R
from tabfold.operators import scale as K
from tabfold.plans.registry import register
from tabfold.sources.tables import (ENTITY_SQL, TEST_SQL, TRAIN_SQL, entity, table, train_test,
                                    with_ctes)

EMP = with_ctes(ENTITY_SQL, TRAIN_SQL, TEST_SQL)
# SQL twin of functions.exprs.hash_unit: 13 hex digits of md5(key || seed) / 16**13
HU = "CAST(('0x' || substr(md5(CAST(key AS VARCHAR) || '{seed}'), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0"


# ------------------------------------------------------------------ F

@register("f1_f2_f3_text_codes", """
SELECT p_partkey, TRY_CAST(nullif(regexp_extract(p_brand, '(\\d+)', 1), '') AS BIGINT) AS brand_no,
  CASE WHEN starts_with(p_type, 'ECO') THEN 0 WHEN starts_with(p_type, 'STA') THEN 1
       WHEN starts_with(p_type, 'S') THEN 2 ELSE 3 END AS type_code,
  CAST(p_size BETWEEN 10 AND 20 AS INTEGER) AS mid_size FROM part
""")
def q_f1(spark, d):
    """Number inside text (F1), prefix code (F2), range flag."""
    p = table(spark, d, "part")
    x = FE.extract_int(p, "p_brand", out="brand_no")
    x = FE.startswith_code(x, "p_type", [("ECO", 0), ("STA", 1), ("S", 2)], default=3, out="type_code")
    return x.select("p_partkey", "brand_no", "type_code", FE.between_flag("p_size", 10, 20).alias("mid_size"))


@register("f4_f16_flag_above_mean", EMP + """,
m AS (SELECT avg(price) AS mean_price FROM emp)
SELECT key, round(mean_price, 6) AS mean_price, CAST(price > mean_price AND rating = 5 AS INTEGER) AS above_mean
FROM emp CROSS JOIN m
""")
def q_f4(spark, d):
    """Above the dataset mean and top rating (F4) with the mean as a column (F16)."""
    e = entity(spark, d).select("key", "price", "rating")
    x = FE.flag_above_mean(e, "price", extra=F.col("rating") == 5)
    return x.select("key", "mean_price", "above_mean")


@register("f5_f11_arithmetic", """
SELECT l_orderkey, l_linenumber,
  round(7.5 * l_quantity + 5.5 * l_discount + 1.5 * l_tax + 0.25 * l_linenumber, 6) AS score,
  round(l_quantity * l_linenumber, 6) AS qty_x_line,
  round(l_extendedprice / nullif(l_discount, 0), 6) AS price_per_disc,
  round(l_discount + l_tax, 6) AS disc_plus_tax,
  round(ln(1 + l_extendedprice), 6) AS log_price
FROM lineitem
""")
def q_f5(spark, d):
    """Weighted score (F5), product (F6), safe ratio (F7), sum (F8), log1p."""
    li = table(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        FE.linear_score({"l_quantity": 7.5, "l_discount": 5.5, "l_tax": 1.5, "l_linenumber": 0.25}).alias("score"),
        FE.product("l_quantity", "l_linenumber").cast("double").alias("qty_x_line"),
        FE.ratio("l_extendedprice", "l_discount").alias("price_per_disc"),
        FE.add(["l_discount", "l_tax"]).alias("disc_plus_tax"),
        FE.log1p("l_extendedprice").alias("log_price"))


@register("f9_f10_cross_interact", EMP + """
SELECT key, segment || '_' || coalesce(edu, 'NA') AS seg_edu,
  round(price * CAST(rating = 5 AS INTEGER), 6) AS price_top,
  round(coalesce(price * CAST(edu = '1-URGENT' AS INTEGER), NULL), 6) AS price_urgent
FROM emp
""")
def q_f9(spark, d):
    """Two categories as one key (F9); value kept only under a condition."""
    e = entity(spark, d)
    return e.select("key", FE.cross("segment", "edu").alias("seg_edu"),
                    FE.interact_when("price", F.col("rating") == 5).alias("price_top"),
                    FE.interact_when("price", F.col("edu") == "1-URGENT").alias("price_urgent"))


BC_SQL = EMP + """,
grid AS (SELECT CAST(round(-2.0 + 0.05 * i, 2) AS DOUBLE) AS lam FROM range(0, 81) t(i)),
x AS (SELECT price + 1.0 AS v FROM train),
ll AS (SELECT g.lam, (g.lam - 1) * sum(ln(v)) - count(v) / 2.0 *
          ln(var_pop(CASE WHEN g.lam = 0 THEN ln(v) ELSE (pow(v, g.lam) - 1) / g.lam END)) AS llf
       FROM grid g CROSS JOIN x GROUP BY g.lam),
best AS (SELECT arg_max(lam, llf) AS lam FROM ll)"""


@register("f12_boxcox_lambda_apply", BC_SQL + """
SELECT e.key, round(best.lam, 6) AS lambda, round(CASE WHEN best.lam = 0 THEN ln(e.price + 1.0)
  ELSE (pow(e.price + 1.0, best.lam) - 1) / best.lam END, 6) AS price_bc FROM emp e CROSS JOIN best
""")
def q_f12(spark, d):
    """Box-Cox lambda by maximum likelihood on a grid (one pass), applied to all rows."""
    e = entity(spark, d)
    fitted = FE.fit_boxcox(e.filter(F.col("part") == "train"), ["price"])
    x = FE.apply_boxcox(e.select("key", "price"), fitted, "price", out="price_bc")
    lam = fitted.select(F.col("lambda"))
    return x.crossJoin(F.broadcast(lam)).select("key", "lambda", "price_bc")


@register("f13_group_stats", EMP + """,
s AS (SELECT segment, min(acctbal) AS mn, avg(acctbal) AS mu, median(acctbal) AS md, max(acctbal) AS mx,
             stddev_samp(acctbal) AS sd FROM emp GROUP BY segment),
p AS (SELECT priority, min(acctbal) AS mn, avg(acctbal) AS mu, median(acctbal) AS md, max(acctbal) AS mx,
             stddev_samp(acctbal) AS sd FROM emp GROUP BY priority)
SELECT e.key, round(s.mn, 6) AS acctbal_min_segment, round(s.mu, 6) AS acctbal_mean_segment,
  round(s.md, 6) AS acctbal_median_segment, round(s.mx, 6) AS acctbal_max_segment, round(s.sd, 6) AS acctbal_std_segment,
  round(p.mn, 6) AS acctbal_min_priority, round(p.mu, 6) AS acctbal_mean_priority,
  round(p.md, 6) AS acctbal_median_priority, round(p.mx, 6) AS acctbal_max_priority, round(p.sd, 6) AS acctbal_std_priority
FROM emp e JOIN s ON e.segment = s.segment JOIN p ON e.priority = p.priority
""")
def q_f13(spark, d):
    """min/mean/median/max/std of a value per level of two categories, joined back."""
    e = entity(spark, d).select("key", "segment", "priority", "acctbal")
    return FE.group_stats(e, ["segment", "priority"], "acctbal").drop("segment", "priority", "acctbal")


@register("f14_group_mean_scaled", EMP + """
SELECT key,
  round(avg(y) OVER (PARTITION BY segment) * 100, 6) AS rate_s,
  round(avg(y) OVER (PARTITION BY segment, priority) * 100, 6) AS rate_sp,
  round(avg(y) OVER (PARTITION BY segment, priority, nation) * 100, 6) AS rate_spn
FROM train
""")
def q_f14(spark, d):
    """Label rate x100 per 1, 2 and 3 keys (aggregate + join, not windows)."""
    tr, _ = train_test(spark, d)
    x = tr.select("key", "segment", "priority", "nation", "y")
    x = FE.group_mean(x, ["segment"], "y", 100.0, out="rate_s")
    x = FE.group_mean(x, ["segment", "priority"], "y", 100.0, out="rate_sp")
    x = FE.group_mean(x, ["segment", "priority", "nation"], "y", 100.0, out="rate_spn")
    return x.select("key", "rate_s", "rate_sp", "rate_spn")


def _pairwise_sql():
    cats = ["segment", "priority", "nation"]
    vals = ["price", "acctbal"]
    sel = []
    for i, a in enumerate(cats):
        for b in cats[i + 1:]:
            for v in vals:
                sel.append(f"round(avg({v}) OVER (PARTITION BY {a}, {b}), 6) AS {v}_mean_{a}_{b}")
    return EMP + "SELECT key, " + ", ".join(sel) + " FROM emp"


@register("f15_pairwise_group_means", _pairwise_sql())
def q_f15(spark, d):
    """Every pair of 3 categories x 2 values: one grouped aggregate per pair."""
    e = entity(spark, d).select("key", "segment", "priority", "nation", "price", "acctbal")
    return FE.pairwise_means(e, ["segment", "priority", "nation"], ["price", "acctbal"]) \
        .drop("segment", "priority", "nation", "price", "acctbal")


@register("f17_percent_rank_in_group", EMP + """
SELECT key, round(percent_rank() OVER (PARTITION BY segment ORDER BY price), 6) AS price_pct_rank FROM emp
""")
def q_f17(spark, d):
    """Percent rank of price inside its segment (range-split running counts)."""
    e = entity(spark, d).select("key", "segment", "price")
    return FE.rank_in_group(e, "segment", "price", "key").select("key", "price_pct_rank")


@register("f18_dense_contingency", """
WITH p AS (SELECT p_brand, p_type, p_size FROM part),
grid AS (SELECT * FROM (SELECT DISTINCT p_brand FROM p) CROSS JOIN (SELECT DISTINCT p_type FROM p)
         CROSS JOIN (SELECT DISTINCT p_size FROM p)),
cnt AS (SELECT p_brand, p_type, p_size, count(*) AS n FROM p GROUP BY 1, 2, 3)
SELECT g.p_brand, g.p_type, g.p_size, coalesce(c.n, 0) AS n, round(ln(1 + coalesce(c.n, 0)), 6) AS log1p_n
FROM grid g LEFT JOIN cnt c USING (p_brand, p_type, p_size)
""")
def q_f18(spark, d):
    """Counts over all brand x type x size combinations, zeros included."""
    p = table(spark, d, "part").select("p_brand", "p_type", "p_size")
    return FE.dense_counts(p, ["p_brand", "p_type", "p_size"])


@register("f25a_rank_scaled", EMP + """
SELECT key, round((CAST(row_number() OVER (ORDER BY acctbal, key) - 1 AS DOUBLE) / count(*) OVER ()
  - (count(*) OVER () - 1) / (2.0 * count(*) OVER ())) * 2.0, 6) AS acctbal_rank FROM emp
""")
def q_f25a(spark, d):
    """Centred scaled ordinal rank in (-1, 1): the rank-gauss input."""
    return FE.rank_scaled(entity(spark, d), "acctbal", "key")


@register("f25_rank_gauss", EMP + """,
r AS (SELECT key, (CAST(row_number() OVER (ORDER BY acctbal, key) - 1 AS DOUBLE) / count(*) OVER ()
  - (count(*) OVER () - 1) / (2.0 * count(*) OVER ())) * 2.0 AS v FROM emp),
g AS (SELECT key, """ + erfinv_sql("v") + """ AS g FROM r)
SELECT key, round(g - avg(g) OVER (), 6) AS acctbal_gauss FROM g
""")
def q_f25(spark, d):
    """Rank-gauss: erfinv of the centred rank, centred."""
    return FE.rank_gauss(entity(spark, d), "acctbal", "key")


@register("f24_swap_noise", EMP + """,
e AS (SELECT key, price, acctbal FROM emp),
pos AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(key AS VARCHAR) || '7'), key) - 1 AS pos FROM e),
n AS (SELECT count(*) AS n FROM e),
u AS (SELECT pos.*, """ + HU.format(seed="7:price:swap") + """ AS ups,
        floor(""" + HU.format(seed="7:price:donor") + """ * n) AS dp,
        """ + HU.format(seed="7:acctbal:swap") + """ AS uas,
        floor(""" + HU.format(seed="7:acctbal:donor") + """ * n) AS da FROM pos CROSS JOIN n)
SELECT u.key, round(CASE WHEN ups < 0.15 THEN p1.price ELSE u.price END, 6) AS price,
       round(CASE WHEN uas < 0.15 THEN p2.acctbal ELSE u.acctbal END, 6) AS acctbal
FROM u LEFT JOIN pos p1 ON p1.pos = u.dp LEFT JOIN pos p2 ON p2.pos = u.da
""")
def q_f24(spark, d):
    """Swap noise: 15 % of values per column replaced by a keyed donor row's value."""
    e = entity(spark, d).select("key", "price", "acctbal")
    return FE.swap_noise(e, ["price", "acctbal"], "key", 0.15, seed=7)


@register("f26_poly2", EMP + """
SELECT key, round(price * price, 6) AS price_sq, round(price * acctbal, 6) AS price_x_acctbal,
  round(price * rating, 6) AS price_x_rating, round(acctbal * acctbal, 6) AS acctbal_sq,
  round(acctbal * rating, 6) AS acctbal_x_rating, rating * rating AS rating_sq FROM emp
""")
def q_f26(spark, d):
    """Degree-2 squares and products."""
    e = entity(spark, d).select("key", "price", "acctbal", "rating")
    return FE.poly2(e, ["price", "acctbal", "rating"]).drop("price", "acctbal", "rating")


# ------------------------------------------------------------------ K

def _scaler_sql(a: str, s: str) -> str:
    return EMP + f""",
f AS (SELECT {a} AS a, {s} AS s FROM train)
SELECT key, round((price - a) / CASE WHEN s = 0 OR s IS NULL THEN 1.0 ELSE s END, 6) AS price FROM emp CROSS JOIN f
"""


@register("k1_minmax", _scaler_sql("min(price)", "max(price) - min(price)"))
def q_k1(spark, d):
    """Min-max scaling fitted on train."""
    e = entity(spark, d)
    f = K.fit_minmax(e.filter(F.col("part") == "train"), ["price"])
    return K.apply_scaler(e.select("key", "price"), f, ["price"], "minmax")


@register("k2_standard_population", _scaler_sql("avg(price)", "stddev_pop(price)"))
def q_k2(spark, d):
    """Standard scaling with the population std (ddof=0)."""
    e = entity(spark, d)
    f = K.fit_standard(e.filter(F.col("part") == "train"), ["price"], ddof=0)
    return K.apply_scaler(e.select("key", "price"), f, ["price"], "standard")


@register("k2b_standard_sample", _scaler_sql("avg(price)", "stddev_samp(price)"))
def q_k2b(spark, d):
    """Standard scaling with the sample std (ddof=1)."""
    e = entity(spark, d)
    f = K.fit_standard(e.filter(F.col("part") == "train"), ["price"], ddof=1)
    return K.apply_scaler(e.select("key", "price"), f, ["price"], "standard")


@register("k3_robust", _scaler_sql("quantile_cont(price, 0.5)",
                                   "quantile_cont(price, 0.75) - quantile_cont(price, 0.25)"))
def q_k3(spark, d):
    """Robust scaling: (x - median) / IQR, exact percentiles."""
    e = entity(spark, d)
    f = K.fit_robust(e.filter(F.col("part") == "train"), ["price"])
    return K.apply_scaler(e.select("key", "price"), f, ["price"], "robust")


# ------------------------------------------------------------------ R

MD5 = "md5(CAST(key AS VARCHAR) || '{seed}')"


def _rank(seed=42, by=None):
    part = f"PARTITION BY {by} " if by else ""
    return f"(row_number() OVER ({part}ORDER BY {MD5.format(seed=seed)}, key) - 1)"


@register("r1_undersample_1to1", EMP + f""",
r AS (SELECT key, y, {_rank(by='y')} AS rk FROM train),
m AS (SELECT count(*) AS nmin FROM train WHERE y = 1)
SELECT key, y FROM r CROSS JOIN m WHERE y = 1 OR rk < round(nmin * 1.0)
""")
def q_r1(spark, d):
    """Majority class sampled down to the minority size by md5 order."""
    tr, _ = train_test(spark, d)
    return R.undersample(tr.select("key", "y"), "y", "key", ratio=1.0)


@register("r2_undersample_ratio", EMP + f""",
r AS (SELECT key, y, {_rank(by='y')} AS rk FROM train),
m AS (SELECT count(*) AS nmin FROM train WHERE y = 1)
SELECT key, y FROM r CROSS JOIN m WHERE y = 1 OR rk < round(nmin * 1.5)
""")
def q_r2(spark, d):
    """Majority kept at 1.5 x the minority size."""
    tr, _ = train_test(spark, d)
    return R.undersample(tr.select("key", "y"), "y", "key", ratio=1.5)


@register("r3_oversample_repeat", EMP + """
SELECT key, y, unnest(CASE WHEN y = 1 THEN [1, 2, 3] ELSE [1] END) AS _copy FROM train
""")
def q_r3(spark, d):
    """Minority rows repeated three times."""
    tr, _ = train_test(spark, d)
    return R.oversample(tr.select("key", "y"), "y", 3)


@register("r4_bootstrap", EMP + """,
t AS (SELECT key, y, """ + HU.format(seed="3") + """ AS u FROM train),
pmf AS (SELECT i, exp(i * ln(1.5) - 1.5 - lgamma(i + 1)) AS p FROM range(0, 60) r(i)),
cdf AS (SELECT i, sum(p) OVER (ORDER BY i) AS c FROM pmf),
k AS (SELECT t.key, t.y, (SELECT min(i) FROM cdf WHERE c >= t.u) AS k FROM t)
SELECT key, y, CAST(unnest(range(1, k + 1)) AS INTEGER) AS _copy FROM k WHERE k > 0
""")
def q_r4(spark, d):
    """Keyed Poisson(1.5) bootstrap: each row repeated k times, k the inverse
    Poisson CDF (pandas UDF) at md5(key, seed)."""
    tr, _ = train_test(spark, d)
    return R.bootstrap(tr.select("key", "y"), "key", 1.5, seed=3)


@register("r5_shuffle_positions", EMP + f"SELECT key, {_rank()} AS pos FROM emp")
def q_r5(spark, d):
    """Position of each row in the keyed shuffle order (global md5 rank)."""
    from tabfold.functions.ranking import hashed_rank
    from tabfold.functions.exprs import order_hash
    e = entity(spark, d).select("key").withColumn("_h", order_hash("key", 42))
    return hashed_rank(e, "_h", tiebreak="key", out="pos").drop("_h")


@register("r6_sample_n", EMP + f"SELECT key FROM emp ORDER BY {MD5.format(seed=42)}, key LIMIT 100")
def q_r6(spark, d):
    """100 rows chosen by md5 order."""
    return R.sample_n(entity(spark, d).select("key"), "key", 100)


@register("r7_holdout_split", EMP + f""",
r AS (SELECT key, {_rank()} AS rk, count(*) OVER () AS n FROM emp)
SELECT key, CASE WHEN rk < round(n * 0.7) THEN 'train' ELSE 'valid' END AS part FROM r
""")
def q_r7(spark, d):
    """Exact 70/30 split by md5 rank."""
    return R.split(entity(spark, d).select("key"), "key", [0.7, 0.3], names=["train", "valid"])


@register("r8_stratified_split", EMP + f""",
r AS (SELECT key, y, {_rank(by='y')} AS rk, count(*) OVER (PARTITION BY y) AS n FROM train)
SELECT key, y, CASE WHEN rk < round(n * 0.6) THEN 'a' WHEN rk < round(n * 0.8) THEN 'b' ELSE 'c' END AS part FROM r
""")
def q_r8(spark, d):
    """60/20/20 split inside each class."""
    tr, _ = train_test(spark, d)
    return R.split(tr.select("key", "y"), "key", [0.6, 0.2, 0.2], by="y", names=["a", "b", "c"])


@register("r9_kfold", EMP + f"SELECT key, CAST({_rank(seed=7)} % 5 AS INTEGER) AS fold FROM emp")
def q_r9(spark, d):
    """5 folds by md5 rank."""
    return R.add_fold(entity(spark, d).select("key"), "key", 5, seed=7)


@register("r10_stratified_kfold", EMP + f"SELECT key, y, CAST({_rank(seed=7, by='y')} % 5 AS INTEGER) AS fold FROM train")
def q_r10(spark, d):
    """5 folds inside each class."""
    tr, _ = train_test(spark, d)
    return R.add_fold(tr.select("key", "y"), "key", 5, seed=7, by="y")


@register("r11_modulo_fold", EMP + "SELECT key, CAST((row_number() OVER (ORDER BY key) - 1) % 4 AS INTEGER) AS fold FROM emp")
def q_r11(spark, d):
    """Row position in key order mod 4."""
    return R.add_fold_modulo(entity(spark, d).select("key"), "key", 4)


@register("r12_repeated_cv_plan", EMP + " UNION ALL ".join(
    f"SELECT key, {s} AS seed, CAST({_rank(seed=s, by='y')} % 5 AS INTEGER) AS fold FROM train" for s in (1, 2, 3)))
def q_r12(spark, d):
    """Three seeds x stratified 5 folds (key, seed, fold)."""
    tr, _ = train_test(spark, d)
    return R.cv_plan(tr.select("key", "y"), "key", [1, 2, 3], 5, by="y")


@register("r13_class_weights", EMP + """
SELECT key, y, round(count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY y)), 6) AS weight FROM train
""")
def q_r13(spark, d):
    """Balanced class weights n / (k * n_class)."""
    tr, _ = train_test(spark, d)
    return R.with_weight(tr.select("key", "y"), "y", "balanced")
