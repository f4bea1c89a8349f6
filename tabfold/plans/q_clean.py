"""Checked queries for cleaning and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabfold.operators import clean as C
from tabfold.operators import profile as P
from tabfold.operators import setops as U
from tabfold.plans.registry import register
from tabfold.sources.tables import (ENTITY_SQL, TEST_SQL, TRAIN_SQL, entity, table, train_test,
                                    with_ctes)

EMP = with_ctes(ENTITY_SQL, TRAIN_SQL, TEST_SQL)
EDU_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("c1_fill_constant", EMP + "SELECT key, coalesce(rating, 0) AS rating, coalesce(edu, 'unknown') AS edu FROM emp")
def q_c1(spark, d):
    """Per-column constants for nulls."""
    return C.fill_const(entity(spark, d).select("key", "rating", "edu"), {"rating": 0, "edu": "unknown"})


@register("c2_fill_mode", EMP + """,
m AS (SELECT (SELECT first(edu ORDER BY n DESC, edu) FROM (SELECT edu, count(*) AS n FROM train
               WHERE edu IS NOT NULL GROUP BY edu)) AS m_edu,
             (SELECT first(rating ORDER BY n DESC, rating) FROM (SELECT rating, count(*) AS n FROM train
               WHERE rating IS NOT NULL GROUP BY rating)) AS m_rating)
SELECT key, coalesce(edu, m_edu) AS edu, coalesce(rating, m_rating) AS rating FROM emp CROSS JOIN m
""")
def q_c2(spark, d):
    """Most frequent value fitted on train fills nulls on all rows."""
    e = entity(spark, d)
    fitted = C.fit_mode(e.filter(F.col("part") == "train"), ["edu", "rating"])
    return C.apply_fill(e.select("key", "edu", "rating"), fitted)


@register("c3_fill_median", EMP + """,
m AS (SELECT median(rating) AS med FROM train)
SELECT key, round(coalesce(CAST(rating AS DOUBLE), med), 6) AS rating FROM emp CROSS JOIN m
""")
def q_c3(spark, d):
    """Exact median fitted on train fills nulls."""
    e = entity(spark, d)
    fitted = C.fit_median(e.filter(F.col("part") == "train"), ["rating"])
    return C.apply_fill(e.select("key", "rating"), fitted)


@register("c4_fill_mean", EMP + """,
m AS (SELECT avg(rating) AS mu FROM train)
SELECT key, round(coalesce(CAST(rating AS DOUBLE), mu), 6) AS rating FROM emp CROSS JOIN m
""")
def q_c4(spark, d):
    """Mean fitted on train fills nulls."""
    e = entity(spark, d)
    return C.apply_fill(e.select("key", "rating"), C.fit_mean(e.filter(F.col("part") == "train"), ["rating"]))


EVENTS_SQL = "ev AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events)"


@register("c5_forward_fill", with_ctes(EVENTS_SQL) + """
SELECT event_id, user_id, round(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS value FROM ev
""")
def q_c5(spark, d):
    """Last seen value per user in time order (range-split, carry between ranges)."""
    ev = table(spark, d, "events").select(
        "event_id", "ts", "user_id",
        F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"))
    return C.ffill(ev, ["value"], ["ts", "event_id"], by="user_id").select("event_id", "user_id", "value")


@register("c5b_forward_fill_global", with_ctes(EVENTS_SQL) + """
SELECT event_id, round(last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS value FROM ev
""")
def q_c5b(spark, d):
    """Forward fill over the whole table in time order (no group column)."""
    ev = table(spark, d, "events").select(
        "event_id", "ts", F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"))
    return C.ffill(ev, ["value"], ["ts", "event_id"]).select("event_id", "value")


@register("c6_fill_conditional", EMP + """
SELECT key, coalesce(rating, CASE WHEN y = 1 THEN 5 ELSE 3 END) AS rating FROM train
""")
def q_c6(spark, d):
    """Null rating -> 5 when the label is 1, else 3."""
    tr, _ = train_test(spark, d)
    return C.fill_when(tr.select("key", "y", "rating"), "rating", [(F.col("y") == 1, 5)], default=3) \
        .select("key", "rating")


@register("c7_fill_group_mode", EMP + """,
vc AS (SELECT segment, nation, edu, count(*) AS n FROM train WHERE edu IS NOT NULL GROUP BY 1, 2, 3),
gm AS (SELECT segment, nation, first(edu ORDER BY n DESC, edu) AS group_mode FROM vc GROUP BY 1, 2),
g AS (SELECT first(edu ORDER BY n DESC, edu) AS gmode FROM (SELECT edu, count(*) AS n FROM train
      WHERE edu IS NOT NULL GROUP BY edu))
SELECT e.key, coalesce(e.edu, gm.group_mode, g.gmode) AS edu
FROM emp e LEFT JOIN gm ON e.segment = gm.segment AND e.nation = gm.nation CROSS JOIN g
""")
def q_c7(spark, d):
    """Mode inside (segment, nation), else the global mode."""
    e = entity(spark, d)
    grp, glob = C.fit_group_mode(e.filter(F.col("part") == "train"), "edu", ["segment", "nation"])
    return C.apply_group_mode(e.select("key", "segment", "nation", "edu"), grp, glob, "edu",
                              ["segment", "nation"]).select("key", "edu")


@register("c8_fill_random_level", EMP + """
SELECT key, coalesce(edu, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][
  CAST(floor(CAST(('0x' || substr(md5(CAST(key AS VARCHAR) || '42'), 1, 13))::BIGINT AS DOUBLE)
             / 4503599627370496.0 * 5) AS INTEGER) + 1]) AS edu FROM emp
""")
def q_c8(spark, d):
    """Null -> a level picked uniformly by md5(key, seed): repeatable."""
    return C.fill_random_level(entity(spark, d).select("key", "edu"), "edu", EDU_LEVELS, "key", 42)


@register("c11_null_as_level", EMP + "SELECT key, 'Rating_' || coalesce(CAST(rating AS VARCHAR), 'NA') AS rating_lvl FROM emp")
def q_c11(spark, d):
    """Missing becomes its own level."""
    return C.null_as_level(entity(spark, d), "rating", "Rating_", out="rating_lvl").select("key", "rating_lvl")


@register("c12_blank_to_null_or_level", EMP + """
SELECT key, CASE WHEN trim(edu) = '' THEN NULL ELSE edu END AS edu_null,
  CASE WHEN trim(edu) = '' THEN 'blank' ELSE edu END AS edu_lvl FROM emp
""")
def q_c12(spark, d):
    """Blank strings -> NULL, or -> a named level."""
    e = entity(spark, d).select("key", "edu", F.col("edu").alias("edu_lvl"))
    e = C.blank_to(e, "edu", None).withColumnRenamed("edu", "edu_null")
    return C.blank_to(e, "edu_lvl", "blank")


@register("c13_winsorize_upper", EMP + """,
q AS (SELECT quantile_cont(price, 0.99) AS cap FROM train)
SELECT key, round(least(price, cap), 6) AS price FROM emp CROSS JOIN q
""")
def q_c13(spark, d):
    """Cap at the train 99th percentile."""
    e = entity(spark, d)
    caps = C.fit_cap(e.filter(F.col("part") == "train"), ["price"], 0.99)
    return C.apply_cap(e.select("key", "price"), caps, ["price"])


@register("c14_c15_clip_collapse", EMP + """
SELECT key, least(rating, 4) AS rating, CASE WHEN nation >= 20 THEN 20 ELSE nation END AS nation FROM emp
""")
def q_c14(spark, d):
    """Constant cap (C14) and numeric tail collapse."""
    e = entity(spark, d).select("key", "rating", "nation")
    return C.collapse_tail(C.clip(e, "rating", hi=4), "nation", 20)


@register("c16_c17_keep_levels_recode", EMP + """
SELECT key, CASE WHEN nation IS NULL THEN NULL WHEN nation IN (1, 2, 3) THEN nation ELSE 99 END AS nation,
  coalesce(CASE priority WHEN '1-URGENT' THEN 'U' WHEN '2-HIGH' THEN 'H' END, priority) AS priority FROM emp
""")
def q_c16(spark, d):
    """Keep three levels, others -> one level (C16); dictionary recode (C17)."""
    e = entity(spark, d).select("key", "nation", "priority")
    e = C.keep_levels(e, "nation", [1, 2, 3], 99)
    return C.recode(e, "priority", {"1-URGENT": "U", "2-HIGH": "H"})


@register("c18_constant_columns", EMP + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{x}' AS \"column\" FROM train HAVING count(DISTINCT {x}) < 2"
    for x in ["key", "priority", "segment", "nation", "price", "acctbal", "rating", "edu", "yr", "y"]) +
          " UNION ALL SELECT 'part' FROM emp WHERE part = 'train' HAVING count(DISTINCT part) < 2)")
def q_c18(spark, d):
    """Columns with fewer than two distinct values (train rows keep the marker)."""
    e = entity(spark, d)
    return C.constant_columns(e.filter(F.col("part") == "train"))


@register("c19_high_null_columns", EMP + """,
st AS (SELECT key, priority, segment, nation, price, acctbal, rating, edu, yr, y FROM train
       UNION ALL SELECT key, priority, segment, nation, price, acctbal, rating, edu, yr, NULL FROM test)
SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT '{x}' AS \"column\", round(avg(CAST({x} IS NULL AS DOUBLE)), 6) AS null_share FROM st WHERE y IS NOT NULL"
    for x in ["key", "priority", "segment", "nation", "price", "acctbal", "rating", "edu", "yr", "y"]) +
          ") WHERE null_share > 0.08")
def q_c19(spark, d):
    """Columns whose null share on labelled rows exceeds 8 %."""
    tr, te = train_test(spark, d)
    st = U.stack_train_test(tr, te).drop("is_train")
    return C.high_null_columns(st, "y", 0.08)


C20_COLS = ['price', 'acctbal', 'rating', 'price_scaled', 'acct_neg', 'nation']


@register("c20_correlated_columns", EMP.replace("WITH ", "WITH RECURSIVE ", 1) + """,
x AS (SELECT price, acctbal, rating, price * 1.01 + 1 AS price_scaled, -acctbal AS acct_neg, nation FROM emp),
pr AS (SELECT 'price' AS a, 'acctbal' AS b, corr(price, acctbal) AS c FROM x UNION ALL SELECT 'price' AS a, 'rating' AS b, corr(price, rating) AS c FROM x UNION ALL SELECT 'price' AS a, 'price_scaled' AS b, corr(price, price_scaled) AS c FROM x UNION ALL SELECT 'price' AS a, 'acct_neg' AS b, corr(price, acct_neg) AS c FROM x UNION ALL SELECT 'price' AS a, 'nation' AS b, corr(price, nation) AS c FROM x UNION ALL SELECT 'acctbal' AS a, 'price' AS b, corr(acctbal, price) AS c FROM x UNION ALL SELECT 'acctbal' AS a, 'rating' AS b, corr(acctbal, rating) AS c FROM x UNION ALL SELECT 'acctbal' AS a, 'price_scaled' AS b, corr(acctbal, price_scaled) AS c FROM x UNION ALL SELECT 'acctbal' AS a, 'acct_neg' AS b, corr(acctbal, acct_neg) AS c FROM x UNION ALL SELECT 'acctbal' AS a, 'nation' AS b, corr(acctbal, nation) AS c FROM x UNION ALL SELECT 'rating' AS a, 'price' AS b, corr(rating, price) AS c FROM x UNION ALL SELECT 'rating' AS a, 'acctbal' AS b, corr(rating, acctbal) AS c FROM x UNION ALL SELECT 'rating' AS a, 'price_scaled' AS b, corr(rating, price_scaled) AS c FROM x UNION ALL SELECT 'rating' AS a, 'acct_neg' AS b, corr(rating, acct_neg) AS c FROM x UNION ALL SELECT 'rating' AS a, 'nation' AS b, corr(rating, nation) AS c FROM x UNION ALL SELECT 'price_scaled' AS a, 'price' AS b, corr(price_scaled, price) AS c FROM x UNION ALL SELECT 'price_scaled' AS a, 'acctbal' AS b, corr(price_scaled, acctbal) AS c FROM x UNION ALL SELECT 'price_scaled' AS a, 'rating' AS b, corr(price_scaled, rating) AS c FROM x UNION ALL SELECT 'price_scaled' AS a, 'acct_neg' AS b, corr(price_scaled, acct_neg) AS c FROM x UNION ALL SELECT 'price_scaled' AS a, 'nation' AS b, corr(price_scaled, nation) AS c FROM x UNION ALL SELECT 'acct_neg' AS a, 'price' AS b, corr(acct_neg, price) AS c FROM x UNION ALL SELECT 'acct_neg' AS a, 'acctbal' AS b, corr(acct_neg, acctbal) AS c FROM x UNION ALL SELECT 'acct_neg' AS a, 'rating' AS b, corr(acct_neg, rating) AS c FROM x UNION ALL SELECT 'acct_neg' AS a, 'price_scaled' AS b, corr(acct_neg, price_scaled) AS c FROM x UNION ALL SELECT 'acct_neg' AS a, 'nation' AS b, corr(acct_neg, nation) AS c FROM x UNION ALL SELECT 'nation' AS a, 'price' AS b, corr(nation, price) AS c FROM x UNION ALL SELECT 'nation' AS a, 'acctbal' AS b, corr(nation, acctbal) AS c FROM x UNION ALL SELECT 'nation' AS a, 'rating' AS b, corr(nation, rating) AS c FROM x UNION ALL SELECT 'nation' AS a, 'price_scaled' AS b, corr(nation, price_scaled) AS c FROM x UNION ALL SELECT 'nation' AS a, 'acct_neg' AS b, corr(nation, acct_neg) AS c FROM x),
cl AS (SELECT 1 AS idx, 'price' AS name UNION ALL SELECT 2 AS idx, 'acctbal' AS name UNION ALL SELECT 3 AS idx, 'rating' AS name UNION ALL SELECT 4 AS idx, 'price_scaled' AS name UNION ALL SELECT 5 AS idx, 'acct_neg' AS name UNION ALL SELECT 6 AS idx, 'nation' AS name),
g AS (SELECT 0 AS step, CAST([] AS VARCHAR[]) AS dropped
      UNION ALL
      SELECT g.step + 1, CASE WHEN list_contains(g.dropped, cl.name) THEN g.dropped
        ELSE list_distinct(list_concat(g.dropped, coalesce((SELECT list(pr.b) FROM pr WHERE pr.a = cl.name
             AND pr.c > 0.985 AND NOT list_contains(g.dropped, pr.b)), CAST([] AS VARCHAR[])))) END
      FROM g JOIN cl ON cl.idx = g.step + 1)
SELECT unnest(dropped) AS "column" FROM g WHERE step = 6
""")
def q_c20(spark, d):
    """Greedy drop, in column order, of one column of each pair with
    corr > 0.985 (the oracle walks the same order with a recursive CTE)."""
    e = entity(spark, d).withColumn("price_scaled", F.col("price") * 1.01 + 1) \
        .withColumn("acct_neg", -F.col("acctbal"))
    dropped = C.correlated_columns(e, C20_COLS)
    return spark.createDataFrame([(x,) for x in dropped], "column string")


@register("c21_low_variance", EMP + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{x}' AS \"column\", round(stddev_samp(CAST({x} AS DOUBLE)), 6) AS std FROM train"
    for x in ["price", "acctbal", "rating", "nation", "y"]) + ") WHERE std < 0.5")
def q_c21(spark, d):
    """Numeric columns whose std is below 0.5."""
    tr, _ = train_test(spark, d)
    return C.low_variance(tr, ["price", "acctbal", "rating", "nation", "y"], 0.5)


@register("c23_zscore_outliers", EMP + """,
s AS (SELECT avg(price) AS mp, stddev_samp(price) AS sp, avg(acctbal) AS ma, stddev_samp(acctbal) AS sa FROM emp)
SELECT key FROM emp CROSS JOIN s WHERE abs((price - mp) / sp) > 1.5 OR abs((acctbal - ma) / sa) > 1.5
""")
def q_c23(spark, d):
    """Rows with |z| > 1.5 in price or balance."""
    return P.zscore_outliers(entity(spark, d).select("key", "price", "acctbal"), ["price", "acctbal"], 1.5) \
        .select("key")


@register("e20_text_row_cleaner", EMP + """,
m AS (SELECT first(edu ORDER BY n DESC, edu) AS mode FROM (SELECT edu, count(*) AS n FROM train
      WHERE edu IS NOT NULL AND trim(edu) <> '' GROUP BY edu)),
f AS (SELECT e.key, CASE WHEN e.edu IS NULL OR trim(e.edu) = '' THEN m.mode ELSE e.edu END AS edu FROM emp e CROSS JOIN m),
c AS (SELECT edu AS level, CAST(row_number() OVER (ORDER BY min(key), edu) - 1 AS INTEGER) AS code FROM f GROUP BY edu)
SELECT f.key, c.code AS edu_code FROM f JOIN c ON f.edu = c.level
""")
def q_e20(spark, d):
    """Blank or null text -> the train mode, then codes by first appearance (C2 + E3)."""
    from tabfold.operators import encode as E
    e = entity(spark, d).select("key", "edu", "part")
    e = C.blank_to(e, "edu", None)
    fitted = C.fit_mode(e.where(F.col("part") == "train"), ["edu"])
    e = C.apply_fill(e, fitted, ["edu"])
    codes = E.fit_factorize(e, "edu", "key").select(F.col("level").alias("edu"), F.col("code").alias("edu_code"))
    return e.join(codes, "edu").select("key", "edu_code")


@register("f21_impute_scale_for_distances", EMP + """,
f AS (SELECT median(rating) AS med, avg(price) AS mp, stddev_pop(price) AS sp, avg(acctbal) AS ma,
             stddev_pop(acctbal) AS sa FROM train),
g AS (SELECT avg(coalesce(CAST(rating AS DOUBLE), med)) AS mr, stddev_pop(coalesce(CAST(rating AS DOUBLE), med)) AS sr
      FROM train CROSS JOIN f)
SELECT key, round((price - mp) / sp, 6) AS price, round((acctbal - ma) / sa, 6) AS acctbal,
       round((coalesce(CAST(rating AS DOUBLE), med) - mr) / sr, 6) AS rating FROM emp CROSS JOIN f CROSS JOIN g
""")
def q_f21(spark, d):
    """Median imputation then standard scaling (population std), all fitted on train."""
    from tabfold.operators import scale as K
    e = entity(spark, d).select("key", "price", "acctbal", "rating", "part")
    tr = e.where(F.col("part") == "train")
    med = C.fit_median(tr, ["rating"])
    e = C.apply_fill(e, med, ["rating"])
    tr = C.apply_fill(tr, med, ["rating"])
    cols = ["price", "acctbal", "rating"]
    return K.apply_scaler(e, K.fit_standard(tr, cols, ddof=0), cols, "standard").drop("part")
