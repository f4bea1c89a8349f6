"""Checked queries: feature selection by statistics (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabfold.operators import encode as E
from tabfold.operators import select as X
from tabfold.operators import setops as U
from tabfold.plans.registry import register
from tabfold.sources.tables import ENTITY_SQL, TEST_SQL, TRAIN_SQL, train_test, with_ctes

EMP = with_ctes(ENTITY_SQL, TRAIN_SQL, TEST_SQL)
FEATS = ["price", "acctbal", "rating", "nation"]


def _melt_sql(src: str, feats: list[str], y: str = "y") -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value, {y} AS y FROM {src} "
                              f"WHERE {f} IS NOT NULL" for f in feats)


RANKSUM_SQL = EMP + f""",
lg AS ({_melt_sql('train', FEATS)}),
c AS (SELECT feature, value, count(*) FILTER (WHERE y = 0) AS c0, count(*) FILTER (WHERE y = 1) AS c1,
             count(*) AS c FROM lg GROUP BY 1, 2),
r AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING
             AND 1 PRECEDING), 0) + (c + 1) / 2.0 AS ar FROM c),
s AS (SELECT feature, sum(c0 * ar) AS s, sum(c0) AS n0, sum(c1) AS n1 FROM r GROUP BY feature)"""


@register("x1_ranksum_z", RANKSUM_SQL + """
SELECT feature, CAST(n0 AS BIGINT) AS n0, CAST(n1 AS BIGINT) AS n1,
  round((s - n0 * (n0 + n1 + 1) / 2.0) / sqrt(n0 * n1 * (n0 + n1 + 1) / 12.0), 6) AS z FROM s
""")
def q_x1(spark, d):
    """Wilcoxon rank-sum z per feature (class 0 vs class 1), average ranks."""
    tr, _ = train_test(spark, d)
    return X.ranksum(tr, FEATS, "y").drop("p")


# erfc(x) for x > 0 in SQL (DuckDB has no erf): 1 - 2/sqrt(pi) e^(-x^2) sum_n x (2x^2)^n / (2n+1)!!,
# all terms positive (no cancellation), each in log space via lgamma; 300 terms cover |z| up to ~20.
ERFC_SQL = ("CASE WHEN {x} = 0 THEN 1.0 ELSE 1.0 - 2.0 / sqrt(pi()) * exp(-{x} * {x}) * (SELECT sum(exp(ln({x}) "
            "+ n * ln(2.0 * {x} * {x}) - lgamma(2 * n + 2) + n * ln(2.0) + lgamma(n + 1))) FROM range(0, 300) r(n)) END")


@register("x1b_ranksum_p", RANKSUM_SQL + """,
zz AS (SELECT feature, n0, n1, (s - n0 * (n0 + n1 + 1) / 2.0) / sqrt(n0 * n1 * (n0 + n1 + 1) / 12.0) AS z FROM s),
xx AS (SELECT *, abs(z) / sqrt(2.0) AS x FROM zz)
SELECT feature, CAST(n0 AS BIGINT) AS n0, CAST(n1 AS BIGINT) AS n1, round(z, 6) AS z,
  round(CASE WHEN n0 < 20 OR n1 < 20 THEN 2.0 ELSE """ + ERFC_SQL.format(x="xx.x") + """ END, 6) AS p FROM xx
""")
def q_x1b(spark, d):
    """Rank-sum z and two-sided p = erfc(|z| / sqrt 2) (pandas UDF with
    math.erfc; the oracle sums the erf series in SQL)."""
    tr, _ = train_test(spark, d)
    return X.ranksum(tr, FEATS, "y")


X2_FEATS = ["price", "acctbal", "rating", "nation", "is_top"]


@register("x2_class_difference", EMP + f""",
t2 AS (SELECT *, CAST(rating = 5 AS INTEGER) AS is_top FROM train),
lg AS ({_melt_sql('t2', X2_FEATS)}),
g AS (SELECT feature, avg(value) FILTER (WHERE y = 0) AS m0, avg(value) FILTER (WHERE y = 1) AS m1,
        median(value) FILTER (WHERE y = 0) AS d0, median(value) FILTER (WHERE y = 1) AS d1,
        count(*) FILTER (WHERE value NOT IN (0.0, 1.0)) AS non01, count(DISTINCT value) AS nd, avg(value) AS mu
      FROM lg GROUP BY feature)
SELECT feature, round(CASE WHEN non01 = 0 AND nd = 2 THEN abs(m0 - m1) ELSE abs(d0 - d1) END, 6) AS diff,
  round(abs((CASE WHEN non01 = 0 AND nd = 2 THEN abs(m0 - m1) ELSE abs(d0 - d1) END) / nullif(mu, 0)), 6) AS diff_norm
FROM g
""")
def q_x2(spark, d):
    """|mean diff| for 0/1 features, |median diff| otherwise, and its ratio to the mean."""
    tr, _ = train_test(spark, d)
    tr = tr.withColumn("is_top", (F.col("rating") == 5).cast("int"))
    return X.class_diff(tr, X2_FEATS, "y")


Z_CRIT = 1.9599639845400536  # two-sided normal quantile for alpha = 0.05: p > 0.05 <=> |z| < Z_CRIT


def _class_diff_sql(src: str, feats: list[str], mean_src: str | None = None) -> str:
    """(feature, diff, diff_norm) of ``class_diff`` over a CTE with a 0/1 ``y``."""
    ms = mean_src or src
    return f"""(SELECT g.feature, CASE WHEN non01 = 0 AND nd = 2 THEN abs(m0 - m1) ELSE abs(d0 - d1) END AS diff,
  abs((CASE WHEN non01 = 0 AND nd = 2 THEN abs(m0 - m1) ELSE abs(d0 - d1) END) / nullif(mu.mu, 0)) AS diff_norm
FROM (SELECT feature, avg(value) FILTER (WHERE y = 0) AS m0, avg(value) FILTER (WHERE y = 1) AS m1,
        median(value) FILTER (WHERE y = 0) AS d0, median(value) FILTER (WHERE y = 1) AS d1,
        count(*) FILTER (WHERE value NOT IN (0.0, 1.0)) AS non01, count(DISTINCT value) AS nd
      FROM ({_melt_sql(src, feats)}) WHERE y IS NOT NULL GROUP BY feature) g
JOIN (SELECT feature, avg(value) AS mu FROM ({_melt_sql(ms, feats)}) GROUP BY feature) mu ON g.feature = mu.feature)"""


def _ranksum_sql(src: str, feats: list[str]) -> str:
    """(feature, n0, n1, z) of ``ranksum`` over a CTE with a 0/1 ``y``."""
    return f"""(SELECT feature, n0, n1, (s - n0 * (n0 + n1 + 1) / 2.0) / sqrt(n0 * n1 * (n0 + n1 + 1) / 12.0) AS z
FROM (SELECT feature, sum(c0 * ar) AS s, sum(c0) AS n0, sum(c1) AS n1 FROM (
  SELECT *, coalesce(sum(c) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING
         AND 1 PRECEDING), 0) + (c + 1) / 2.0 AS ar FROM (
    SELECT feature, value, count(*) FILTER (WHERE y = 0) AS c0, count(*) FILTER (WHERE y = 1) AS c1,
           count(*) AS c FROM ({_melt_sql(src, feats)}) WHERE y IS NOT NULL GROUP BY 1, 2)) GROUP BY feature))"""


X3_FEATS = X2_FEATS + ["key_mod"]
X3_SRC = "t3 AS (SELECT *, CAST(rating = 5 AS INTEGER) AS is_top, key % 7 AS key_mod FROM train)"


@register("x3_drop_same_distribution", EMP + ",\n" + X3_SRC + f"""
SELECT d.feature, round(diff, 6) AS diff, round(diff_norm, 6) AS diff_norm,
  CASE WHEN diff = 0 AND NOT (n0 >= 20 AND n1 >= 20 AND abs(z) >= {Z_CRIT}) THEN 'no_difference'
       ELSE 'small_difference' END AS rule
FROM {_class_diff_sql('t3', X3_FEATS)} d JOIN {_ranksum_sql('t3', X3_FEATS)} r ON d.feature = r.feature
WHERE NOT (n0 >= 20 AND n1 >= 20 AND abs(z) >= {Z_CRIT}) AND (diff = 0 OR diff_norm < 0.5)
""")
def q_x3(spark, d):
    """Features with no class difference: (diff = 0 or diff_norm < 0.5) and
    rank-sum p > 0.05 (the oracle states p > 0.05 as |z| < 1.96)."""
    tr, _ = train_test(spark, d)
    tr = tr.withColumn("is_top", (F.col("rating") == 5).cast("int")).withColumn("key_mod", F.col("key") % 7)
    return X.same_distribution(tr, X3_FEATS, "y").select("feature", "diff", "diff_norm", "rule")


X4_FEATS = ["price", "acctbal", "rating", "nation", "yr", "yr_c"]
X4_SRC = ("st AS (SELECT key, price, acctbal, rating, nation, yr, yr - 1998 AS yr_c, y FROM train "
          "UNION ALL SELECT key, price, acctbal, rating, nation, yr, yr - 1998, NULL FROM test),\n"
          "mk AS (SELECT *, CAST(y IS NOT NULL AS INTEGER) AS lab FROM st),\n"
          "mk2 AS (SELECT * EXCLUDE (y), lab AS y FROM mk)")


@register("x4_train_test_drift", EMP + ",\n" + X4_SRC + f"""
SELECT d.feature, round(d.diff, 6) AS diff, round(d.diff_norm, 6) AS diff_norm, round(c.diff_norm, 6) AS class_diff_norm
FROM {_class_diff_sql('mk2', X4_FEATS)} d JOIN {_ranksum_sql('mk2', X4_FEATS)} r ON d.feature = r.feature
JOIN {_class_diff_sql('st', X4_FEATS, mean_src='st')} c ON d.feature = c.feature
WHERE n0 >= 20 AND n1 >= 20 AND abs(z) >= {Z_CRIT} AND d.diff_norm > 1 AND c.diff_norm = 0
""")
def q_x4(spark, d):
    """Features whose train and test distributions differ (p < 0.05, diff_norm > 1)
    while the labelled rows show no class difference (the year centred on 1998 drifts)."""
    tr, te = train_test(spark, d)
    st = U.stack_train_test(tr, te).drop("is_train").withColumn("yr_c", F.col("yr") - 1998)
    return X.drift_report(st, X4_FEATS, "y").select("feature", "diff", "diff_norm", "class_diff_norm")


IV_SQL = EMP + """,
lv AS (SELECT 'priority' AS feature, CAST(priority AS VARCHAR) AS level, y FROM train
       UNION ALL SELECT 'segment', segment, y FROM train
       UNION ALL SELECT 'nation', CAST(nation AS VARCHAR), y FROM train
       UNION ALL SELECT 'rating', CAST(rating AS VARCHAR), y FROM train),
g AS (SELECT feature, level, sum(CAST(y = 0 AS BIGINT)) AS ne, sum(CAST(y = 1 AS BIGINT)) AS ev FROM lv GROUP BY 1, 2),
t AS (SELECT sum(CAST(y = 0 AS BIGINT)) AS non, sum(CAST(y = 1 AS BIGINT)) AS evt FROM train),
iv AS (SELECT feature, sum((ne / non - ev / evt) * CASE WHEN ne > 0 AND ev > 0 THEN ln((ne / non) / (ev / evt))
       ELSE 0.0 END) AS iv FROM g CROSS JOIN t GROUP BY feature)"""


@register("x5_iv_filter", IV_SQL + "\nSELECT feature, round(iv, 6) AS iv FROM iv WHERE iv >= 0.0005 AND iv <= 0.8")
def q_x5(spark, d):
    """Keep features with 0.0005 <= IV <= 0.8 (explicit lower and upper bound)."""
    tr, _ = train_test(spark, d)
    iv = E.information_value(tr, ["priority", "segment", "nation", "rating"], "y").withColumnRenamed("column", "feature")
    return X.select_by_iv(iv, 0.0005, 0.8)


MI_FEATS = ["rating", "nation", "yr"]


@register("x7_mutual_information", EMP + f""",
lg AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value, y FROM train" for f in MI_FEATS)}),
j AS (SELECT feature, value, y, count(*) AS nxy FROM lg GROUP BY ALL),
nx AS (SELECT feature, value, sum(nxy) AS nx FROM j GROUP BY ALL),
ny AS (SELECT feature, y, sum(nxy) AS ny FROM j GROUP BY ALL),
n AS (SELECT feature, sum(nxy) AS n FROM j GROUP BY ALL)
SELECT j.feature, round(sum(nxy / n * ln(nxy * n / (nx * ny))), 6) AS mutual_info
FROM j JOIN nx ON j.feature = nx.feature AND j.value IS NOT DISTINCT FROM nx.value
JOIN ny ON j.feature = ny.feature AND j.y = ny.y JOIN n ON j.feature = n.feature GROUP BY j.feature
""")
def q_x7(spark, d):
    """Mutual information of discrete features with the label (null = a level)."""
    tr, _ = train_test(spark, d)
    return X.mutual_info(tr, MI_FEATS, "y")


def _psi_sql(x: str) -> str:
    """digamma of a whole number >= 1: recurrence up to 6, then the asymptotic series."""
    z = f"(CAST({x} AS DOUBLE) + 6)"
    less = " + ".join(f"1.0 / ({x} + {i})" for i in range(6))
    terms = " + ".join(f"{sign} / ({z} ** {power})" for sign, power in (("1.0 / 12", 2), ("-1.0 / 120", 4), ("1.0 / 252", 6), ("-1.0 / 240", 8), ("1.0 / 132", 10)))
    return f"(ln({z}) - 1.0 / (2 * {z}) - ({terms}) - ({less}))"


MIC_FEATS = ["price", "acctbal"]


@register("x7b_mutual_information_continuous", EMP + f""",
lg AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS v, y FROM train WHERE {f} IS NOT NULL AND y IS NOT NULL" for f in MIC_FEATS)}),
o AS (SELECT feature, v, y, count(*) OVER (PARTITION BY feature, y) AS nc,
        list_sort(list_filter([{", ".join(f"abs(v - {side}(v, {i}) OVER w)" for side in ("lag", "lead") for i in (1, 2, 3))}], lambda x: x IS NOT NULL))[3] AS r
      FROM lg WINDOW w AS (PARTITION BY feature, y ORDER BY v)),
m AS (SELECT a.feature, a.v, a.y, a.r, a.nc, any_value(a.times) AS times, count(*) AS m
      FROM (SELECT feature, v, y, r, nc, count(*) AS times FROM o GROUP BY ALL) a
      JOIN lg b ON a.feature = b.feature AND b.v > a.v - greatest(a.r, 1e-300) AND b.v < a.v + greatest(a.r, 1e-300)
      WHERE a.r > 0 GROUP BY a.feature, a.v, a.y, a.r, a.nc
      UNION ALL
      SELECT a.feature, a.v, a.y, a.r, a.nc, any_value(a.times), count(*)
      FROM (SELECT feature, v, y, r, nc, count(*) AS times FROM o GROUP BY ALL) a
      JOIN lg b ON a.feature = b.feature AND b.v = a.v WHERE a.r = 0 GROUP BY a.feature, a.v, a.y, a.r, a.nc)
SELECT feature, round(greatest(0.0, {_psi_sql("sum(times)")} + {_psi_sql("3")} - sum(times * {_psi_sql("nc")}) / sum(times) - sum(times * {_psi_sql("m")}) / sum(times)), 6) AS mutual_info
FROM m GROUP BY feature
""")
def q_x7b(spark, d):
    """Mutual information of continuous features with the label by nearest neighbours."""
    tr, _ = train_test(spark, d)
    return X.mutual_info_continuous(tr, MIC_FEATS, "y", k=3)


GINI_SQL = EMP + f""",
lg AS ({_melt_sql('train', FEATS)}),
sc AS (SELECT feature, value, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
       FROM lg GROUP BY 1, 2),
cum AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY feature ORDER BY value
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM sc),
gi AS (SELECT feature, 2 * sum(pos * (nb + neg * 0.5)) / (sum(pos) * sum(neg)) - 1 AS gini FROM cum GROUP BY 1)"""


@register("x8_feature_gini", GINI_SQL + "\nSELECT feature, round(gini, 6) AS gini FROM gi")
def q_x8(spark, d):
    """2 * AUC - 1 of every feature used alone as a score."""
    tr, _ = train_test(spark, d)
    return X.feature_gini(tr, FEATS, "y")


@register("x12_top_k_features", GINI_SQL + "\nSELECT feature, round(gini, 6) AS gini FROM gi ORDER BY gini DESC, feature LIMIT 2")
def q_x12(spark, d):
    """The two features with the highest gini (a top-k report)."""
    tr, _ = train_test(spark, d)
    return X.top_k(X.feature_gini(tr, FEATS, "y"), "gini", 2)


@register("p27_corr_on_balanced_sample", EMP + """,
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(key AS VARCHAR) || '42'), key) - 1 AS rk FROM train),
m AS (SELECT count(*) AS nmin FROM train WHERE y = 1),
s AS (SELECT r.* FROM r CROSS JOIN m WHERE y = 1 OR rk < round(nmin * 1.0))
""" + " UNION ALL ".join(f"SELECT '{x}' AS \"column\", round(corr({x}, y), 6) AS corr FROM s" for x in FEATS))
def q_p27(spark, d):
    """Correlation with the label after 1:1 undersampling (R1 then P26)."""
    from tabfold.operators import profile as P
    from tabfold.operators import sampling as R
    tr, _ = train_test(spark, d)
    return P.corr_with(R.undersample(tr, "y", "key", ratio=1.0), FEATS, "y")
