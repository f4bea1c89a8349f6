"""Grouped queries over a group column with NULLs (``rating`` of the entity
table): rows of the NULL group are kept as a group of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabfold.operators import clean as C
from tabfold.operators import evaluate as V
from tabfold.operators import profile as P
from tabfold.operators import sampling as R
from tabfold.plans.registry import register
from tabfold.sources.tables import ENTITY_SQL, TRAIN_SQL, entity, train_test

EMP = "WITH " + ENTITY_SQL + ",\n" + TRAIN_SQL
P_SQL = "(acctbal + 1000.0) / 11000.0"
SC = EMP + f", sc AS (SELECT rating, y, {P_SQL} AS p FROM train)"
COUNTS = SC + """,
v AS (SELECT rating, p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM sc GROUP BY 1, 2),
c AS (SELECT rating, p, pos, neg, sum(pos) OVER (PARTITION BY rating ORDER BY p DESC) AS tp,
             sum(neg) OVER (PARTITION BY rating ORDER BY p DESC) AS fp,
             sum(pos) OVER (PARTITION BY rating) AS tot_pos, sum(neg) OVER (PARTITION BY rating) AS tot_neg FROM v)
"""


def scored(spark, d):
    """Train rows with the score ``(acctbal + 1000) / 11000``."""
    return train_test(spark, d)[0].select("rating", "y", ((F.col("acctbal") + 1000.0) / 11000.0).alias("p"))


@register("r8n_split_by_nullable", EMP + """,
r AS (SELECT key, rating, row_number() OVER (PARTITION BY rating ORDER BY md5(CAST(key AS VARCHAR) || '42'), key) - 1 AS rk,
             count(*) OVER (PARTITION BY rating) AS n FROM train)
SELECT key, rating, CASE WHEN rk < round(n * 0.7) THEN '0' ELSE '1' END AS part FROM r
""")
def q_r8n(spark, d):
    """70/30 split inside each rating, NULL included."""
    tr, _ = train_test(spark, d)
    return R.split(tr.select("key", "rating"), "key", [0.7, 0.3], by="rating")


@register("c5n_forward_fill_nullable_group", EMP + """,
g AS (SELECT key, rating, CASE WHEN key % 4 = 0 THEN price END AS v FROM emp)
SELECT key, rating, round(last_value(v IGNORE NULLS) OVER (PARTITION BY rating ORDER BY key
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS v FROM g
""")
def q_c5n(spark, d):
    """Forward fill in key order inside each rating, NULL included."""
    e = entity(spark, d).select("key", "rating", F.when(F.col("key") % 4 == 0, F.col("price")).alias("v"))
    return C.ffill(e, ["v"], ["key"], by="rating", ranges=6)


@register("p12n_value_counts_dropna", EMP + """,
x AS (SELECT edu, rating FROM emp WHERE edu IS NOT NULL AND rating IS NOT NULL)
SELECT edu, rating, count(*) AS n, round(count(*) / (SELECT count(*) FROM x), 6) AS share FROM x GROUP BY 1, 2
""")
def q_p12n(spark, d):
    """Counts of pairs without rows that have any NULL."""
    return P.value_counts(entity(spark, d), ["edu", "rating"], dropna=True)


@register("p30n_histogram_nullable_group", EMP + """,
b AS (SELECT rating, CASE WHEN acctbal < -1000 THEN 0 WHEN acctbal >= 10000 THEN 6
        ELSE floor(5 * (acctbal - -1000) / (10000 - -1000)) + 1 END AS bin FROM emp WHERE acctbal IS NOT NULL),
g AS (SELECT rating, CAST(bin AS BIGINT) AS bin, count(*) AS n FROM b GROUP BY 1, 2)
SELECT rating, bin, n, round(n / sum(n) OVER (PARTITION BY rating) / 2200.0, 6) AS density FROM g
""")
def q_p30n(spark, d):
    """Histogram per rating, NULL included."""
    return P.histogram(entity(spark, d), "acctbal", -1000.0, 10000.0, 5, by="rating")


@register("v7n_sweep_nullable_group", SC + """,
cuts AS (SELECT 0.05 + i * 0.1 AS cutoff FROM range(10) t(i)),
g AS (SELECT s.rating, c.cutoff, count(*) FILTER (WHERE p > cutoff AND y = 1) AS tp, count(*) FILTER (WHERE p > cutoff AND y = 0) AS fp,
             count(*) FILTER (WHERE p <= cutoff AND y = 0) AS tn, count(*) FILTER (WHERE p <= cutoff AND y = 1) AS fn
      FROM sc s CROSS JOIN cuts c GROUP BY 1, 2)
SELECT rating, round(cutoff, 6) AS cutoff, tp, fp, tn, fn FROM g
""")
def q_v7n(spark, d):
    """Cutoff sweep per rating, NULL included."""
    return V.sweep(scored(spark, d), "y", "p", 0.05, 0.1, 10, by="rating").select("rating", "cutoff", "tp", "fp", "tn", "fn")


@register("v12n_roc_points_nullable_group", COUNTS + """
SELECT rating, round(p, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       round(CASE WHEN tot_neg > 0 THEN fp / tot_neg END, 6) AS fpr, round(CASE WHEN tot_pos > 0 THEN tp / tot_pos END, 6) AS tpr FROM c
""")
def q_v12n(spark, d):
    """ROC points per rating, NULL included."""
    return V.roc_points(scored(spark, d), "y", "p", by="rating")


@register("v13n_pr_points_nullable_group", COUNTS + """
SELECT rating, round(p, 6) AS threshold, round(tp / (tp + fp), 6) AS precision,
       round(CASE WHEN tot_pos > 0 THEN tp / tot_pos END, 6) AS recall FROM c
""")
def q_v13n(spark, d):
    """Precision and recall per rating, NULL included."""
    return V.pr_points(scored(spark, d), "y", "p", by="rating")


@register("v15n_battery_nullable_group", COUNTS + """,
au AS (SELECT rating, round(sum(pos * (tot_neg - fp + neg * 0.5)) / (max(tot_pos) * max(tot_neg)), 6) AS roc_auc FROM c GROUP BY 1),
m AS (SELECT rating, count(*) FILTER (WHERE p > 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p > 0.5 AND y = 0) AS fp,
             count(*) FILTER (WHERE p <= 0.5 AND y = 1) AS fn FROM sc GROUP BY 1)
SELECT m.rating, round(tp / (tp + fp), 6) AS precision_1, round(tp / (tp + fn), 6) AS recall_1, roc_auc
FROM m JOIN au ON m.rating IS NOT DISTINCT FROM au.rating
""")
def q_v15n(spark, d):
    """Battery per rating, NULL included."""
    return V.battery(scored(spark, d), "y", "p", 0.5, by="rating").select("rating", "precision_1", "recall_1", "roc_auc")
