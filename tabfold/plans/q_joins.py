"""Checked queries for the joins of fitted tables (JO1-JO8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabfold.operators import joins as JO
from tabfold.plans.registry import register
from tabfold.sources.tables import (ENTITY_SQL, SCORES_LONG_SQL, TEST_SQL, TRAIN_SQL, entity, scores_long,
                                    table, train_test, with_ctes)

EMP = with_ctes(ENTITY_SQL, TRAIN_SQL, TEST_SQL)


@register("jo1_jo2_lookup_with_default", EMP + """,
t1 AS (SELECT nation, avg(price) AS nation_price FROM train GROUP BY nation),
t2 AS (SELECT segment, priority, count(*) AS pair_n FROM train GROUP BY segment, priority)
SELECT e.key, round(coalesce(t1.nation_price, -1.0), 6) AS nation_price, coalesce(t2.pair_n, 0) AS pair_n
FROM test e LEFT JOIN t1 ON e.nation = t1.nation LEFT JOIN t2 ON e.segment = t2.segment AND e.priority = t2.priority
""")
def q_jo1(spark, d):
    """Per-level tables from train attached to test rows (one and two keys);
    unknown levels get a default."""
    tr, te = train_test(spark, d)
    t1 = tr.groupBy("nation").agg(F.avg("price").alias("nation_price"))
    t2 = tr.groupBy("segment", "priority").agg(F.count(F.lit(1)).alias("pair_n"))
    x = JO.lookup(te, t1, "nation", {"nation_price": -1.0})
    x = JO.lookup(x, t2, ["segment", "priority"], {"pair_n": 0}, max_rows=10_000)
    return x.select("key", "nation_price", "pair_n")


@register("jo3_join_group_stats_suffix", EMP + """,
st AS (SELECT segment, min(acctbal) AS mn, max(acctbal) AS mx FROM emp GROUP BY segment)
SELECT e.key, round(st.mn, 6) AS mn_segment, round(st.mx, 6) AS mx_segment FROM emp e LEFT JOIN st USING (segment)
""")
def q_jo3(spark, d):
    """Group statistics joined back with a name suffix."""
    e = entity(spark, d)
    st = e.groupBy("segment").agg(F.min("acctbal").alias("mn"), F.max("acctbal").alias("mx"))
    return JO.join_group_stats(e.select("key", "segment"), st, "segment", "_segment").drop("segment")


@register("jo4_parent_child_counts", EMP + """,
c AS (SELECT segment, edu, count(*) AS n_child FROM emp GROUP BY segment, edu),
p AS (SELECT segment, count(*) AS n_parent FROM emp GROUP BY segment)
SELECT c.segment, c.edu, n_child, n_parent FROM c JOIN p USING (segment)
""")
def q_jo4(spark, d):
    """Counts per (segment, edu) joined to counts per segment."""
    e = entity(spark, d)
    c = e.groupBy("segment", "edu").agg(F.count(F.lit(1)).alias("n_child"))
    p = e.groupBy("segment").agg(F.count(F.lit(1)).alias("n_parent"))
    return c.join(p, "segment")


@register("jo5_inner_feature_join", EMP + """,
r AS (SELECT DISTINCT ON (nation) nation, n_name FROM emp JOIN nation ON emp.nation = nation.n_nationkey ORDER BY nation)
SELECT key, e.nation, n_name FROM emp e JOIN r USING (nation)
""")
def q_jo5(spark, d):
    """Inner join on the key after de-duplicating the right side."""
    e = entity(spark, d).select("key", "nation")
    right = e.join(table(spark, d, "nation"), e.nation == F.col("n_nationkey")).select("nation", "n_name")
    return JO.join_features(e, right, "nation").select("key", "nation", "n_name")


@register("jo6_flag_if_in", with_ctes(ENTITY_SQL) + """
SELECT key, CAST(key IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS INTEGER) AS has_return FROM emp
""")
def q_jo6(spark, d):
    """0/1 flag: does the order have a returned line item (semi-join)."""
    e = entity(spark, d).select("key")
    r = table(spark, d, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("key"))
    return JO.flag_if_in(e, r, "key", "has_return")


@register("jo7_align_scores_by_key", with_ctes(SCORES_LONG_SQL) + """
SELECT key, round(max(p) FILTER (WHERE model = 'm1'), 6) AS m1, round(max(p) FILTER (WHERE model = 'm2'), 6) AS m2,
       round(max(p) FILTER (WHERE model = 'm3'), 6) AS m3 FROM sl WHERE split = 'test' GROUP BY key
""")
def q_jo7(spark, d):
    """Model scores side by side, aligned by key (never by row position)."""
    s = scores_long(spark, d).where(F.col("split") == "test")
    return JO.align_scores(s, models=["m1", "m2", "m3"])
