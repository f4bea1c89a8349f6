"""Checked queries: projections (J), set operations (U), profiling (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabfold.operators import columns as J
from tabfold.operators import profile as P
from tabfold.operators import setops as U
from tabfold.plans.registry import register
from tabfold.sources.tables import (ENTITY_SQL, TEST_SQL, TRAIN_SQL, entity, table, train_test,
                                    with_ctes)

EMP = with_ctes(ENTITY_SQL, TRAIN_SQL, TEST_SQL)
NUM = ["price", "acctbal", "rating", "nation"]
TXT = ["priority", "segment", "edu"]


# ------------------------------------------------------------------ J

@register("j1_rename_sanitize_cast", """
SELECT c_custkey AS cust_key, c_name AS "customer_name_", CAST(c_nationkey AS TINYINT) AS nation,
       round(CAST(CAST(CAST(c_acctbal AS FLOAT) AS VARCHAR) AS DOUBLE), 6) AS balance_pct_,
       TRY_CAST(substr(c_name, strpos(c_name, '#') + 1) AS INTEGER) AS name_number
FROM customer
""")
def q_j1(spark, d):
    """Rename to awkward names, sanitise them, select, downcast, parse numbers."""
    cu = table(spark, d, "customer")
    x = J.rename(cu, {"c_custkey": "cust_key", "c_name": "customer name?", "c_acctbal": "balance %"})
    x = J.sanitize(x)
    x = x.withColumn("name_number", F.substring_index(F.col("customer_name_"), "#", -1))
    x = J.to_numeric(x, ["name_number"], "int")
    x = J.cast_cols(x, {"c_nationkey": "tinyint", "balance__": "float"})
    x = J.rename(x, {"c_nationkey": "nation", "balance__": "balance_pct_"})
    x = J.drop_cols(x, ["c_mktsegment"])
    return J.select_cols(x, ["cust_key", "customer_name_", "nation", "balance_pct_", "name_number"])


@register("j7_filter_masks", EMP + """
SELECT key FROM emp WHERE (rating IS NULL AND edu IS NOT NULL)
  OR (price BETWEEN 100000 AND 150000 AND NOT segment = 'BUILDING')
""")
def q_j7(spark, d):
    """Compound null / range / negated masks."""
    e = entity(spark, d)
    m = (F.col("rating").isNull() & F.col("edu").isNotNull()) | (
        F.col("price").between(100000, 150000) & ~(F.col("segment") == "BUILDING"))
    return e.where(m).select("key")


@register("j9_drop_rows_with_values", EMP + """
SELECT key, nation, rating FROM emp
WHERE NOT coalesce(nation IN (0, 24), false) AND NOT coalesce(rating IN (5), false)
""")
def q_j9(spark, d):
    """Drop rows whose value never occurs elsewhere; NULL rows are kept."""
    return J.drop_rows(entity(spark, d), {"nation": [0, 24], "rating": [5]}).select("key", "nation", "rating")


@register("j10_drop_any_null", EMP + "SELECT key, rating, edu FROM emp WHERE rating IS NOT NULL AND edu IS NOT NULL")
def q_j10(spark, d):
    """Complete cases only."""
    return J.drop_any_null(entity(spark, d).select("key", "rating", "edu"))


@register("j12_coerce_numeric", """
SELECT p_partkey, TRY_CAST(p_brand AS INTEGER) AS brand_raw,
       TRY_CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS brand_no,
       TRY_CAST(regexp_extract(p_name, '[0-9]+') AS BIGINT) AS name_no
FROM part
""")
def q_j12(spark, d):
    """Text that does not parse becomes NULL instead of failing (F1 extract)."""
    p = table(spark, d, "part")
    x = p.select("p_partkey", F.col("p_brand").alias("brand_raw"),
                 F.regexp_extract("p_brand", r"[0-9]+", 0).alias("brand_no"),
                 F.regexp_extract("p_name", r"[0-9]+", 0).alias("name_no"))
    x = J.to_numeric(x, ["brand_raw", "brand_no"], "int")
    return J.to_numeric(x, ["name_no"], "bigint")


@register("j13_head_ordered", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20
""")
def q_j13(spark, d):
    """First 20 rows by price desc (the limit is the feature: a top-k report)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return J.head(o, 20, [F.col("o_totalprice").desc(), "o_orderkey"])


# ------------------------------------------------------------------ U

@register("u1_stack_train_test", EMP + """
SELECT key, segment, y, 1 AS is_train FROM train UNION ALL SELECT key, segment, NULL, 0 FROM test
""")
def q_u1(spark, d):
    """Stack train and test by name; the test label is NULL; marker column."""
    tr, te = train_test(spark, d)
    return U.stack_train_test(tr.select("key", "segment", "y"), te.select("key", "segment"))


@register("u2_split_by_marker", EMP + "SELECT key, segment FROM test")
def q_u2(spark, d):
    """Undo the stack: the test part."""
    tr, te = train_test(spark, d)
    st = U.stack_train_test(tr.select("key", "segment", "y"), te.select("key", "segment"))
    return U.split_by_marker(st)[1].drop("y")


@register("u3_is_subset", EMP + """
SELECT count(*) AS n_missing, count(*) = 0 AS is_subset FROM (
  SELECT DISTINCT key FROM emp WHERE edu IS NULL
  EXCEPT SELECT DISTINCT key FROM emp WHERE rating IS NULL)
""")
def q_u3(spark, d):
    """Is every key with null text also a key with null rating?"""
    e = entity(spark, d)
    return U.is_subset(e.where(F.col("edu").isNull()), e.where(F.col("rating").isNull()), "key")


@register("u4_level_diff", EMP + "SELECT DISTINCT yr FROM train WHERE yr IS NOT NULL EXCEPT SELECT DISTINCT yr FROM test")
def q_u4(spark, d):
    """Levels in train but not in test."""
    tr, te = train_test(spark, d)
    return U.level_diff(tr, te, "yr")


@register("u5_drop_duplicates", EMP + "SELECT DISTINCT segment, priority FROM emp")
def q_u5(spark, d):
    """Distinct lookup rows."""
    return U.distinct_rows(entity(spark, d).select("segment", "priority"))


# ------------------------------------------------------------------ P

@register("p1_shape", EMP + "SELECT count(*) AS n_rows, 11 AS n_cols FROM emp")
def q_p1(spark, d):
    """Row and column count."""
    return P.shape(entity(spark, d)).withColumn("n_cols", F.col("n_cols").cast("int"))


def _describe_sql(src: str, cols: list[str]) -> str:
    parts = []
    for x in cols:
        v = f"CAST({x} AS DOUBLE)"
        parts.append(
            f"SELECT '{x}' AS \"column\", CAST(count({v}) AS DOUBLE) AS \"count\", round(avg({v}), 6) AS mean, "
            f"round(stddev_samp({v}), 6) AS std, round(min({v}), 6) AS min, "
            f"round(quantile_cont({v}, 0.25), 6) AS q25, round(quantile_cont({v}, 0.5), 6) AS q50, "
            f"round(quantile_cont({v}, 0.75), 6) AS q75, round(max({v}), 6) AS max FROM {src}")
    return "\nUNION ALL ".join(parts)


@register("p2_describe_numeric", EMP + _describe_sql("train", NUM))
def q_p2(spark, d):
    """count/mean/std/min/quartiles/max of numeric columns in one pass."""
    tr, _ = train_test(spark, d)
    return P.describe(tr, NUM)


@register("p3_describe_strings", EMP + ",\n" + ",\n".join(
    f"v_{x} AS (SELECT CAST({x} AS VARCHAR) AS value, count(*) AS n FROM train WHERE {x} IS NOT NULL GROUP BY 1)"
    for x in TXT) + "\n" + "\nUNION ALL ".join(
    f"SELECT '{x}' AS \"column\", sum(n)::BIGINT AS \"count\", count(*) AS \"unique\", "
    f"first(value ORDER BY n DESC, value) AS top, max(n) AS freq FROM v_{x}" for x in TXT))
def q_p3(spark, d):
    """count/unique/top/freq of text columns."""
    tr, _ = train_test(spark, d)
    return P.describe_strings(tr, TXT)


EMP_TYPES = [("key", "bigint"), ("priority", "string"), ("segment", "string"), ("nation", "int"),
             ("price", "double"), ("acctbal", "double"), ("rating", "int"), ("edu", "string"),
             ("yr", "int"), ("y", "int"), ("part", "string")]


@register("p4_schema_report", EMP + "\nUNION ALL ".join(
    f"SELECT '{n}' AS \"column\", '{t}' AS dtype, count({n}) AS non_null FROM emp" for n, t in EMP_TYPES))
def q_p4(spark, d):
    """dtype and non-null count per column."""
    return P.schema_report(entity(spark, d))


@register("p5_null_report", EMP + "\nUNION ALL ".join(
    f"SELECT '{n}' AS \"column\", CAST(sum(CAST({n} IS NULL AS BIGINT)) AS BIGINT) AS nulls, "
    f"round(sum(CAST({n} IS NULL AS BIGINT)) * 100.0 / count(*), 6) AS pct FROM emp" for n, _ in EMP_TYPES))
def q_p5(spark, d):
    """Null count and percent per column."""
    return P.null_report(entity(spark, d))


@register("p8_null_columns", EMP + "SELECT * FROM (" + "\nUNION ALL ".join(
    f"SELECT '{n}' AS \"column\" FROM emp HAVING sum(CAST({n} IS NULL AS BIGINT)) > 0" for n, _ in EMP_TYPES) + ")")
def q_p8(spark, d):
    """Columns with any null."""
    return P.null_columns(entity(spark, d))


@register("p6_blank_report", EMP + "\nUNION ALL ".join(
    f"SELECT '{x}' AS \"column\", CAST(coalesce(sum(CAST(trim({x}) = '' AS BIGINT)), 0) AS BIGINT) AS blanks FROM emp"
    for x in TXT))
def q_p6(spark, d):
    """Blank strings per text column."""
    return P.blank_report(entity(spark, d), TXT)


@register("p7_key_unique", EMP + "SELECT count(*) AS n_rows, count(DISTINCT key) AS n_keys, "
          "count(*) = count(DISTINCT key) AS \"unique\" FROM emp")
def q_p7(spark, d):
    """Distinct keys equal row count."""
    return P.is_unique(entity(spark, d), "key")


@register("p9_null_patterns", EMP + "SELECT CAST(rating IS NULL AS INTEGER) AS rating_missing, "
          "CAST(edu IS NULL AS INTEGER) AS edu_missing, count(*) AS n FROM emp GROUP BY 1, 2")
def q_p9(spark, d):
    """Frequency of each combination of missing columns."""
    return P.null_patterns(entity(spark, d), ["rating", "edu"])


@register("p10_nunique", EMP + "\nUNION ALL ".join(
    f"SELECT '{n}' AS \"column\", count(DISTINCT {n}) AS nunique FROM emp" for n, _ in EMP_TYPES))
def q_p10(spark, d):
    """Distinct values per column."""
    return P.nunique(entity(spark, d))


@register("p11_unique_values", EMP + "SELECT DISTINCT edu FROM emp")
def q_p11(spark, d):
    """Distinct values of a column (NULL and blank included)."""
    return P.uniques(entity(spark, d), "edu")


@register("p12_value_counts", EMP + "SELECT edu, count(*) AS n, round(count(*) / (SELECT count(*) FROM emp), 6) "
          "AS share FROM emp GROUP BY edu")
def q_p12(spark, d):
    """Count and share per value, NULL kept as a value."""
    return P.value_counts(entity(spark, d), "edu", dropna=False)


@register("p13_class_balance", EMP + "SELECT y, count(*) AS n, round(count(*) / (SELECT count(*) FROM train), 6) "
          "AS share FROM train GROUP BY y")
def q_p13(spark, d):
    """Share of each label value on train."""
    tr, _ = train_test(spark, d)
    return P.class_balance(tr, "y")


@register("p14_share_of_parent", EMP + """
SELECT segment, priority, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY segment), 6) AS pct_of_parent
FROM emp GROUP BY segment, priority
""")
def q_p14(spark, d):
    """Percent of each (segment, priority) inside its segment."""
    return P.share_of_parent(entity(spark, d), "segment", "priority")


@register("p15_group_size", EMP + "SELECT segment, priority, yr, count(*) AS n FROM emp GROUP BY 1, 2, 3")
def q_p15(spark, d):
    """Group sizes over three keys."""
    return P.group_size(entity(spark, d), ["segment", "priority", "yr"])


@register("p16_group_means", EMP + "SELECT segment, " + ", ".join(
    f"round(avg({x}), 6) AS mean_{x}" for x in NUM) + " FROM emp GROUP BY segment")
def q_p16(spark, d):
    """Mean of every numeric column per segment."""
    return P.group_means(entity(spark, d), "segment", NUM)


@register("p17_conditional_means", EMP + "SELECT y, " + ", ".join(
    f"round(avg({x}), 6) AS mean_{x}" for x in NUM) + " FROM train GROUP BY y")
def q_p17(spark, d):
    """Mean of every numeric column for y=1 and y=0."""
    tr, _ = train_test(spark, d)
    return P.group_means(tr, "y", NUM)


@register("p18_event_rate", EMP + "SELECT nation, count(*) AS n, round(avg(y) * 100, 6) AS event_rate "
          "FROM train GROUP BY nation")
def q_p18(spark, d):
    """Event rate (percent) per level."""
    tr, _ = train_test(spark, d)
    return P.event_rate(tr, "nation", "y")


PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _crosstab_sql(norm: bool) -> str:
    cells = []
    for p in PRIOS + ["All"]:
        cond = "true" if p == "All" else f"priority = '{p}'"
        v = f"count(*) FILTER (WHERE {cond})"
        cells.append(f"round({v} / count(*), 6) AS \"{p}\"" if norm else f"{v} AS \"{p}\"")
    body = ", ".join(cells)
    return (EMP + f"SELECT segment, {body} FROM emp GROUP BY segment\n"
            f"UNION ALL SELECT 'All' AS segment, {body} FROM emp")


@register("p19_crosstab_margins", _crosstab_sql(False))
def q_p19(spark, d):
    """segment x priority counts with All margins (one cube pass + pivot)."""
    return P.crosstab(entity(spark, d), "segment", "priority", PRIOS, margins=True)


@register("p20_crosstab_row_share", _crosstab_sql(True))
def q_p20(spark, d):
    """Row shares of the crosstab."""
    return P.crosstab(entity(spark, d), "segment", "priority", PRIOS, margins=True, normalize="row")


@register("p21_pivot_mean", EMP + "SELECT y, " + ", ".join(
    f"round(avg(price) FILTER (WHERE rating = {r}), 6) AS \"{r}\"" for r in range(1, 6)) +
          " FROM train WHERE rating IS NOT NULL GROUP BY y")
def q_p21(spark, d):
    """Mean price for label x rating (levels found by the pivot)."""
    tr, _ = train_test(spark, d)
    return P.pivot_mean(tr.where(F.col("rating").isNotNull()), "y", "rating", "price")


@register("p22_filtered_value_count", EMP + "SELECT rating, y, count(*) AS n FROM train GROUP BY rating, y")
def q_p22(spark, d):
    """Label counts per rating value."""
    tr, _ = train_test(spark, d)
    return P.group_size(tr, ["rating", "y"])


@register("p23_count_where", EMP + "SELECT segment, count(*) FILTER (WHERE price > 200000) AS n_true, "
          "count(*) AS n, round(avg(CAST(price > 200000 AS DOUBLE)), 6) AS share FROM emp GROUP BY segment")
def q_p23(spark, d):
    """Count and share of rows meeting a predicate, per segment."""
    return P.count_where(entity(spark, d), F.col("price") > 200000, by="segment")


@register("p24_null_driven_check", EMP + "SELECT DISTINCT yr FROM emp WHERE rating IS NULL")
def q_p24(spark, d):
    """Distinct years where the rating is null."""
    e = entity(spark, d)
    return P.uniques(e.where(F.col("rating").isNull()), "yr")


CORR_COLS = ["price", "acctbal", "rating", "nation", "y"]


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(CORR_COLS):
        for j, b in enumerate(CORR_COLS):
            v = "1.0" if a == b else f"round(corr({a}, {b}), 6)"
            src = "" if a == b else " FROM train"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {v} AS corr{src}")
    return EMP + "\nUNION ALL ".join(parts)


@register("p25_corr_matrix", _corr_sql())
def q_p25(spark, d):
    """Pearson correlation of all pairs in one aggregation pass."""
    tr, _ = train_test(spark, d)
    return P.corr_matrix(tr, CORR_COLS)


@register("p26_corr_with_label", EMP + "\nUNION ALL ".join(
    f"SELECT '{x}' AS \"column\", round(corr({x}, y), 6) AS corr FROM train" for x in NUM))
def q_p26(spark, d):
    """Correlation of each column with the label, sorted."""
    tr, _ = train_test(spark, d)
    return P.corr_with(tr, NUM, "y")


def _skew_sql(cols):
    parts = []
    for x in cols:
        parts.append(
            f"SELECT '{x}' AS \"column\", round(m3 / pow(m2, 1.5), 6) AS skew, round(abs(m3 / pow(m2, 1.5)), 6) "
            f"AS abs_skew FROM (SELECT avg(pow(v - mu, 2)) AS m2, avg(pow(v - mu, 3)) AS m3 FROM "
            f"(SELECT CAST({x} AS DOUBLE) AS v, avg(CAST({x} AS DOUBLE)) OVER () AS mu FROM train WHERE {x} IS NOT NULL))")
    return "\nUNION ALL ".join(parts)


@register("p28_skewness", EMP + _skew_sql(["price", "acctbal", "rating"]))
def q_p28(spark, d):
    """Population skewness per column (moment form in the oracle)."""
    tr, _ = train_test(spark, d)
    return P.skewness(tr, ["price", "acctbal", "rating"])


@register("p29_box_summary", EMP + """,
q AS (SELECT segment, min(price) AS min, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median,
             quantile_cont(price, 0.75) AS q3, max(price) AS max, count(price) AS n FROM emp GROUP BY segment),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_fence, q3 + 1.5 * (q3 - q1) AS hi_fence FROM q)
SELECT f.segment, round(min, 6) AS min, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(max, 6) AS max, n, round(lo_fence, 6) AS lo_fence, round(hi_fence, 6) AS hi_fence,
  (SELECT count(*) FROM emp e WHERE e.segment = f.segment AND (e.price < f.lo_fence OR e.price > f.hi_fence)) AS outliers
FROM f
""")
def q_p29(spark, d):
    """Five numbers, IQR fences and outlier counts per segment."""
    return P.box_summary(entity(spark, d), "price", by="segment")


@register("p30_histogram", EMP + """,
b AS (SELECT y, CASE WHEN acctbal < -1000 THEN 0 WHEN acctbal >= 10000 THEN 11
        ELSE floor(10 * (acctbal - -1000) / (10000 - -1000)) + 1 END AS bin FROM train WHERE acctbal IS NOT NULL),
g AS (SELECT y, CAST(bin AS BIGINT) AS bin, count(*) AS n FROM b GROUP BY 1, 2)
SELECT y, bin, n, round(n / sum(n) OVER (PARTITION BY y) / 1100.0, 6) AS density FROM g
""")
def q_p30(spark, d):
    """Fixed-width histogram with density, per class."""
    tr, _ = train_test(spark, d)
    return P.histogram(tr, "acctbal", -1000.0, 10000.0, 10, by="y")


@register("p31_category_by_class", EMP + """
SELECT segment, y, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY segment), 6)
  AS pct_in_level FROM train GROUP BY segment, y
""")
def q_p31(spark, d):
    """Counts per (level, class) and class share inside each level."""
    tr, _ = train_test(spark, d)
    return P.cat_by_class(tr, "segment", "y")


@register("p32_compare_train_test", EMP + """
SELECT part, priority, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY part), 6)
  AS pct_of_parent FROM emp GROUP BY part, priority
""")
def q_p32(spark, d):
    """The same level report on train and test side by side (marker in the key)."""
    return P.share_of_parent(entity(spark, d), "part", "priority")
