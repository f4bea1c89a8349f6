"""Readers for the parquet tables and the stand-in inputs built from them.

The stand-ins only give rows the schema the reference's jobs expect (an
entity table with a 0/1 label, nullable columns, a train/test marker; a long
table of model scores). They do none of the jobs' work. For each Spark
builder the same rows are written as SQL (``*_SQL``) for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------------------
# Entity table: orders joined to customers, shaped like the reference's
# employee table (key, categories, numbers, nullable rating / text, label).
# ---------------------------------------------------------------------------

def entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    cu = table(spark, sf_dir, "customer")
    j = o.join(cu, o.o_custkey == cu.c_custkey, "inner")
    return j.select(
        F.col("o_orderkey").alias("key"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nation"),
        F.col("o_totalprice").alias("price"),
        F.col("c_acctbal").alias("acctbal"),
        F.when(F.col("o_custkey") % 13 == 0, F.lit(None))
         .otherwise((F.col("o_orderkey") % 5 + 1).cast("int")).alias("rating"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit(None))
         .when(F.col("o_orderkey") % 17 == 0, F.lit(""))
         .otherwise(F.col("o_orderpriority")).alias("edu"),
        F.year("o_orderdate").cast("int").alias("yr"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        F.when(F.year("o_orderdate") < 2000, "train").otherwise("test").alias("part"),
    )


ENTITY_SQL = """
emp AS (
  SELECT o.o_orderkey AS key, o.o_orderpriority AS priority, c.c_mktsegment AS segment,
         c.c_nationkey AS nation, o.o_totalprice AS price, c.c_acctbal AS acctbal,
         CASE WHEN o.o_custkey % 13 = 0 THEN NULL ELSE CAST(o.o_orderkey % 5 + 1 AS INTEGER) END AS rating,
         CASE WHEN o.o_orderkey % 11 = 0 THEN NULL WHEN o.o_orderkey % 17 = 0 THEN ''
              ELSE o.o_orderpriority END AS edu,
         CAST(year(o.o_orderdate) AS INTEGER) AS yr,
         CAST(o.o_orderstatus = 'F' AS INTEGER) AS y,
         CASE WHEN year(o.o_orderdate) < 2000 THEN 'train' ELSE 'test' END AS part
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""


def train_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labelled train rows and unlabelled test rows (no ``y`` column)."""
    e = entity(spark, sf_dir)
    return (e.filter(F.col("part") == "train").drop("part"),
            e.filter(F.col("part") == "test").drop("part", "y"))


TRAIN_SQL = "train AS (SELECT * EXCLUDE (part) FROM emp WHERE part = 'train')"
TEST_SQL = "test AS (SELECT * EXCLUDE (part, y) FROM emp WHERE part = 'test')"

# ---------------------------------------------------------------------------
# Scores: one row per line item, label l_returnflag = 'R', three "models"
# whose probabilities are fixed linear mixes of line item columns.
# ---------------------------------------------------------------------------

# Fixed weights (discount, tax, line number) of the stand-in models.
MODEL_WEIGHTS = {"m1": (10.0, 5.0, 0.1), "m2": (5.0, 10.0, 0.05), "m3": (8.0, 2.0, 0.12)}


def _p(w) -> F.Column:
    a, b, d = w
    return ((F.col("l_discount") * a + F.col("l_tax") * b + F.col("l_linenumber") * d) / 3.0)


def line_key() -> F.Column:
    """Unique line-item key: md5 text of its integer columns (order, line
    number, part, supplier, quantity) -- (order, line) alone repeats in this
    data."""
    txt = F.concat_ws("|", *[F.col(x).cast("string") for x in ("l_orderkey", "l_linenumber", "l_partkey",
                                                                "l_suppkey")],
                      F.col("l_quantity").cast("bigint").cast("string"))
    return F.md5(txt)


LINE_KEY_SQL = ("md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
                "CAST(l_quantity AS BIGINT)))")


def scores_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        line_key().alias("key"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        *[_p(w).alias(f"p_{m}") for m, w in MODEL_WEIGHTS.items()],
        F.when(F.year("l_shipdate") < 2000, "oof").otherwise("test").alias("split"),
        F.pmod(F.col("l_orderkey"), F.lit(5)).cast("int").alias("fold"),
    )


def _p_sql(w) -> str:
    # literals as DOUBLE: a bare 0.1 is a DECIMAL in DuckDB and would round differently
    a, b, d = (f"CAST({v!r} AS DOUBLE)" for v in w)
    return f"((l_discount * {a} + l_tax * {b} + l_linenumber * {d}) / CAST(3.0 AS DOUBLE))"


SCORES_WIDE_SQL = (
    "sw AS (SELECT " + LINE_KEY_SQL + " AS key, CAST(l_returnflag = 'R' AS INTEGER) AS y, "
    + ", ".join(f"{_p_sql(w)} AS p_{m}" for m, w in MODEL_WEIGHTS.items())
    + ", CASE WHEN year(l_shipdate) < 2000 THEN 'oof' ELSE 'test' END AS split"
    + ", CAST(l_orderkey % 5 AS INTEGER) AS fold FROM lineitem)")


def scores_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(key, split, model, run, fold, y, p)``: the long score table."""
    w = scores_wide(spark, sf_dir)
    models = list(MODEL_WEIGHTS)
    return w.select("key", "split", "fold", "y", F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("p")) for m in models]))
    ).select("key", "split", "model", F.lit(1).alias("run"), "fold", "y", "p")


SCORES_LONG_SQL = SCORES_WIDE_SQL + ",\nsl AS (" + " UNION ALL ".join(
    f"SELECT key, split, '{m}' AS model, 1 AS run, fold, y, p_{m} AS p FROM sw" for m in MODEL_WEIGHTS) + ")"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(x.strip() for x in ctes) + "\n"
