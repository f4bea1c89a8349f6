"""Checked queries for sources and sinks (S): each writes the input to the
shared scratch folder through the library's writer and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabfold.operators import evaluate as V
from tabfold.plans.registry import register
from tabfold.sources import files as S
from tabfold.sources.tables import (ENTITY_SQL, SCORES_LONG_SQL, SCORES_WIDE_SQL, entity, scores_long,
                                    scores_wide, table, with_ctes)


@register("s1_s3_csv_roundtrip_nulls", with_ctes(ENTITY_SQL) + """
SELECT key, CASE WHEN edu IS NULL OR trim(edu) IN ('', 'NA') THEN NULL ELSE trim(edu) END AS edu,
       rating, price FROM emp
""")
def q_s1(spark, d):
    """Entity rows written as CSV, read back with a declared schema; blank or
    'NA' text -> NULL, whitespace trimmed."""
    e = entity(spark, d).select("key", F.concat(F.lit(" "), F.col("edu")).alias("edu"), "rating", "price")
    path = S.write_csv(e, S.scratch_path(spark, "s1"))
    return S.read_csv(spark, path, "key long, edu string, rating int, price double", null_values=("", "NA"),
                      trim=True)


@register("s4_s5_read_score_files", with_ctes(SCORES_LONG_SQL) + """
SELECT key, model, split, round(p, 6) AS p,
  CASE WHEN split = 'oof' THEN 'train_scores' ELSE 'test_scores' END AS family FROM sl
""")
def q_s4(spark, d):
    """One CSV folder per (model, split); a glob reads them all back into a
    long table; model, split and family come from the file path."""
    sl = scores_long(spark, d)
    root = S.scratch_path(spark, "s4")
    for m in ("m1", "m2", "m3"):
        for sp in ("oof", "test"):
            name = "train" if sp == "oof" else "test"
            S.write_csv(sl.where((F.col("model") == m) & (F.col("split") == sp)).select("key", "p"),
                        f"{root}/{m}_{name}_scores")
    df = S.read_scores(spark, f"{root}/*_scores", "key string, p double")
    df = df.withColumn("model", F.regexp_extract("file", r"/(m[0-9]+)_(train|test)_scores/", 1)) \
        .withColumn("split", F.when(F.col("file").contains("_train_"), "oof").otherwise("test"))
    df = S.tag_family(df, {"train_scores": "_train_scores", "test_scores": "_test_scores"})
    return df.select("key", "model", "split", "p", "family")


@register("s6_write_submission", with_ctes(SCORES_WIDE_SQL) + """
SELECT key, CAST(p_m1 > 0.3 AS INTEGER) AS is_positive FROM sw WHERE split = 'test'
""")
def q_s6(spark, d):
    """Key + 0/1 decision written as CSV part files, read back."""
    s = scores_wide(spark, d).where(F.col("split") == "test").withColumn("is_positive", V.decide("p_m1", 0.3))
    path = S.write_submission(s, S.scratch_path(spark, "s6"), "key", "is_positive")
    return S.read_csv(spark, path, "key string, is_positive int")


@register("s7_write_oof_partitioned", with_ctes(SCORES_LONG_SQL) + """
SELECT key, fold, round(p, 6) AS p, model, run FROM sl WHERE split = 'oof'
""")
def q_s7(spark, d):
    """OOF scores written as parquet partitioned by (model, run), read back."""
    s = scores_long(spark, d).where(F.col("split") == "oof").select("key", "fold", "p", "model", "run")
    root = S.write_oof(s, S.scratch_path(spark, "s7"))
    return spark.read.parquet(root).select("key", "fold", "p", "model", F.col("run").cast("int").alias("run"))


@register("s8_save_features", """
SELECT p_partkey, p_size, round(p_retailprice / p_size, 6) AS price_per_size FROM part
""")
def q_s8(spark, d):
    """An engineered feature table saved as parquet and reloaded."""
    p = table(spark, d, "part").select("p_partkey", "p_size",
                                       F.try_divide("p_retailprice", "p_size").alias("price_per_size"))
    return spark.read.parquet(S.save_features(p, S.scratch_path(spark, "s8")))
