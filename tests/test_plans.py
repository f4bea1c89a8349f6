"""Plan-shape checks: the properties the design relies on at scale."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as se
from tabfold.functions.exprs import order_hash
from tabfold.functions.ranking import hashed_rank
from tabfold.operators import encode as E
from tabfold.session import cut_lineage
from tabfold.sources.tables import entity

from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fitted_table_join_is_a_checked_broadcast(spark):
    plan = _plan(se.queries()["e12_target_encode_smoothed"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan  # the big side is never shuffled to meet a fitted table


def test_scans_read_only_needed_columns(spark):
    df = se.queries()["e12_target_encode_smoothed"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # orders is read for key, customer and the train filter only; no text or price columns
    assert "o_orderpriority" not in plan and "o_totalprice" not in plan
    assert "c_name" not in plan and "c_acctbal" not in plan


def test_train_filter_reaches_the_scan(spark):
    e = entity(spark, SF_SMALL)
    plan = e.where(F.col("price") > 100000).select("key")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,100000.0)" in plan.replace(
        "IsNotNull(o_custkey), ", "")


def test_ranks_never_use_an_unpartitioned_window_over_rows(spark):
    df = spark.range(1000).select(F.col("id").alias("key")).withColumn("h", order_hash("key", 1))
    plan = _plan(hashed_rank(df, "h", tiebreak="key"))
    windows = [ln for ln in plan.splitlines() if ln.strip().lstrip("+-:* ").startswith("Window [")]
    assert len(windows) == 2
    # the row_number over the rows is partitioned by the md5 sub-bucket; the
    # only other window runs over the per-bucket counts (<= 16**prefix rows)
    assert any("row_number()" in w and "], [_hbucket" in w for w in windows)
    assert any("sum(_n" in w for w in windows)


def test_onehot_of_many_levels(spark):
    df = spark.range(4500).select((F.col("id") % 1500).cast("string").alias("c"))
    assert len(E.fit_onehot(df, ["c"])["c"]) == 1500
    v = E.sparse_onehot(df, ["c"]).transform(df).first()["onehot"]
    assert v.size == 1500 and v.numNonzeros() == 1


def test_no_row_at_a_time_python_udf_in_headline_plans(spark):
    import bench
    qs = se.queries()
    for name in bench.HEADLINE:
        if name == "m15_cv_oof_scores":
            continue  # reads its checkpointed result back
        plan = _plan(qs[name](spark, SF_SMALL))
        assert "BatchEvalPython" not in plan, name


def test_hot_key_is_spread_over_many_tasks(spark):
    """One key holds a third of all rows: the rank helper's sub-buckets and the
    range partitions behind running sums both split it, so no task holds it."""
    from tabfold.functions.ranking import range_partition
    n = 30000
    df = spark.range(n).select(F.col("id").alias("key"),
                               F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(
                                   (F.col("id") % 97).cast("string")).alias("g"))
    # hashed_rank: rows per (group, md5 sub-bucket) window partition
    x = df.withColumn("h", order_hash("key", 1))
    per_bucket = x.groupBy("g", F.conv(F.substring("h", 1, 4), 16, 10).alias("b")).count()
    assert per_bucket.where("g = 'HOT'").agg(F.max("count")).first()[0] <= 10  # of 10,000 hot rows
    # prefix sums / quantiles: range partitions over (group, value)
    r = range_partition(df, [F.col("g"), F.col("key")], ranges=16)
    shares = r.where("g = 'HOT'").groupBy("_rid").count().toPandas()
    assert len(shares) >= 4 and shares["count"].max() <= 0.5 * (n // 3)


@pytest.mark.parametrize("accuracy", [2000, 2])
def test_quantiles_pin_brackets_alone(spark, monkeypatch, accuracy):
    """Exact for continuous, tied and hot values, null and NaN groups, far probabilities; only
    the brackets' values are written, unless a sketch is too coarse, which costs a second count."""
    from tabfold.functions import ranking

    pinned = []
    monkeypatch.setattr(ranking, "pin_partitions", lambda df: pinned.append((x := cut_lineage(df)).count()) or x)
    if accuracy == 2:  # brackets beside the quantile: the check must see it
        monkeypatch.setattr(ranking.F, "percentile_approx", lambda x, ps, a: F.array(*[F.max(x) for _ in ps]))
    rng = np.random.default_rng(1)
    n = 40_000
    rows = pd.DataFrame({"g": rng.choice(["hot", "hot", "hot", "a", "b"], n), "x": rng.normal(size=n), "y": np.where(rng.random(n) < 0.4, 3.0, rng.integers(0, 50, n)).astype(float)})
    rows.loc[rng.random(n) < 0.1, "g"] = None
    rows.loc[rng.random(n) < 0.1, "x"] = None
    df = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), "g string, x double, y double")
    probs = [0.0, 0.001, 0.25, 0.5, 0.99, 1.0] if accuracy == 2000 else [0.25, 0.5, 0.99]
    got = {(r.g, r.column): [r[f"q{i}"] for i in range(len(probs))] for r in ranking.quantiles(df, ["x", "y"], probs, by=["g"]).collect()}
    for g in ("hot", "a", "b", None):
        part = rows[rows.g.isna()] if g is None else rows[rows.g == g]
        for c in "xy":
            np.testing.assert_allclose(got[g, c], part[c].quantile(probs).to_numpy(), rtol=0, atol=1e-12)
    assert len(got) == 8
    if accuracy == 2000:
        assert len(pinned) == 1 and pinned[0] < 0.05 * n
    else:
        assert len(pinned) == 2
