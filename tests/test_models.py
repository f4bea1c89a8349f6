"""Invariants for the MLlib-edge operators (no SQL oracle: fitted models)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabfold.operators import evaluate as V
from tabfold.operators import models as M
from tabfold.plans.q_models import model_frames
from tabfold.sources.tables import entity, scores_long

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def frames(spark):
    tr, te, feats = model_frames(spark, SF_SMALL)
    return tr.persist(), te.persist(), feats


def test_oof_covers_each_train_key_once(spark, frames):
    tr, te, feats = frames
    oof, test, met = M.cv_oof("logistic", tr, te, feats, "y", "key")
    o = oof.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("fold").alias("f"))
    assert o.count() == tr.count()
    assert o.where("n != 1").count() == 0
    own = tr.select("key", F.col("fold").alias("f0"))
    assert o.join(own, "key").where("f != f0").count() == 0
    assert test.count() == te.count()
    assert met.count() == 5
    assert oof.where("p < 0 OR p > 1").count() == 0


def test_stack_level2_keys_once(spark):
    s = scores_long(spark, SF_SMALL)
    o2, t2, met = M.stack(s.where("split = 'oof'"), s.where("split = 'test'"), ["m1", "m2", "m3"], "y")
    assert o2.count() == o2.select("key").distinct().count() == s.where("split = 'oof' AND model = 'm1'").count()
    assert t2.count() == s.where("split = 'test' AND model = 'm1'").count()


def test_model_imputation_leaves_no_nulls(spark):
    e = entity(spark, SF_SMALL).select("key", "rating", (F.col("price") / 1000).alias("p"), "nation",
                                      F.when(F.col("key") % 7 == 0, None).otherwise(F.col("acctbal")).alias("a"))
    a = M.fill_by_model(e, "rating", ["p", "nation"], numTrees=5, maxDepth=3, seed=1)
    assert a.count() == e.count() and a.where("rating IS NULL").count() == 0
    b = M.forest_impute(e, ["rating", "a"], ["p", "nation"], "key", max_iter=2, numTrees=5, maxDepth=3, seed=1)
    assert b.count() == e.count() and b.where("rating IS NULL OR a IS NULL").count() == 0
    kept = b.join(e.where("a IS NOT NULL").select("key", F.col("a").alias("a0")), "key")
    assert kept.where("abs(a - a0) > 1e-9").count() == 0  # observed values untouched


def test_discriminants_separate_separable_classes(spark):
    rng = np.random.default_rng(0)
    n = 400
    y = rng.integers(0, 2, n)
    x1 = rng.normal(size=n) + 3 * y
    x2 = rng.normal(size=n) - 2 * y
    df = spark.createDataFrame(pd.DataFrame({"key": np.arange(n), "x1": x1, "x2": x2, "y": y}))
    for quad in (False, True):
        s = M.discriminant_score(M.fit_discriminant(df, ["x1", "x2"], "y", quadratic=quad), df, ["key"])
        s = s.join(df.select("key", "y"), "key")
        assert V.auc(s, "y", "p").first()["auc"] > 0.95


def test_grid_and_rounds_tables(spark, frames):
    tr, _, feats = frames
    g = M.grid_search("tree", tr, feats, "y", {"maxDepth": [2, 3]}, metric="auc")
    assert g.count() == 2
    r = M.best_rounds(tr.withColumn("valid", F.col("fold") == 0), feats, "y", "valid", max_iter=5, maxDepth=2)
    assert r.count() == 5 and r.where("is_best").count() == 1


def test_importance_table_percent_sums_to_100(spark, frames):
    tr, _, feats = frames
    ms = [M.fit("tree", tr.where(F.col("fold") != k), feats, "y", maxDepth=3) for k in range(2)]
    t = M.importance_table(ms, feats, spark).toPandas()
    assert abs(t["pct"].sum() - 100) < 1e-6
    assert set(t["feature"]) == set(feats)


def test_adaboost_weights_and_scores(spark, frames):
    tr, te, feats = frames
    ens, _ = M.adaboost(tr.select("key", "y", *feats), feats, "y", "key", rounds=3)
    assert 1 <= len(ens) <= 3 and all(a > 0 for _, a in ens)
    s = M.adaboost_score(ens, te, "key")
    assert s.count() == te.count() and s.where("p <= 0 OR p >= 1").count() == 0


def test_cutoff_metric_equals_the_sweep(frames):
    tr, _, feats = frames
    grid = M.grid_search("tree", tr, feats, "y", {"maxDepth": [3]}, cutoff=0.4).first()["f1"]
    best = M.grid_search("tree", tr, feats, "y", {"maxDepth": [3]}, cutoff="best").first()["f1"]
    fixed, free = [], []
    for k in range(5):
        m = M.fit("tree", tr.where(F.col("fold") != k), feats, "y", maxDepth=3)
        s = M.score(m, tr.where(F.col("fold") == k), ["key", "y"])
        fixed.append(V.f1_at(s, "y", "p", 0.4).first()["f1"] or 0.0)
        free.append(V.best_cutoff(V.sweep(s, "y", "p", 0.0, 0.01, 101)).first()["f1"])
    assert grid == pytest.approx(np.mean(fixed)) and best == pytest.approx(np.mean(free)) and best >= grid


def test_best_rounds_over_folds_and_refit(frames):
    tr, te, feats = frames
    table, model = M.best_rounds_cv(tr, feats, "y", max_iter=4, maxDepth=2, seed=1)
    rows = table.collect()
    best = [r for r in rows if r["is_best"]]
    assert len(rows) == 4 and len(best) == 1 and best[0]["valid_loss"] == min(r["valid_loss"] for r in rows)
    assert model.stages[-1].getNumTrees == best[0]["rounds"]
    assert M.score(model, te, "key").count() == te.count()


def test_forest_impute_mixed(spark):
    """A null text and a null number are filled in one call, close to the truth; a column
    without any value, repeated rows and NaN have defined results."""
    import numpy as np

    rng = np.random.default_rng(4)
    rows, truth = [], {}
    for i in range(900):
        g = int(rng.integers(3))
        x, n, t = float(g * 10 + rng.normal()), int(g * 100 + rng.integers(5)), "abc"[g]
        truth[i] = (n, t)
        rows.append((i, x, None if i % 9 == 1 else n, None if i % 7 == 2 else t, None, None, float("nan") if i == 5 else x))
    df = spark.createDataFrame(rows, "id int, x double, n int, t string, empty double, none string, z double")
    out = M.forest_impute_mixed(df, ["x", "n", "empty", "z"], ["t", "none"], max_iter=4, numTrees=10, maxDepth=4, seed=1)
    assert out.schema.simpleString() == df.schema.simpleString()
    got = {r.id: r for r in out.collect()}
    assert len(got) == 900 and all(r.empty is None and r.none is None for r in got.values())
    for i, x, n, t, *_ in rows:
        r = got[i]
        assert r.x == x and (r.n == n if n is not None else abs(r.n - truth[i][0]) < 30) and r.t == truth[i][1]
    assert abs(got[5].z - rows[5][1]) < 10
    filled = M.fill_by_model(df.drop("z", "empty", "none"), "t", ["x"], numTrees=10, maxDepth=3, seed=1)
    filled = filled.collect()  # histogram bins may straddle two clusters
    assert len(filled) == 900 and sum(r.t == truth[r.id][1] for r in filled) > 0.98 * 900
    assert M.fill_by_model(df, "empty", ["x"]).where("empty is not null").count() == 0
    assert M.forest_impute_mixed(df.where("false"), ["n"], ["t"]).count() == 0
    assert M.forest_impute(df.select("id", "x", "n", "empty"), ["n", "empty"], ["x"], "id", max_iter=1, numTrees=3, maxDepth=2).where("n is null or empty is not null").count() == 0
    with pytest.raises(ValueError):
        M.level_codes(df, "t", max_levels=2)


@pytest.mark.parametrize("loss", ["modified_huber", "squared_hinge", "log"])
def test_linear_losses_reach_the_numpy_optimum(spark, loss):
    """Weights and objective against slow proximal-gradient steps in NumPy, rows weighted,
    with zero weights where the L1 part puts them."""
    from tabfold.operators.linear import LOSSES, fit_linear

    rng = np.random.default_rng(2)
    n, d, alpha, ratio = 400, 4, 0.05, 0.5
    x = rng.normal(size=(n, d)) * [1, 2, 0.5, 1]
    y = (x @ [1.0, -0.5, 0.0, 0.0] + rng.normal(size=n) > 0.3).astype(int)
    weight = rng.integers(1, 4, n).astype(float)
    df = spark.createDataFrame([(*map(float, r), int(t), float(v)) for r, t, v in zip(x, y, weight)] + [(None, 1.0, 1.0, 1.0, 1, 1.0), (1.0, float("nan"), 1.0, 1.0, 0, 1.0)], "a double, b double, c double, e double, y int, w double")
    m = fit_linear(df, ["a", "b", "c", "e"], "y", loss, alpha, ratio, weight="w")
    a, s, share = np.c_[x, np.ones(n)], 2 * y - 1, weight / weight.sum()
    value = lambda v: share @ LOSSES[loss](s * (a @ v))[0] + alpha * (ratio * np.abs(v[:d]).sum() + (1 - ratio) / 2 * (v[:d] ** 2).sum())
    v, t = np.zeros(d + 1), 1 / (2 * np.linalg.eigvalsh(a.T @ (a * share[:, None]))[-1] + alpha)
    for _ in range(20_000):
        v = v - t * (a.T @ (share * LOSSES[loss](s * (a @ v))[1] * s) + alpha * (1 - ratio) * np.r_[v[:d], 0])
        v[:d] = np.sign(v[:d]) * np.maximum(np.abs(v[:d]) - t * alpha * ratio, 0)
    got = np.r_[m.weights, m.intercept]
    assert abs(value(got) - value(v)) < 1e-6 and np.abs(got - v).max() < 1e-3 and m.passes < 30
    assert (got[:d] == 0).tolist() == (np.abs(v[:d]) < 1e-9).tolist()
    p = df.select(m.probability().alias("p")).where("p is not null and not isnan(p)").collect()
    assert all(0 <= r.p <= 1 for r in p)
    with pytest.raises(ValueError):
        fit_linear(df.where("false"), ["a"], "y", loss)
    numeric = lambda z: (LOSSES[loss](z + 1e-6)[0] - LOSSES[loss](z - 1e-6)[0]) / 2e-6
    z = np.array([-3.0, -0.5, 0.2, 0.9, 1.7])
    np.testing.assert_allclose(numeric(z), LOSSES[loss](z)[1], atol=1e-5)


def test_random_search_honours_all_its_arguments(spark, frames):
    """A generous time limit changes no score, with and without folds; a spent one leaves the first point."""
    from tabfold.operators import sampling as R

    tr, _, feats = frames
    tr = R.with_weight(tr, "y", "balanced")
    space, how = {"maxDepth": [1, 3]}, dict(seed=2, metric="f1", cutoff=0.3, weight="weight")
    for fold in ("fold", None):
        free = M.random_search("tree", tr, feats, "y", space, 2, fold=fold, **how).collect()
        assert M.random_search("tree", tr, feats, "y", space, 2, fold=fold, max_seconds=1e6, **how).collect() == free
    assert M.random_search("tree", tr, feats, "y", space, 2, max_seconds=0.0, **how).count() == 1


def test_percent_of_models_without_a_split_is_null(spark):
    df = spark.createDataFrame([(i, 1.0, i % 2) for i in range(20)], "key long, x double, y int")
    t = M.importance_table([M.fit("tree", df, ["x"], "y", maxDepth=2)], ["x"], spark)
    assert [tuple(r) for r in t.collect()] == [("x", 0.0, None)]


@pytest.mark.parametrize("what", ["grid", "random", "compare", "forward", "rounds", "rounds_cv", "permute", "oof"])
def test_input_of_many_fits_is_computed_once(spark, what):
    """A UDF counts how often the rows of the input are computed."""
    n, seen = 60, spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    rng = np.random.default_rng(2)
    rows = [(i, float(x), float(z), int(x + e > 0), i % 3) for i, (x, z, e) in enumerate(rng.normal(size=(n, 3)))]
    df = spark.createDataFrame(rows, "key long, x double, z double, y int, fold int").withColumn("x", counted("x"))
    feats, train, valid = ["x", "z"], df.where("fold != 0"), df.where("fold = 0")
    if what == "grid":
        M.grid_search("tree", df, feats, "y", {"maxDepth": [1, 2]}).collect()
    elif what == "random":
        M.random_search("tree", df, feats, "y", {"maxDepth": [1, 2]}, 2, fold="fold").collect()
    elif what == "compare":
        M.compare_learners(train, valid, feats, "y", {"tree": {"maxDepth": 2}, "naive_bayes": {"modelType": "gaussian"}}).collect()
    elif what == "forward":
        M.forward_select("tree", train, valid, feats, "y", maxDepth=2).collect()
    elif what == "rounds":
        M.best_rounds(df.withColumn("v", F.col("fold") == 0), feats, "y", "v", max_iter=2, maxDepth=1).collect()
    elif what == "rounds_cv":
        M.best_rounds_cv(df, feats, "y", max_iter=2, maxDepth=1)
    elif what == "permute":
        model = M.fit("tree", df.select("y", F.col("key").cast("double").alias("x"), "z"), feats, "y", maxDepth=2)
        M.permutation_importance(model, df, feats, "y", "key").collect()
    else:
        for out in M.cv_oof("tree", df, None, feats, "y", "key", maxDepth=2)[::2]:
            out.collect()
    assert seen.value == n


def test_columns_permuted_together_equal_one_at_a_time(spark):
    df = spark.createDataFrame([(i, i * 10, i * 100) for i in range(50)], "key long, a long, b long")
    both = {r["key"]: r for r in M.permute_columns(df, ["a", "b"], "key", 3).collect()}
    for c, times in (("a", 10), ("b", 100)):
        one = {r["key"]: r[c] for r in M.permute_column(df, c, "key", 3).collect()}
        assert one == {k: r[f"_perm_{c}"] for k, r in both.items()}
        assert sorted(one.values()) == [i * times for i in range(50)] and one != {i: i * times for i in range(50)}


def test_scores_side_by_side_equal_a_pivot_with_one_shuffle(spark):
    long = spark.createDataFrame([(k, m, (k + 1) / (j + 2)) for k in range(30) for j, m in enumerate(["m1", "m2", "m3"]) if (k + j) % 4],
                                 "key long, model string, p double")
    wide = M._one_column_per_model(long, ["key"], ["m1", "m2"])
    want = long.groupBy("key").pivot("model", ["m1", "m2"]).agg(F.first("p"))
    assert wide.columns == want.columns and sorted(map(str, wide.collect())) == sorted(map(str, want.collect()))
    assert [x._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") for x in (wide, want)] == [1, 2]
