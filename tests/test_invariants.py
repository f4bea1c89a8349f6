"""Hand-made fixtures and invariants: brute force on tiny inputs, fit/apply
separation, fold balance, rank helpers against row_number / pandas."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabfold.functions.exprs import order_hash
from tabfold.functions.ranking import hashed_rank, prefix_sums
from tabfold.operators import clean as C
from tabfold.operators import encode as E
from tabfold.operators import ensemble as B
from tabfold.operators import evaluate as V
from tabfold.operators import features as FE
from tabfold.operators import neighbors as N
from tabfold.operators import sampling as R
from tabfold.operators import select as X


@pytest.fixture(scope="module")
def employees(spark):
    """8 rows: a null education, a null rating, a blank, a level seen only in test."""
    rows = [
        (1, "Sales", "Bachelor's", 3, 1, "train"), (2, "Sales", None, 5, 0, "train"),
        (3, "Tech", "Master's", None, 1, "train"), (4, "Tech", "Bachelor's", 4, 0, "train"),
        (5, "Legal", "", 2, 0, "train"), (6, "Tech", "Bachelor's", 3, 1, "train"),
        (7, "Ops", "Master's", 1, None, "test"), (8, "Sales", "Below", 2, None, "test"),
    ]
    return spark.createDataFrame(rows, "id long, dept string, edu string, rating int, y int, part string")


def test_fill_mode_fitted_on_train_applied_to_all(spark, employees):
    tr = employees.where("part = 'train'")
    fitted = C.fit_mode(tr, ["edu", "rating"])
    out = {r["id"]: r for r in C.apply_fill(employees, fitted).collect()}
    assert out[2]["edu"] == "Bachelor's"  # most frequent on train
    assert out[3]["rating"] == 3
    assert all(r["edu"] is not None for r in out.values())


def test_onehot_aligns_unseen_level_to_zeros(spark, employees):
    lv = E.fit_onehot(employees.where("part = 'train'"), ["dept"])
    te = E.apply_onehot(employees.where("part = 'test'"), lv)
    row = {r["id"]: r for r in te.collect()}
    assert row[7]["dept_Legal"] == 0 and row[7]["dept_Sales"] == 0 and row[7]["dept_Tech"] == 0
    assert row[8]["dept_Sales"] == 1
    tr = E.apply_onehot(employees.where("part = 'train'"), lv)
    sums = tr.select(sum(F.col(f"dept_{v}") for v in lv["dept"]).alias("s")).collect()
    assert all(r["s"] == 1 for r in sums)


def test_label_codes_sorted_and_null_code(spark, employees):
    fitted = E.fit_label(employees.where("part = 'train'"), ["edu"])
    codes = {r["level"]: r["code"] for r in fitted.collect()}
    assert codes == {"": 0, "Bachelor's": 1, "Master's": 2}
    out = {r["id"]: r["edu"] for r in E.apply_label(employees, fitted, ["edu"], null_code=-1).collect()}
    assert out[2] == -1 and out[8] == -1 and out[1] == 1


@pytest.fixture(scope="module")
def scores6(spark):
    """6 scores with ties."""
    return spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.9), (3, 1, 0.5), (4, 0, 0.5), (5, 0, 0.2), (6, 1, 0.1)],
                                 "key long, y int, p double")


def _brute_auc(pdf):
    pos = pdf[pdf.y == 1].p.values
    neg = pdf[pdf.y == 0].p.values
    s = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def test_auc_with_ties_matches_pairwise_count(spark, scores6):
    got = V.auc(scores6, "y", "p").first()["auc"]
    assert got == pytest.approx(_brute_auc(scores6.toPandas()))


def test_auc_undefined_for_single_class(spark, scores6):
    assert V.auc(scores6.where("y = 0"), "y", "p").first()["auc"] is None


@pytest.mark.parametrize("inclusive", [False, True])
def test_sweep_equals_brute_force(spark, scores6, inclusive):
    sw = {round(r["cutoff"], 9): r for r in V.sweep(scores6, "y", "p", 0.0, 0.1, 11, inclusive=inclusive).collect()}
    pdf = scores6.toPandas()
    for i in range(11):
        c = 0.0 + i * 0.1
        pred = (pdf.p >= c) if inclusive else (pdf.p > c)
        tp = int(((pdf.y == 1) & pred).sum())
        fp = int(((pdf.y == 0) & pred).sum())
        r = sw[round(c, 9)]
        assert (r["tp"], r["fp"]) == (tp, fp), c


def test_best_cutoff_first_on_ties(spark):
    t = spark.createDataFrame([(0.1, 0.5), (0.2, 0.7), (0.3, 0.7), (0.4, 0.6)], "cutoff double, f1 double")
    assert V.best_cutoff(t).first()["cutoff"] == 0.2


def test_woe_zero_cell(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("b", 0), ("b", 1), ("c", 1), ("c", 0)], "lvl string, y int")
    share = {r["level"]: r["woe"] for r in E.fit_woe(df, "lvl", "y").collect()}
    odds = {r["level"]: r["woe"] for r in E.fit_woe(df, "lvl", "y", kind="odds").collect()}
    assert share["a"] == 0.0  # zero events: infinite -> 0
    assert odds["a"] is None  # guarded
    assert odds["b"] == pytest.approx(0.0)


def test_blends_of_three_scores(spark):
    long = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2), (1, "c", 0.4)], "key long, model string, p double")
    assert B.blend(long, "mean").first()["p_blend"] == pytest.approx(0.2333333, abs=1e-6)
    assert B.blend(long, "gmean").first()["p_blend"] == pytest.approx(0.2, abs=1e-9)
    assert B.blend(long, "hmean").first()["p_blend"] == pytest.approx(0.1714286, abs=1e-6)


def test_knn_points_on_a_line_exclude_self(spark):
    pts = spark.createDataFrame([(i, [float(x), 0.0]) for i, x in enumerate([0, 1, 3, 6, 10])],
                                "id long, v array<double>")
    d = {r["id"]: (r["d1"], r["d2"]) for r in N.knn_distances(pts, pts, "id", "v", 2, block_rows=2).collect()}
    assert d == {0: (1.0, 3.0), 1: (1.0, 2.0), 2: (2.0, 3.0), 3: (3.0, 4.0), 4: (4.0, 7.0)}


def test_hashed_rank_equals_row_number(spark):
    df = spark.range(5000).select(F.col("id").alias("key"), (F.col("id") % 3 == 0).cast("int").alias("y")) \
        .withColumn("h", order_hash("key", 9))
    got = hashed_rank(df, "h", by="y", tiebreak="key", prefix=2)
    ref = df.withColumn("r2", F.row_number().over(Window.partitionBy("y").orderBy("h", "key")) - 1)
    bad = got.join(ref, ["key"]).where(F.col("rank") != F.col("r2")).count()
    assert bad == 0


def test_prefix_sums_with_hot_group(spark):
    # one group holds most rows: running totals must still equal pandas cumsum
    pdf = pd.DataFrame({"g": ["hot"] * 900 + ["cold"] * 100, "v": list(range(900)) + list(range(100)),
                        "c": np.arange(1000) % 7})
    out = prefix_sums(spark.createDataFrame(pdf), "v", ["c"], by="g", ranges=6).toPandas()
    pdf["exp"] = pdf.sort_values("v").groupby("g")["c"].cumsum()
    m = out.merge(pdf, on=["g", "v"])
    assert (m["c_cum"] == m["exp"]).all()


def test_ffill_matches_pandas_with_hot_group(spark):
    rng = np.random.default_rng(0)
    n = 2000
    pdf = pd.DataFrame({"u": np.where(rng.random(n) < 0.7, 1, rng.integers(2, 20, n)), "t": np.arange(n),
                        "v": np.where(rng.random(n) < 0.4, np.nan, rng.random(n))})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    got = C.ffill(df, ["v"], ["t"], by="u", ranges=5).toPandas().set_index("t").sort_index()
    exp = pdf.sort_values("t").groupby("u")["v"].ffill()
    assert np.allclose(got["v"].fillna(-1).values, exp.fillna(-1).values)


def test_stratified_folds_balanced(spark):
    df = spark.range(1003).select(F.col("id").alias("key"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    f = R.add_fold(df, "key", 5, seed=1, by="y").groupBy("y", "fold").count().toPandas()
    for _, g in f.groupby("y"):
        assert g["count"].max() - g["count"].min() <= 1


def test_split_exact_sizes_and_repeatable(spark):
    df = spark.range(1000).select(F.col("id").alias("key"))
    a = R.split(df, "key", [0.7, 0.3], names=["t", "v"])
    assert a.where("part = 't'").count() == 700
    b = R.split(df.repartition(7), "key", [0.7, 0.3], names=["t", "v"])
    assert a.join(b, ["key", "part"]).count() == 1000


def test_rank_gauss_matches_definition(spark):
    vals = [5.0, 1.0, 3.0, 2.0, 4.0, 9.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "key long, x double")
    got = {r["key"]: r["x_gauss"] for r in FE.rank_gauss(df, "x", "key").collect()}
    n = len(vals)
    ranks = np.argsort(np.argsort(vals)) / n
    ranks = (ranks - ranks.mean()) * 2
    nd = NormalDist()
    e = np.array([nd.inv_cdf((r + 1) / 2) / math.sqrt(2) for r in ranks])
    e -= e.mean()
    for i in range(n):
        assert got[i] == pytest.approx(e[i], abs=1e-9)


def test_correlated_columns_greedy(spark):
    pdf = pd.DataFrame({"a": np.arange(50.0), "b": np.arange(50.0) * 2 + 1, "c": np.sin(np.arange(50.0)),
                        "d": np.arange(50.0) * -1})
    df = spark.createDataFrame(pdf)
    assert C.correlated_columns(df, ["a", "b", "c", "d"], 0.985) == ["b"]


def test_ranksum_z_matches_formula(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=60), 1)
    y = (rng.random(60) < 0.4).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    got = X.ranksum(df, ["x"], "y").first()
    r = pd.Series(x).rank().values
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    s = r[y == 0].sum()
    z = (s - n0 * (n0 + n1 + 1) / 2) / math.sqrt(n0 * n1 * (n0 + n1 + 1) / 12)
    assert got["z"] == pytest.approx(z)
    assert got["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_target_encode_unseen_gets_prior(spark, employees):
    tr = employees.where("part = 'train'")
    table, prior = E.fit_target_encode(tr, "dept", "y", 1, 1)
    out = {r["id"]: r["te"] for r in E.apply_target_encode(employees, table, prior, "dept", "te").collect()}
    assert out[7] == pytest.approx(0.5)  # Ops unseen -> prior 3/6


def test_smote_points_lie_between_neighbours(spark):
    pts = spark.createDataFrame([(i, [float(i), 2.0 * i], 1) for i in range(10)], "id long, v array<double>, y int")
    s = N.smote(pts, "id", "v", "y", 1, k=2, seed=3, block_rows=4).collect()
    assert len(s) == 10
    for r in s:
        x0, x1 = r["v"]
        assert x1 == pytest.approx(2 * x0)  # stays on the line
        assert abs(x0 - r["source_key"]) <= 2 + 1e-9


def test_knn_tie_goes_to_smaller_key(spark):
    pts = spark.createDataFrame([(0, [0.0]), (5, [-1.0]), (3, [1.0]), (9, [4.0])], "id long, v array<double>")
    nb = N.knn(pts.where("id = 0"), pts, "id", "v", 1, block_rows=1).collect()
    assert [(r["nkey"], r["dist"]) for r in nb] == [(3, 1.0)]


def test_knn_matches_numpy_brute_force(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(300, 8)), 2)  # rounded: exact duplicates and ties occur
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    got = N.knn(df, df, "id", "v", 4, block_rows=70).toPandas()
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    for i in range(300):
        order = sorted(range(300), key=lambda j: (d[i, j], j))[:4]
        g = got[got.qkey == i].sort_values("j")
        assert list(g.nkey) == order
        assert np.allclose(g.dist.values, d[i, order])


def test_skewed_columns_selects_by_abs_skew(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"sym": rng.normal(size=500), "right": rng.exponential(size=500),
                        "left": -rng.exponential(size=500)})
    assert FE.skewed_columns(spark.createDataFrame(pdf), ["sym", "right", "left"], 0.5) == ["right", "left"]


def test_boxcox_grid_recovers_log_for_lognormal(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"x": np.exp(rng.normal(size=3000)) - 1.0})  # x + 1 is log-normal: lambda ~ 0
    lam = FE.fit_boxcox(spark.createDataFrame(pdf), ["x"]).first()["lambda"]
    assert abs(lam) <= 0.1


def test_exact_quantiles_match_numpy_with_hot_and_null_groups(spark):
    from tabfold.functions.ranking import quantiles
    rng = np.random.default_rng(5)
    n = 3000
    g = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", None], n))
    pdf = pd.DataFrame({"g": g, "x": np.round(rng.normal(size=n) * 10, 1), "z": rng.integers(0, 5, n).astype(float)})
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quantiles(df, ["x", "z"], probs, by="g").toPandas()
    for (grp, col), sub in pdf.assign(g=pdf.g.fillna("<null>")).melt(id_vars="g", var_name="column").groupby(["g", "column"]):
        row = got[(got.g.fillna("<null>") == grp) & (got.column == col)]
        assert len(row) == 1
        for i, p in enumerate(probs):
            assert row[f"q{i}"].iloc[0] == pytest.approx(np.quantile(sub.value.values, p), abs=1e-9)


def test_ranks_keep_null_group_keys(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2) for i in range(40)], "key long, y int") \
        .withColumn("h", order_hash("key", 2))
    assert hashed_rank(df, "h", by="y", tiebreak="key").count() == 40
    pdf = pd.DataFrame({"g": [None, None, "a", "a"], "v": [1, 2, 1, 2], "c": [1, 1, 1, 1]})
    assert prefix_sums(spark.createDataFrame(pdf, "g string, v long, c long"), "v", ["c"], by="g").count() == 4


def test_with_key_rejects_repeats(spark):
    from tabfold.operators.columns import with_key
    ok = spark.createDataFrame([(1,), (2,)], "k long")
    assert with_key(ok, "k").count() == 2
    with pytest.raises(ValueError, match="not unique"):
        with_key(spark.createDataFrame([(1,), (1,)], "k long"), "k")


def test_blends_stay_within_model_range(spark):
    rng = np.random.default_rng(11)
    rows = [(k, m, float(rng.uniform(0.01, 0.99))) for k in range(200) for m in ("a", "b", "c")]
    long = spark.createDataFrame(rows, "key long, model string, p double")
    rng_t = long.groupBy("key").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    for how, w in [("mean", None), ("mean", {"a": 2, "b": 1, "c": 3}), ("hmean", None), ("gmean", None)]:
        b = B.blend(long, how, weights=w).join(rng_t, "key")
        assert b.where("p_blend < lo - 1e-12 OR p_blend > hi + 1e-12").count() == 0, how


def test_imputation_leaves_no_nulls_and_keeps_values(spark, employees):
    tr = employees.where("part = 'train'")
    for fitted in (C.fit_mode(tr, ["rating"]), C.fit_median(tr, ["rating"]), C.fit_mean(tr, ["rating"])):
        out = C.apply_fill(employees, fitted, ["rating"])
        assert out.where("rating IS NULL").count() == 0
        kept = out.join(employees.select("id", F.col("rating").alias("r0")), "id").where("r0 IS NOT NULL")
        assert kept.where("rating != r0").count() == 0


def test_knn_cells_prune_and_lose_nothing(spark):
    """Copies per row grow slower than the number of cells; far ties, repeated points and
    rows without a vector change nothing."""
    rng = np.random.default_rng(8)
    centres = rng.normal(scale=20, size=(40, 3))
    share = []
    for n in (600, 4800):
        x = centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 3))
        x[: n // 10] = x[0]  # a tenth of all rows at one place
        df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)] + [(10**6, None)], "id long, v array<double>")
        q_rep, _, cells = N.knn_plan(df, df, "id", "v", 3, block_rows=60)
        share.append((q_rep.select("key", "cell").distinct().count() / n, cells))
        got = N.knn(df, df, "id", "v", 3, block_rows=60).toPandas()
        d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
        np.fill_diagonal(d, np.inf)
        want = np.sort(d, axis=1)[:, :3]
        g = got.pivot(index="qkey", columns="j", values="dist").loc[range(n)].to_numpy()
        np.testing.assert_allclose(g, want, atol=1e-9)
        assert len(got) == 3 * n
        tied = got[got.qkey == 5].sort_values("j").nkey.tolist()
        assert tied == [0, 1, 2]
    (few, cells_few), (many, cells_many) = share
    assert cells_many > 5 * cells_few and many / few < 0.5 * cells_many / cells_few and many < 0.3 * cells_many


@pytest.mark.parametrize("bucket_rows", [4, 50, 100_000])
def test_continuous_mutual_info_is_brute_force(spark, bucket_rows):
    """500 rows, three features with ties and hot values, tiny buckets with borrowed rows."""
    def psi(x):  # of whole numbers: the harmonic sum less Euler's constant
        return sum(1 / i for i in range(1, int(x))) - 0.5772156649015329

    rng = np.random.default_rng(6)
    y = rng.integers(0, 3, 500)
    y[7] = 9  # a class of one row
    y[8] = y[9] = 8  # fewer rows than k
    x = {"a": rng.normal(size=500) + y, "b": np.round(rng.normal(size=500), 1), "c": np.where(rng.random(500) < 0.4, 1.0, rng.normal(size=500))}
    want, k = {}, 3
    for f, v in x.items():
        keep = y != 9
        vs, ys = v[keep], y[keep]
        total = []
        for i in range(len(vs)):
            same = np.sort(np.abs(np.delete(vs[ys == ys[i]], np.flatnonzero(np.flatnonzero(ys == ys[i]) == i)) - vs[i]))
            kk = min(k, len(same))
            r = same[kk - 1]
            m = (vs == vs[i]).sum() if r == 0 else ((vs > vs[i] - r) & (vs < vs[i] + r)).sum()
            total.append(psi(kk) - psi(len(same) + 1) - psi(max(m, 1)))
        want[f] = max(0.0, psi(len(vs)) + float(np.mean(total)))
    rows = [(*(float(x[f][i]) for f in "abc"), int(y[i])) for i in range(500)] + [(None, float("nan"), None, 1), (1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int")
    got = {r.feature: r.mutual_info for r in X.mutual_info_continuous(df, ["a", "b", "c"], "y", k, bucket_rows).collect()}
    assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 1e-9 for f in want) and want["a"] > 0.2


def test_knn_tasks_hold_no_more_at_more_rows_and_cells():
    """What one task holds at a time follows from CHUNK, not from the block or the visits."""
    import tracemalloc

    import pandas as pd
    rng = np.random.default_rng(1)
    chunk = 8 * N.CHUNK

    def frame(n, dims, **more):
        return pd.DataFrame({"key": np.arange(n), "vec": list(rng.normal(size=(n, dims))), **more})

    q, b = frame(12_000, 4), frame(1_200, 4)
    tracemalloc.start()
    got = N._topk_fn(3, True)(q, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 36_000 and peak < 6 * chunk
    cells, dims = 100, 64  # no bound at all: every query visits every cell
    part = frame(2_000, dims, within=np.full(2_000, np.nan))
    out = list(N._visits_fn(rng.normal(size=(cells, dims)), np.ones(cells), np.ones(cells, int), 1e-9)(iter([part])))
    assert sum(map(len, out)) == 2_000 * cells and max(map(len, out)) * dims <= N.CHUNK
    whole = [(int(k), int(c)) for o in out for k, c in zip(o["key"], o["cell"])]
    assert len(set(whole)) == 2_000 * cells


def test_knn_copies_no_vector_for_a_visit(spark):
    """Without geometry every query visits every cell; what is written stays near the table's own size."""
    from pathlib import Path

    rng = np.random.default_rng(12)
    n, dims = 2000, 32
    x = rng.normal(size=(n, dims)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    shared = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))

    def size():
        return sum(f.stat().st_size for f in shared.rglob("*") if f.is_file())

    before = size()
    got = N.knn(df, df, "id", "v", 3, block_rows=100).toPandas()
    assert size() - before < 3 * x.nbytes
    d = np.sqrt(((x[:, None].astype("float64") - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    g = got.sort_values(["qkey", "j"])
    assert len(g) == 3 * n
    np.testing.assert_array_equal(g.nkey.to_numpy().reshape(n, 3), np.argsort(d, axis=1, kind="stable")[:, :3])
    np.testing.assert_allclose(g.dist.to_numpy().reshape(n, 3), np.sort(d, axis=1)[:, :3])


def test_knn_of_repeated_and_missing_keys(spark):
    """Rows that come twice are neighbours twice and their queries share k places; no key is never one's own."""
    df = spark.createDataFrame([(1, [0.0]), (1, [0.0]), (2, [1.0]), (2, [1.0]), (3, [5.0]), (4, None)], "id long, v array<double>")
    got = {(r.qkey, r.j): (r.nkey, r.dist) for r in N.knn(df, df, "id", "v", 2, block_rows=1).collect()}
    assert got == {(1, 1): (2, 1.0), (1, 2): (2, 1.0), (2, 1): (1, 1.0), (2, 2): (1, 1.0), (3, 1): (2, 4.0), (3, 2): (2, 4.0)}
    none = spark.createDataFrame([(None, [0.0]), (7, [3.0])], "id long, v array<double>")
    assert {(r.qkey, r.nkey, r.dist) for r in N.knn(none, none, "id", "v", 1).collect()} >= {(7, -(1 << 63), 3.0)}
    assert N.knn(df, df.where("id = 4"), "id", "v", 1).count() == 0


def test_knn_vote_copies_no_vector_for_a_visit(spark):
    """M9 goes by the same search: votes as by brute force, little written."""
    from pathlib import Path

    rng = np.random.default_rng(13)
    n, dims, k = 1500, 32, 5
    x, y = rng.normal(size=(n, dims)).astype("float32"), rng.integers(0, 3, n)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id long, v array<float>, c int")
    shared = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))

    def size():
        return sum(f.stat().st_size for f in shared.rglob("*") if f.is_file())

    before = size()
    got = {r.id: (r.pred, r.vote_share) for r in N.knn_vote(df, df, "id", "v", "c", k, weighted=True, block_rows=100).collect()}
    assert size() - before < 3 * x.nbytes
    d = np.sqrt(((x[:, None].astype("float64") - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    for i in range(0, n, 7):
        near = np.argsort(d[i], kind="stable")[:k]
        votes = np.bincount(y[near], 1 / d[i, near], minlength=3)
        assert got[i][0] == votes.argmax() and got[i][1] == pytest.approx(votes.max() / votes.sum(), abs=1e-9)
