"""Embedding near-dedup: recall and exact checks against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tabfold.llm import embeddings as E
from tabfold.llm.embeddings import cells_in_order, embedding_groups

from .conftest import SF


def brute(rows, threshold=0.93):
    ok = [r for r in rows if r.label is not None and r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    x = np.array([r.embedding for r in ok], np.float64)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    label = np.array([r.label for r in ok])
    near = (x @ x.T >= threshold) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    return {r.vec_id: int(n) for r, n in zip(ok, near.sum(axis=1))}, near, [r.vec_id for r in ok]


def test_cells_in_order():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random(7), rng.random(5)
        a -= a.min()
        b -= b.min()
        got = cells_in_order(a, b, 0.6)
        want = sorted((a[i] + b[j], i * 5 + j) for i in range(7) for j in range(5) if a[i] + b[j] <= 0.6)
        assert got == [c for _, c in want]


def test_recall_against_brute_force(spark, monkeypatch):
    table = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/embeddings.parquet")
    monkeypatch.setattr(E, "PER_CELL", 4)  # a fine grid, so that links cross cells
    want, _, _ = brute(table.collect())
    for block in (2048, 5):
        monkeypatch.setattr(E, "BLOCK", block)
        got = {r.vec_id: r.n_links for r in embedding_groups(table).collect()}
        assert all(got[k] <= n for k, n in want.items())  # nothing that is not a link
        assert sum(got.values()) >= 0.97 * sum(want.values())


def test_sparse_links(spark, monkeypatch):
    """Few links, none of them of the first sampled vectors, across cells."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(E, "PER_CELL", 1)
    monkeypatch.setattr(E, "QUERIES", 2)
    x = rng.normal(size=(600, 8))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    x = np.concatenate([x, x[:12] + 0.11 * rng.normal(size=(12, 8))])
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    want, _, _ = brute(table.collect())
    assert sum(want.values())
    assert {r.vec_id: r.n_links for r in embedding_groups(table).collect()} == want


def test_single_components_are_commonest(spark):
    rows = [(i, [float(i + 1)], 1) for i in range(6)] + [(10, [1.0, 2.0], 1), (11, [1.0, 2.1], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for part, want in ((table, {i: 5 for i in range(6)} | {10: 1, 11: 1}), (table.where("vec_id < 10"), {i: 5 for i in range(6)})):
        assert {r.vec_id: r.n_links for r in embedding_groups(part).collect()} == want


def test_groups_and_edge_cases(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(20, 8))
    rows = [(i, (base[i % 20] + 0.01 * rng.normal(size=8)).tolist(), i % 2, "x") for i in range(60)]
    rows += [(100, rows[3][1], 1, None), (101, rows[3][1], 0, None), (102, rows[3][1], None, None), (103, None, 1, None), (104, [0.0] * 8, 1, None), (105, [float("nan")] + [1.0] * 7, 1, None),
             (106, [None] + [1.0] * 7, 1, None), (107, [], 1, None), (108, [1.0, 2.0], 1, None), (109, [2.0, 4.0], 1, None), (None, rows[3][1], 1, None), (110, rows[3][1], 1, None), (110, rows[3][1], 1, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, kept string")
    out = embedding_groups(table).collect()
    assert len(out) == len(rows)
    real = [r for r in out if r.vec_id is not None and r.vec_id not in (107, 108, 109)]
    want, near, ids = brute(real)
    for r in real:
        assert r.n_links == want.get(r.vec_id, 0), r
        assert r.kept == (r.vec_id == r.component_id)
    by = {r.vec_id: r for r in out}
    assert (by[108].component_id, by[109].component_id, by[109].n_links, by[107].component_id) == (108, 108, 1, 107)
    assert by[None].n_links == 0 and by[None].kept
    assert by[110].component_id == 3 and by[101].component_id == 101
    reach = {i: i for i in ids}
    for _ in ids:
        for i, row in zip(ids, near):
            for j in np.flatnonzero(row):
                reach[i] = min(reach[i], reach[ids[j]])
    assert all(by[i].component_id == c for i, c in reach.items())
    assert embedding_groups(table.where("false")).count() == 0
    assert embedding_groups(table.where(F.col("label").isNull())).first().n_links == 0
