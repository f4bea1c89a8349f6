"""Suffix-array dedup against brute force over all strings."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from tabfold.llm import suffixes as S
from tabfold.llm.suffixes import COVER, V, suffix_dedup


def brute(rows, length=200):
    """For each row (key, n_bytes, n_removed, n_spans, sha)."""
    places = defaultdict(int)
    raw = [(t or "").encode() for _, t in rows]
    for b in raw:
        for i in range(len(b) - length + 1):
            places[b[i:i + length]] += 1
    out = []
    for (k, _), b in zip(rows, raw):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if places[b[i:i + length]] > 1:
                gone[i:i + length] = True
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((k, len(b), int(gone.sum()), int((gone[1:] > gone[:-1]).sum() + gone[0]), hashlib.sha256(left).hexdigest(), left))
    return sorted(out, key=str)


def result(spark, rows, **how):
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_removed int").repartition(3)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in suffix_dedup(docs, **how).collect()), key=str)


def texts(rng, letters="abcdefgh é\n"):
    piece = lambda n: "".join(rng.choice(list(letters), n))
    a, b, c = piece(200), piece(350), piece(150)
    rows = [(i, piece(int(rng.integers(0, 600)))) for i in range(12)]
    rows += [(20, piece(37) + a + piece(60)), (21, piece(300) + a), (22, a), (23, piece(10) + a[:199] + "!"), (24, b + piece(90) + b), (25, piece(71) + b[40:300] + piece(80) + a[1:]),
             (26, c + piece(300)), (27, piece(20) + c), (28, "x" * 1000), (29, "x" * 200), (30, "x" * 199), (31, piece(400)), (33, "yz" * 300)]
    return rows + [(32, rows[-2][1]), (34, rows[3][1]), (35, "short"), (36, "short"), (37, None), (38, ""), (None, piece(30) + b), (39, a), (39, a), (39, piece(250))]


def test_cover():
    assert {(x - y) % V for x in COVER for y in COVER} == set(range(V))


def test_keys_are_those_of_the_strings():
    data = b"abcabcabcXabcabcabc" * 3
    block = S.Block(data, [len(data)])
    at = np.arange(len(data) - 8)
    strings = [data[i:i + 9] for i in at]
    for k in block.keys(at, 9, True):
        assert all((k[i] == k[j]) == (strings[i] == strings[j]) for i in at for j in at)
    assert len(S.Block(b"", []).keys(at[:0], 9)[0]) == 0


def test_sample_and_reach():
    rng = np.random.default_rng(0)
    sizes = [0, 50, 700, 68, 67, 1000, 0, 333]
    block = S.Block(bytes(rng.integers(0, 255, sum(sizes), dtype=np.uint8)), sizes)
    place = [(t, i) for t, n in enumerate(sizes) for i in range(n)]
    assert block.sampled(200).tolist() == [p for p, (t, i) in enumerate(place) if i % V in COVER and i + 200 - V + 1 <= sizes[t]]
    tied = np.sort(rng.choice(block.sampled(200), 25, replace=False))
    want = [p for p, (t, i) in enumerate(place) if i + 200 <= sizes[t] and any(p <= s < p + V and place[s][0] == t for s in tied)]
    assert block.long_ties(200, tied).tolist() == want


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    rows = texts(np.random.default_rng(seed))
    want = brute(rows)
    assert result(spark, rows) == want
    monkeypatch.setattr(S, "BUCKET_KEYS", 300)  # many buckets, many blocks, nothing broadcast
    monkeypatch.setattr(S, "BLOCK_BYTES", 700)
    monkeypatch.setattr(S, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(S, "WIDE_FROM", 0)
    assert result(spark, rows) == want


def test_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert result(spark, rows) == brute(rows)


def test_long_and_empty(spark):
    rng = np.random.default_rng(5)
    long = "".join(rng.choice(list("abcdefgh"), 300_000))
    got = result(spark, [(1, long + "1"), (2, "2" + long[1000:])])
    assert [(k, removed, n) for k, _, removed, n, *_ in got] == [(1, 299_000, 1), (2, 299_000, 1)]
    assert result(spark, []) == [] and result(spark, [(1, None)])[0][:4] == (1, 0, 0, 0)
    with pytest.raises(ValueError):
        suffix_dedup(spark.createDataFrame([(1, "x")], "doc_id long, text string"), length=V)


def test_long_rows_are_held_a_few_at_a_time(spark):
    """Row groups and the batches that workers get are bounded in bytes; the session's setting is as before."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tabfold.llm import common

    def long(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                data = np.random.default_rng(i).integers(0, 256, 3 << 20).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([data.tobytes()])], names=["id", "data"])

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    table = common.stored(spark.range(0, 24, 1, 1).mapInArrow(long, "id long, data binary"), "long", long_rows=True)
    file = pq.ParquetFile(table.inputFiles()[0].removeprefix("file://")).metadata
    assert max(file.row_group(k).num_rows for k in range(file.num_row_groups)) <= 7
    seen = [r.n for r in common.stored(table.mapInArrow(rows, "n long"), "rows").collect()]
    assert sum(seen) == 24 and max(seen) <= 4
    assert spark.conf.get(name, None) == before
