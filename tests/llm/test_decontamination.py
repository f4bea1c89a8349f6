"""Decontamination: WAND against exhaustive scoring, planted items, defined cases."""

from collections import Counter

import numpy as np
import pytest

from tabfold.llm import decontamination as D
from tabfold.llm.decontamination import build_part, contaminated, decontaminate, question_and_answer, wand, words_of

from .conftest import SF


def random_part(rng, n=60, vocabulary=80):
    items = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(5, 30)) % vocabulary), "") for i in range(n)]
    frequency, words = Counter(), 0
    for _, q, _ in items:
        frequency.update(set(words_of(q)))
        words += len(words_of(q))
    return build_part(items, n, frequency, words / n)


def test_wand_retrieves_all_above_threshold():
    rng = np.random.default_rng(8)
    for _ in range(15):
        part = random_part(rng)
        for threshold in (0.2, 0.5, 0.8):
            query = sorted(rng.choice(len(part.terms), min(20, len(part.terms)), replace=False).tolist())
            score = np.zeros(len(part.ids))
            for t in query:
                at, w = part.postings[t]
                np.add.at(score, at, w)
            got = dict(wand(part, query, threshold))
            assert sorted(got) == np.flatnonzero(score >= threshold).tolist()
            assert all(got[i] == pytest.approx(score[i]) for i in got)


def test_own_score_is_one():
    part = random_part(np.random.default_rng(3))
    for i, q in enumerate(part.questions):
        assert dict(wand(part, sorted({part.terms[w] for w in q}), 0.99))[i] == pytest.approx(1)


def test_split():
    assert question_and_answer("What is one and one here? It is two.") == ("What is one and one here? ", "It is two.")
    assert question_and_answer("No sentence end") == ("No sentence end", "")
    assert question_and_answer("Short. Answer here") == ("Short. Answer here", "")


def brute(docs, items, least=0.8):
    found = set()
    for d, t in docs:
        w = words_of(t or "")
        mine = D.shingles(w)
        for i, x in items:
            q, a = map(words_of, question_and_answer(x))
            if D.overlap(q, w, mine) >= least and D.overlap(a, w, mine) >= least:
                found.add((d, i))
    return found


def test_documents(spark, documents):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs, items = [(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in benchmark.collect()]
    want = brute(docs, items)
    assert want
    out = contaminated(documents, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in out} == want
    kept = decontaminate(documents, benchmark)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want} and kept.columns == documents.columns


def test_edge_cases(spark, monkeypatch):
    question = "Which river flows through the old town of the seven bridges and the mills"
    items = [(1, f"{question}? The quick green river."), (1, f"{question}? The quick green river."), (None, "Another long question about nothing that matters to anyone here? Nobody knows."), (3, None), (4, ""), (5, "...")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    filler = "some filler words that say nothing and go on " * 3000
    rows = [(1, f"{filler} {question.upper()}!  THE QUICK\ngreen river {filler}", 1), (2, f"{question}? The slow red lake.", 2), (3, None, 3), (4, "", 4), (None, f"x {question} the quick green river", 5),
            (6, "Another long question about nothing that matters to anyone here? Nobody knows.", 6), (7, "clean", 7), (7, "clean", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    for size in (D.BROADCAST_BYTES, 10):  # the second: one pass for each item
        monkeypatch.setattr(D, "BROADCAST_BYTES", size)
        got = {(r.doc_id, r.item_id) for r in contaminated(docs, benchmark).collect()}
        assert got == {(1, 1), (None, 1), (6, None)}
        assert sorted(r.item_id for r in decontaminate(docs, benchmark).collect()) == [2, 3, 4, 7, 7]
    assert contaminated(docs, benchmark.where("false")).count() == 0 and decontaminate(docs, benchmark.where("false")).count() == len(rows)
    assert contaminated(docs.where("false"), benchmark).count() == 0 and decontaminate(docs.where("false"), benchmark).count() == 0
    split = spark.createDataFrame([(9, question, "The quick green river")], "item_id long, question string, answer string")
    assert {r.doc_id for r in contaminated(docs, split).collect()} == {1, None}
