"""Quality classifier: label model, held-out accuracy, defined cases."""

import numpy as np
import pytest

from tabfold.llm import quality
from tabfold.llm.quality import BAD, GOOD, classify, features, fit_classifier, fit_label_model, fit_scorer, quality_filter, read

from .conftest import SF


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.2
    right, voting = [0.95, 0.9, 0.8, 0.7], [0.9, 0.6, 0.9, 0.8]
    votes = np.stack([np.where(rng.random(len(truth)) < v, np.where(rng.random(len(truth)) < r, truth, ~truth).astype(int), 2) for r, v in zip(right, voting)], 1)
    patterns, counts = np.unique(votes @ 3 ** np.arange(4), return_counts=True)
    model = fit_label_model(patterns, counts.astype(float), 4)
    assert model.prior == pytest.approx(0.2, abs=0.03)
    assert model.accuracy == pytest.approx(right, abs=0.03)
    p = model.posterior(votes @ 3 ** np.arange(4))
    assert ((p > 0.5) == truth).mean() > 0.95


def test_readings():
    r = read("One one, TWO!! | ### idiot")
    assert (r.words, r.names & {"one", "two", "idiot"}) == (6, {"one", "two", "idiot"})
    assert read("a a a a a b").run == 5 and read("").words == 0 and read("| | |").run == 1
    assert features(read("")) == [] and features(read("x" * 100_000))


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen, unseen = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    classifier = fit_classifier(docs, seen)
    rows = classify(docs, classifier).join(unseen, "doc_id").collect()
    bad = np.array([r.quality == 0 or r.toxic == 1 for r in rows])
    rejected = np.array([r.rejected for r in rows])
    assert (rejected == bad).mean() > 0.93 and rejected[bad].mean() > 0.85 and rejected[~bad].mean() < 0.02
    assert all(classifier.models["low"].accuracy[:5] > 0.85)


def test_copies_are_weights(spark, monkeypatch):
    """A text that holds most rows is one row of the sample; the others all stay."""
    docs = spark.createDataFrame([(i, f"A plain line of prose, number word{max(0, i - 300)} of many.") for i in range(360)], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(quality, "fit_scorer", lambda rows, p, bits, times: seen.append((len(rows), sorted(times))) or fit_scorer(rows, p, bits, times=times))
    fit_classifier(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), sample=360)
    assert seen == [(60, [1.0] * 59 + [301.0])] * 2
    rows, p = [np.array([1, 2]), np.array([2, 3])], np.array([0.9, 0.2])
    a, b = fit_scorer(rows, p, times=np.array([3.0, 1.0])), fit_scorer([rows[0]] * 3 + rows[1:], np.array([0.9] * 3 + [0.2]))
    assert np.allclose(a[0], b[0]) and a[1] == pytest.approx(b[1])


def test_edge_cases(spark):
    good, bad = "A plain line of prose about nothing at all, said well. " * 3, "LOUD!! ### $$$ " * 30
    rows = [(i, f"{good} word{i}", 1, "x") for i in range(40)] + [(100 + i, f"{bad} word{i}", 2, "y") for i in range(20)]
    rows += [(None, None, None, None), (None, "", 1, None), (200, None, 1, "z"), (1, f"{good} word1", 1, "x"), (300, "word " * 50_000, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_low int, source string")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, None), (100, 0, 0), (None, 0, 1), (2, None, 1)], "doc_id long, quality int, toxic int")
    kept = quality_filter(docs, labels)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    assert got.count(1) == 2 and got.count(None) == 2 and 200 in got and not any(100 <= i < 120 for i in got if i)
    assert set(range(3, 40)) <= set(got)
    out = classify(docs, fit_classifier(docs, labels.where("false")))
    assert out.count() == len(rows) and "p_low_in" in out.columns
    empty = docs.where("false")
    assert quality_filter(empty, labels).count() == 0 and quality_filter(docs.limit(1), labels).count() == 1
    assert (GOOD, BAD) == (0, 1)
