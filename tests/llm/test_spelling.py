"""Spelling variants against brute force over all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabfold.llm import spelling
from tabfold.llm.spelling import count_words, spelling_variants, variant_groups

SF = "/root/testdata/sf0.001"


def one_edit(a: str, b: str) -> bool:
    """By the definition: some single insertion, deletion or replacement turns a into b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_words(rows, slip=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if run:
                counts[run] += 1
    return counts


def brute(counts):
    masked = {}
    for w in counts:  # words that agree but for one place meet here; each pair is judged by the definition
        for k in range(len(w) + 1):
            masked.setdefault(w[:k] + "*" + w[k + 1:], set()).add(w)
            masked.setdefault(w[:k] + "*" + w[k:], set()).add(w)
    near = {w: set() for w in counts}
    for group in masked.values():
        for a in group:
            near[a] |= {b for b in group if b != a and b not in near[a] and one_edit(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None)
    return out


def got(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def test_masked_brute_force_is_the_definition():
    rng = np.random.default_rng(0)
    words = list({"".join(rng.choice(list("ab"), rng.integers(1, 7))) for _ in range(100)})
    counts = {w: 1 for w in words}
    assert {w: v[3] for w, v in brute(counts).items()} == {w: sum(one_edit(w, x) for x in words) for w in words}


@pytest.mark.parametrize("group,block,letters", [(4, 2, "ab"), (512, 128, "abc"), (8, 4, "aé漢")])
def test_random_words(spark, monkeypatch, group, block, letters):
    """Small limits divide groups to the end and cut blocks; ties in n are common."""
    monkeypatch.setattr(spelling, "GROUP", group)
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "BUCKET", 500)
    rng = np.random.default_rng(group)
    counts = {"".join(rng.choice(list(letters), rng.integers(1, 9))): int(rng.integers(1, 30)) for _ in range(700)}
    counts["a" * 3000], counts["a" * 2999 + "b"] = 3, 9
    assert got(variant_groups(spark.createDataFrame(list(counts.items()), "word string, n int"))) == brute(counts)


def test_hot_prefix(spark):
    """Thousands of words with one prefix: groups stay small, nothing is lost."""
    rng = np.random.default_rng(3)
    counts = {"pseudo" + "".join(rng.choice(list("abcdef"), 6)): int(rng.integers(3, 50)) for _ in range(6000)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(variant_groups(words)) == brute(counts)
    sizes = spelling.groups_of(words).groupBy("size", "lo", "hi", "shared").count().agg({"count": "max"}).first()[0]
    assert sizes <= spelling.GROUP


def test_query(spark):
    from tabfold.llm.queries import op11_spelling

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    counts = {w: n for w, n in brute_words(rows).items() if len(w) >= 5 and n >= 3}
    want = brute(counts)
    assert got(op11_spelling(spark, SF)) == want and any(v[3] for v in want.values()) and any(v[0] for v in want.values())


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(spelling, "KEPT", 2)
    rows = [(None, "Ärger ärger ÷x× ZEBRA zebra"), (1, None), (2, ""), (2, "!!! 12"), (3, "word " * 20_000 + "x" * 50_000), (3, "word"), (3, "word")]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, n int, word string")
    assert {r.word: r.n for r in count_words(docs, slip=2).collect()} == dict(brute_words(rows, 2))
    assert {r.word: r.n for r in count_words(docs).collect()}["zebra"] == 2
    assert spelling_variants(docs.where("false")).count() == 0
    words = spark.createDataFrame([(None, 3), ("", 4), ("abc", None), ("abd", 1), ("abd", 1), ("abde", 4)], "word string, n long")
    assert got(variant_groups(words)) == {"abd": ("abde", "abde", 2, 1, 4), "abde": (None, "abde", 4, 1, None)}
    with pytest.raises(ValueError):
        variant_groups(words, ratio=1)
