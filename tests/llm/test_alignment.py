"""Alignment of two tokenizers against brute force over the libraries' own output."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer, decoders

from tabfold.llm import alignment
from tabfold.llm.alignment import align_documents, pair_counts, score_links

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts, libraries):
    """Offsets, groups and links of each text, then counts over all texts."""
    t, s = libraries
    table = {chr(b): b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    table |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in table)}

    def one(text):
        a, b = t.encode(" " + (text or ""), add_special_tokens=False).ids, s.encode(text or "")
        bytes_a = [bytes(table[c] for c in t.id_to_token(i)) for i in a]
        pieces = map(s.id_to_piece, b)
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        want = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            return [], [], []
        ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
        end_a, end_b = ends(bytes_a), ends(bytes_b)
        groups, at = [], 0
        for end in sorted(set(end_a) & set(end_b)):
            inside = lambda e, x: [i for i, k in zip(x, e) if at < k <= end]
            groups.append((inside(end_a, a), inside(end_b, b)))
            at = end
        return a, b, groups

    found = [one(x) for x in texts]
    links = [[(x, y) for left, right in g for x in left for y in right] for _, _, g in found]
    docs = Counter(p for each in links for p in set(each))
    most = {}
    for (x, _), n in docs.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for (a, b, groups), each in zip(found, links):
        written = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        out.append((len(a), len(b), len(groups), len(each), sum(docs[p] == most[p[0]] for p in each), sum(docs[p] for p in each), hashlib.sha256(written.encode()).hexdigest() if a else ""))
    return out


def run(docs):
    aligned = align_documents(docs, A, B)
    return score_links(aligned, pair_counts(aligned))


def test_odd_texts(spark, libraries, monkeypatch):
    rng = np.random.default_rng(3)
    alphabet = ["a", "é", " ", " ", "\n", "\t", "it's", "12", "!!", "漢字", "\x1c", "　", "<|endoftext|>", "word", "'ll", "\r\n", "tokenization", "😀", "----", "</s>", "<0x41>", "internationalisation", "​"]
    texts = ["", None, " ", "  ", "\n", "\na", " a", "a ", "a ▁ b", "▁", "aaaa" * 500, "x" * 999 + " y", "漢" * 300] + ["".join(rng.choice(alphabet, rng.integers(1, 25))) for _ in range(800)]
    texts += texts[-40:]
    monkeypatch.setattr(alignment, "TOKENS", 300)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in run(docs).collect()}
    want = brute(texts, libraries)
    assert [got[i] for i in range(len(texts))] == want
    assert got[0] == got[1] == got[8] == (0, 0, 0, 0, 0, 0, "")


def test_query(spark, libraries):
    from tabfold.llm.queries import op12_alignment

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in op12_alignment(spark, SF).collect()}
    assert got == dict(zip([r.doc_id for r in docs], brute([r.text for r in docs], libraries)))
    assert any(v[2] < v[0] for v in got.values())


def test_edge_cases(spark, libraries):
    texts = ["null key", None, "", "same", "same", "long text, " * 1_000]
    keys = [None, None, 7, 8, 8, 9]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in zip(keys, texts)], "doc_id long, text string, ROW int, pairs string")
    rows = run(docs).collect()
    as_text = lambda rows: sorted(map(str, rows))
    assert as_text((r.doc_id, *(r[c] for c in COLUMNS)) for r in rows) == as_text((k, *v) for k, v in zip(keys, brute(texts, libraries)))
    assert run(docs.where("false")).count() == 0
    assert run(docs.where("text = ''")).first().count_sum == 0


def test_counts(spark, libraries):
    """Both ways of the join of the counts give the same rows; best marks every tie."""
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b"), (3, "zebras")], "doc_id long, text string")
    aligned = align_documents(docs, A, B)
    counts = pair_counts(aligned)
    most = {}
    for r in counts.collect():
        assert r.pair == r.a << 32 | r.b
        most.setdefault(r.a, []).append((r.docs, r.best))
    assert all(best == (n == max(x for x, _ in v)) for v in most.values() for n, best in v)
    monkey = pytest.MonkeyPatch()
    monkey.setattr(alignment, "bounded", lambda t: t)
    shuffled = score_links(aligned, counts).select("doc_id", *COLUMNS).collect()
    monkey.undo()
    assert sorted(map(tuple, shuffled)) == sorted(map(tuple, score_links(aligned, counts).select("doc_id", *COLUMNS).collect()))


def test_windows_are_remembered_in_little(libraries):
    """One string of bytes a window, which tells both sides apart (a pair of strings in a
    tuple took twice the memory); what is remembered is found again under the same code."""
    aligner = alignment.Aligner(A, B)
    texts = ["tokenization of words", "tokenization of  words", "internationalisation 12 漢字"]
    first = aligner(alignment.pa.array(texts))
    codes = dict(aligner.codes)
    assert codes and all(type(k) is bytes for k in codes)
    between = np.array(len(aligner.size_a), np.min_scalar_type(len(aligner.size_a))).tobytes()
    assert all([k[i:i + 2] for i in range(0, len(k), 2)].count(between) >= 1 for k in codes)
    again = aligner(alignment.pa.array(texts))
    assert aligner.codes == codes and all(np.array_equal(x, y) for x, y in zip(first, again))


def test_text_ends_are_marked_not_sorted_for(monkeypatch):
    """New and known windows, repeated and not, in one batch; no sort of all tokens to find text ends."""
    aligner = alignment.Aligner(A, B)
    data = ["one two two", "", "two three", "one two two", "naïve — three"]
    want = [alignment.Aligner(A, B)(pa.array([t])) for t in data]

    def sorts(*_):
        raise AssertionError("np.isin sorts all tokens")

    monkeypatch.setattr(alignment.np, "isin", sorts)
    aligner(pa.array(data[2:3]))
    found = aligner(pa.array(data))
    for k in range(5):
        assert list(found[k]) == [w[k][0] for w in want]
    assert found[6].tolist() == [p for w in want for p in w[6].tolist()]
    assert found[7].tolist() == [p for w in want for p in w[7].tolist()]
