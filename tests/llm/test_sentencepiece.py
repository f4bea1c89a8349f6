"""SentencePiece codec: parity with the sentencepiece library and exact round trips."""

import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tabfold.llm import sentencepiece_codec as S

FILE = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "é", " ", " ", "\n", "\t", "it's", "12", "!!", "漢", " ", "\x1c", "\x85", "　", "<s>", "</s>", "<unk>", "<0x41>", "word", "▁", "\r\n", "😀"]


def texts(n=1500):
    rng = np.random.default_rng(2)
    return ["", " ", "  ", "a ", " a", "a  b   c ", "x \n y", "a" * 5000, "one two"] + ["".join(rng.choice(ALPHABET, rng.integers(1, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def codec():
    with open(FILE, "rb") as f:
        return S.Codec(f.read())


def test_ids_and_text_are_the_librarys(codec):
    theirs = sentencepiece.SentencePieceProcessor(model_file=FILE)
    data = texts()
    ids, n = codec.encode(data)
    for t, p, d in zip(data, np.split(ids, np.cumsum(n)[:-1]), codec.decode([p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])])):
        assert p.tolist() == theirs.encode(t), repr(t)
        assert d == theirs.decode(p.tolist()) == codec.normal(t)


def test_without_chunks(codec):
    with open(FILE, "rb") as f:
        whole = S.Codec(f.read())
    whole.chunks = None
    data = texts(200)
    a, b = codec.encode(data), whole.encode(data)
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])
    assert [p.tolist() for p in np.split(b[0], np.cumsum(b[1])[:-1])] == whole.theirs.encode(data)


def test_parity_is_each_rows_own(codec):
    data = ["one two", "a  b", "", "three"]
    lists = [codec.theirs.encode(t) for t in data]
    wrong = [lists[0], lists[1][:-1], lists[2], lists[3]]  # as by a fault in assembling chunks
    assert codec.agree(data, wrong, codec.decode(wrong)) == [True, False, True, True]
    assert codec.agree(data, lists, ["one two", "a  b", "", "thre"]) == [True, True, True, False]
    assert all(codec.agree(data, lists, codec.decode(lists)))  # nothing is carried over


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def message(*fields):
    """Protobuf bytes of (number, value): int, float or bytes."""
    out = b""
    for number, v in fields:
        if isinstance(v, float):
            out += varint(number << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, bytes):
            out += varint(number << 3 | 2) + varint(len(v)) + v
        else:
            out += varint(number << 3) + varint(v)
    return out


def unigram_model(squeeze):
    words = ["▁the", "▁cat", "▁", "t", "h", "e", "c", "a", "s", "at", "th", "▁th", "▁c", "▁s", "▁sat", "é", "ca"]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] + [(w, -1.0 - 0.37 * i, 1) for i, w in enumerate(words)]
    body = b"".join(message((1, message((1, p.encode()), (2, s), (3, t)))) for p, s, t in pieces)
    return body + message((2, message((3, 1), (35, 1), (40, 0), (41, 1), (42, 2)))) + message((3, message((1, b"identity"), (3, 1), (4, squeeze), (5, 1))))


@pytest.mark.parametrize("squeeze", [0, 1])
def test_unigram_with_byte_fallback(squeeze):
    codec = S.Codec(unigram_model(squeeze))
    rng = np.random.default_rng(1)
    data = ["", "the cat sat", " the  cat ", "thé漢cat"] + ["".join(rng.choice(["the", "cat", " ", "s", "é", "t", "漢", "  ", "a"], 12)) for _ in range(300)]
    ids, n = codec.encode(data)
    parts = [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])]
    assert parts == codec.theirs.encode(data) and ids.max() < 300
    assert codec.decode(parts) == [codec.theirs.decode(p) for p in parts] == [codec.normal(t) for t in data]


def test_documents(spark, documents):
    out = S.encode_documents(documents, FILE)
    assert out.where("not round_trip or not parity or decoded <> text or size(ids) <> n_tokens").count() == 0
    assert out.count() == documents.count()


def test_edge_cases(spark):
    rows = [(1, None, 5), (2, "", 5), (None, " two  spaces ▁ ", 5), (3, "é" * 50_000, None), (3, "é" * 50_000, None)]
    out = S.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, IDS int"), FILE)
    got = out.collect()
    assert out.columns[:3] == ["doc_id", "text", "IDS_in"] and len(got) == len(rows)
    assert all(r.parity and r.round_trip for r in got)
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id in (1, 2)} == {1: 0, 2: 0}
    assert S.encode_documents(out.select("doc_id", "text").where("false"), FILE).count() == 0
    assert out.where(F.col("text").isNull()).first().decoded == ""


def test_decoding_works_on_whole_texts(codec, monkeypatch):
    byte = {p: i for i, (p, _, _) in enumerate(codec.model.pieces)}
    spelt = [byte["<0xE2>"], byte["<0x96>"], byte["<0x81>"]]  # a marker in bytes is no space
    data = ["one two", "", " a  b ", "é漢 x"]
    lists = [codec.theirs.encode(t) for t in data] + [[*codec.theirs.encode("one"), *spelt], [byte["<0xE2>"]]]
    ours = codec.decode(lists)
    assert ours == [codec.theirs.decode(i) for i in lists] and ours[4] == "one▁"

    class Arrays:
        def __init__(self, theirs):
            self.theirs = theirs

        def encode(self, texts, num_threads):
            return self.theirs.encode(texts, num_threads=num_threads)

        def decode(self, ids):
            assert isinstance(ids, np.ndarray)  # a list of lists took twice the time
            return self.theirs.decode(ids)

    monkeypatch.setattr(codec, "theirs", Arrays(codec.theirs))
    assert codec.agree(data, lists[:4], ours[:4]) == [True] * 4


def test_library_is_asked_for_ids_alone(codec, monkeypatch):
    """Places in the text are a quarter of the library's time and nobody reads them."""
    data = texts(50)
    ids, n = S.Codec(open(FILE, "rb").read()).encode(data)

    class IdsAlone:
        def __init__(self, tokenizer):
            self.encode_batch_fast = tokenizer.encode_batch_fast

    fresh = S.Codec(open(FILE, "rb").read())
    monkeypatch.setattr(fresh, "tokenizer", IdsAlone(fresh.tokenizer))
    again = fresh.encode(data)
    assert np.array_equal(ids, again[0]) and np.array_equal(n, again[1])
