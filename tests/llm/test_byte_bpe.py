"""Byte-level BPE: equal to the tiktoken library and to plain merging, and defined cases."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tabfold.llm.byte_bpe import ByteBPE, Codec, encode_byte_bpe, merged, read_ranks

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(FILE)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain(ranks, piece: bytes) -> list[int]:
    return [ranks[piece]] if piece in ranks else [ranks[t] for t in merged(ranks, piece)]


ALPHABET = ["a", "é", " ", " ", "\n", "\t", "it's", "12", "!!", "漢", " ", "\x1c", "\x85", "　", "<|endoftext|>", "word", "'ll", "\r\n", "the", "Ġ", "​", "😀", "aaaa", "====", "ing"]


def texts(seed, n):
    rng = np.random.default_rng(seed)
    return ["", " ", "  ", "a ", " a", "a  b   c", "x \n y", "\x01", "a" * 3000, "-" * 3000, "ab" * 1500] + ["".join(rng.choice(ALPHABET, rng.integers(1, 30))) for _ in range(n)]


def test_equal_to_the_library(ranks, library):
    codec = Codec(ranks, public_tokenizers.PATTERN)
    given = texts(3, 3000)
    ids, n = codec.encode(given)
    parts = np.split(ids, np.cumsum(n)[:-1])
    for t, p in zip(given, parts):
        assert p.tolist() == library.encode_ordinary(t), repr(t)
        assert codec.encode_text(t) == p.tolist(), repr(t)
    assert codec.decode(ids, np.cumsum(n)) == [t.encode() for t in given]


def test_random_bytes(ranks):
    bpe, rng = ByteBPE(ranks), np.random.default_rng(5)
    tokens = sorted(ranks)
    for _ in range(1500):
        if rng.random() < 0.5:
            piece = b"".join(tokens[k] for k in rng.integers(0, len(tokens), rng.integers(1, 8)))
        else:
            piece = bytes(rng.choice([32, 97, 98, 101, 45, 195, 169, 240], rng.integers(1, 25)).astype(np.uint8))
        assert bpe.encode_piece(piece) == plain(ranks, piece), piece


def test_small_vocabularies():
    """Made tables over two letters, each entry of two neighbours in some merged text,
    make ties and long chains of backtracking."""
    rng = np.random.default_rng(7)
    letters = lambda most: bytes(rng.choice([97, 98], rng.integers(2, most)).astype(np.uint8))
    for _ in range(80):
        ranks = {bytes([b]): b for b in range(256)}
        while len(ranks) < 256 + 14:
            parts = merged(ranks, letters(30))
            if len(parts) > 1:
                k = rng.integers(len(parts) - 1)
                ranks[parts[k] + parts[k + 1]] = len(ranks)
        ranks.setdefault(b"abbaabbaabbaab", len(ranks))  # an entry that merges may not give
        bpe = ByteBPE(ranks)
        for _ in range(80):
            piece = letters(40)
            assert bpe.encode_piece(piece) == plain(ranks, piece), (ranks, piece)
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257}
    with pytest.raises(ValueError):
        ByteBPE(ranks)


def test_forgotten_pairs_change_nothing(ranks, monkeypatch):
    monkeypatch.setattr("tabfold.llm.byte_bpe.MEMO", 2)
    codec, whole = Codec(ranks, public_tokenizers.PATTERN), Codec(ranks, r".+|\n+")
    given = texts(9, 50)
    assert codec.encode(given)[0].tolist() == sum(map(codec.encode_text, given), [])
    assert whole.chunks is None and whole.encode(["ab cd", None])[1].tolist()[1] == 0


def test_table(spark, library):
    rows = [(None, "null key", 1), (7, None, None), (7, "", 3), (8, "same", 4), (8, "same", 4), (9, "é <|endoftext|> " * 20_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS int")
    out = encode_byte_bpe(docs, FILE)
    assert out.columns == ["doc_id", "text", "IDS_in", "ids", "n_tokens", "decoded"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode_ordinary(r.text or "")
        assert r.ids == want and r.n_tokens == len(want) and bytes(r.decoded) == (r.text or "").encode()
    assert encode_byte_bpe(docs.where("false"), FILE).count() == 0


def test_query(spark, library):
    from tabfold.llm.queries import op13_byte_bpe

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op13_byte_bpe(spark, sf).collect()}
    ids = {d: library.encode_ordinary(t) for d, t in docs.items()}
    assert got == {d: (len(ids[d]), sha(" ".join(map(str, ids[d])).encode()), sha(t.encode())) for d, t in docs.items()}
