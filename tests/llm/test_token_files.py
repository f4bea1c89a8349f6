"""Token files: exact round trip against the library, index and defined cases."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabfold.llm.common import scratch_path
from tabfold.llm.token_files import build_mph, byte_bpe_encoder, lookup_part, mph_slot, pack_part, read_documents, write_token_files

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return t


def test_chunks_give_the_librarys_ids(tokenizer):
    rng = np.random.default_rng(2)
    alphabet = ["a", "é", " ", " ", "\n", "\t", "it's", "12", "!!", "漢", " ", "\x1c", "\x85", "　", "<|endoftext|>", "word", "'ll", "\r\n"]
    texts = ["", " ", "  ", "a ", " a", "a  b   c", "x \n y", "a" * 5000] + ["".join(rng.choice(alphabet, rng.integers(1, 30))) for _ in range(3000)]
    ids, n = byte_bpe_encoder(FILE)(texts)
    parts = np.split(ids, np.cumsum(n)[:-1])
    for t, p, e in zip(texts, parts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert p.tolist() == e.ids, repr(t)


def test_memory_limit_changes_nothing():
    encode = byte_bpe_encoder(FILE)
    texts = [f"one w{i} two" for i in range(200)]
    want = encode(texts)[0].tolist()
    encode.most, encode.longest, before = 5, 3, (encode.most, encode.longest)
    try:
        assert sum((encode([t])[0].tolist() for t in texts), []) == want
    finally:
        encode.most, encode.longest = before


def test_perfect_hash():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 17, 1000, 30_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        salt, seeds = build_mph(keys)
        assert np.array_equal(np.sort(mph_slot(keys, len(keys), salt, seeds)), np.arange(len(keys)))
        data = pack_part(keys, np.arange(len(keys)), np.ones(len(keys)))
        first, count = lookup_part(data, keys)
        assert np.array_equal(first, np.arange(len(keys))) and (count == 1).all()
        assert lookup_part(data, ~keys)[1].sum() <= 1  # unknown keys fail their fingerprint
    keys = np.arange(5000, dtype=np.uint64)
    assert len(set(mph_slot(keys, 5000, *build_mph(keys)))) == 5000


def check(spark, docs, tokenizer, **how):
    path = scratch_path(spark, "token-files-test")
    shards = write_token_files(docs, FILE, path, **how)
    got = sorted(read_documents(docs, "doc_id", shards, path).collect(), key=lambda r: r.doc)
    rows = docs.select("doc_id", "text").collect()
    ids = {t: tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in {r.text or "" for r in rows}}
    want = sorted((r.doc_id if r.doc_id is not None else -(1 << 63), zlib.crc32(np.array(ids[r.text or ""], "<u4").tobytes())) for r in rows)
    assert sorted((r.key, zlib.crc32(r.ids)) for r in got) == want
    assert [r.key for r in got] == sorted(r.key for r in got)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    return shards


def test_round_trip(spark, documents, tokenizer):
    shards = check(spark, documents, tokenizer, shard_bytes=60_000, part_keys=50)
    assert shards.count() > 3


def test_edge_cases(spark, tokenizer):
    rows = [(None, "null key"), (None, None), (7, ""), (7, "b"), (7, "a"), (7, "a"), (-3, "é " * 40_000), (1 << 62, " x ")] + [(5, f"same key {i}") for i in range(400)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    check(spark, docs, tokenizer, shard_bytes=2_000, part_keys=2)
    path = scratch_path(spark, "token-files-test")
    assert write_token_files(docs.where("false"), FILE, path).count() == 0
    shards = write_token_files(docs, FILE, path)
    assert read_documents(spark.createDataFrame([(12345,)], "doc_id long"), "doc_id", shards, path).count() == 0
