"""SimHash near-dedup against brute force."""

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tabfold.llm.simhash import close_pairs, fingerprint, leaf_pairs, simhash_dedup, simhash_groups, trie_links


def slow_fingerprint(text):
    words, word = [], ""
    for ch in text or "":
        if ch in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
    words += [word] * bool(word)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def smallest(ids, fps, distance=2):
    """Component of each document by repeated relaxation over all pairs."""
    best = list(ids)
    changed = True
    while changed:
        changed = False
        for i, f in enumerate(fps):
            m = min(best[j] for j, g in enumerate(fps) if (f ^ g).bit_count() <= distance)
            if m < best[i]:
                best[i], changed = m, True
    return dict(zip(ids, best))


def test_fingerprint():
    for t in (None, "", "  \n ", "One", "One two", "A b c", "É A\tb\x0bc  d É\x85f", "a b c a b c a b c", "x " * 40_000):
        assert fingerprint(t) == slow_fingerprint(t)


def test_fingerprint_hash_is_sparks(spark):
    t = "one two É"
    assert spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(t.encode(), 42)


def random_fps(rng, n):
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    near = base[: n // 2].copy()
    for k in range(len(near)):
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    return np.unique(np.concatenate([base, near, np.array([0, 1, 3, 7, 1 << 63], np.uint64)]))


def test_traversal_finds_all_pairs():
    rng = np.random.default_rng(5)
    a, b = random_fps(rng, 300), random_fps(rng, 200)
    for same, x, y in ((True, a, a), (False, a, b), (False, a, np.unique(np.concatenate([b, a[:90] ^ np.uint64(5)])))):
        for block in (1 << 18, 50):
            found = sorted(p for i, j in close_pairs(x, y, 2, same, block) for p in zip(i.tolist(), j.tolist()))
            near = np.bitwise_count(x[:, None] ^ y[None, :]) <= 2
            want = sorted((i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near))) if not same or i < j)
            assert found == want


def test_leaf_pairs_cover():
    leaves = [(4, p) for p in range(15)] + [(8, 240 + p) for p in range(16)]
    got = {frozenset(x) for x in leaf_pairs(leaves, 1)}
    for i, (d, p) in enumerate(leaves):
        for j, (e, q) in enumerate(leaves):
            m = min(d, e)
            if ((p >> d - m) ^ (q >> e - m)).bit_count() <= 1:
                assert frozenset((i, j)) in got


def test_small_leaves_give_the_same_groups(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    want = smallest([r.doc_id for r in rows], [slow_fingerprint(r.text) for r in rows])
    for leaf in (None, 7):
        got = simhash_groups(documents, leaf_size=leaf).collect()
        assert {r.doc_id: r.component_id for r in got} == want
        assert all(int(r.fingerprint, 16) == slow_fingerprint(t.text) for r, t in zip(sorted(got), sorted(rows)))


def test_chain_links_distinct_fingerprints(spark):
    fps = [0, 3, 15, 1 << 40, -1]
    edges = trie_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2, 2).collect()
    assert {frozenset((e.a, e.b)) for e in edges} >= {frozenset((0, 3)), frozenset((3, 15)), frozenset((0, 1 << 40))}


def test_edge_cases(spark):
    rows = [(1, "a b c d", "s"), (2, None, "s"), (3, "", "s"), (None, "A B C D", None), (5, "a b c d", "s"), (5, "a b c d", "s"), (None, "lone words here now", "s"), (None, "lone words here now", "s"), (9, "w " * 30_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = simhash_groups(docs)
    assert got.count() == len(rows)
    by = {r.doc_id: r.component_id for r in got.where("doc_id is not null").collect()}
    assert by == {1: 1, 2: 2, 3: 2, 5: 1, 9: 9}
    kept = simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 9]
    empty = docs.where("false")
    assert simhash_groups(empty).count() == 0 and simhash_dedup(empty).count() == 0
