"""SimHash near-dedup: fingerprints of word shingles and a binary-trie self-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfold.llm.common import components, dropped, set_aside, stored

OWN = ["fingerprint", "component_id"]
STEP = 4  #: trie levels that one node of the partition trie spans
SLICE = 1 << 14  #: shingles whose bits are counted at once


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of a whole text, unsigned: a bit is set if it is set in over
    half the XXH64 hashes (seed 42) of its word shingles, repeats included."""
    tokens = (text or "").encode().translate(_LOWER).split()  # bytes.split() splits at x20 and x09 to x0D
    if not tokens:
        return 0
    joined, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[words - 1:].tolist() if len(tokens) >= words else [len(joined)]
    digest, set_bits = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for k in range(0, n, SLICE):
        raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[k:k + SLICE], stops[k:k + SLICE])])
        set_bits += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > n).tobytes(), "big")


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def with_fingerprints(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(key, fp, text_hash): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                fps = np.fromiter((fingerprint(t, words) for t in part.column(1).to_pylist()), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64)), part.column(2)], names=["key", "fp", "text_hash"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    return rows.mapInArrow(run, "key long, fp long, text_hash long")


def prefix(fp, depth):
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(fp, 64 - depth)


def partition_trie(fps: DataFrame, most: int) -> list[tuple[int, int]]:
    """Leaves (depth, prefix) of the trie cut where a node holds at most ``most``
    fingerprints. Only node counts reach the driver: under 16 for each node that
    holds more than ``most``."""
    if fps.count() <= most:
        return [(0, 0)]
    leaves, heavy, depth = [], [0], 0
    while heavy:
        rows = fps.select(prefix(F.col("fp"), depth).alias("up"), prefix(F.col("fp"), depth + STEP).alias("p"))
        up = fps.sparkSession.createDataFrame([(h,) for h in heavy], "up long")
        depth += STEP
        counts = rows.join(F.broadcast(up), "up", "left_semi").groupBy("p").count().collect()
        leaves += [(depth, r["p"]) for r in counts if r["count"] <= most or depth == 64]
        heavy = [r["p"] for r in counts if r["count"] > most and depth < 64]
    return leaves


def leaf_pairs(leaves: list[tuple[int, int]], distance: int) -> list[tuple[int, int]]:
    """Pairs of leaves that can hold fingerprints ``distance`` apart: node pairs are
    traversed from the root, differing bits add up, pairs over budget are left."""
    index = {leaf: i for i, leaf in enumerate(leaves)}
    children: dict[tuple[int, int], set[tuple[int, int]]] = {}
    for node in leaves:
        while node[0] > 0:
            up = (node[0] - STEP, (node[1] % (1 << 64)) >> STEP)
            children.setdefault(up, set()).add(node)
            node = up
    children = {k: sorted(v) for k, v in children.items()}
    out, stack = [], [((0, 0), (0, 0), 0)]
    while stack:
        a, b, diff = stack.pop()
        a_leaf, b_leaf = a in index, b in index
        if a_leaf and b_leaf:
            out.append((index[a], index[b]))
        elif a_leaf:
            stack += [(a, y, diff) for y in children[b]]
        elif b_leaf:
            stack += [(x, b, diff) for x in children[a]]
        else:
            for i, x in enumerate(children[a]):
                for y in children[b][i:] if a == b else children[b]:
                    more = diff + ((x[1] ^ y[1]) & (1 << STEP) - 1).bit_count()
                    if more <= distance:
                        stack.append((x, y, more))
    return out


def close_pairs(a: np.ndarray, b: np.ndarray, distance: int, same: bool, block: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two sorted arrays of fingerprints at most ``distance`` bits
    apart, by a joint traversal of their binary tries. A node is a range of its
    array; node pairs carry their differing bits and go when those exceed
    ``distance``; small node pairs are compared directly. Node pairs are held in
    blocks, deepest first, so memory stays bounded. ``same``: a is b, each pair
    comes once."""
    ones: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def split(depth):
        if depth not in ones:
            shift = np.uint64(63 - depth)
            ones[depth] = tuple(np.concatenate([[0], np.cumsum((x >> shift & np.uint64(1)).astype(np.int64))]) for x in ((a,) if same else (a, b)))
        return ones[depth][0], ones[depth][-1]

    first = tuple(np.array([x], np.int64) for x in (0, len(a), 0, len(b), 0))
    stack = [(0, first)] if len(a) and len(b) else []
    while stack:
        depth, (al, ah, bl, bh, diff) = stack.pop()
        work = (ah - al) * (bh - bl)
        done = (work <= 64) | (depth == 64)
        if done.any():
            n, width = work[done], (bh - bl)[done]
            of = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = al[done][of] + at // width[of], bl[done][of] + at % width[of]
            near = np.bitwise_count(a[i] ^ b[j]) <= distance
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        if done.all():
            continue
        al, ah, bl, bh, diff = (x[~done] for x in (al, ah, bl, bh, diff))
        ca, cb = split(depth)
        am, bm = ah - (ca[ah] - ca[al]), bh - (cb[bh] - cb[bl])
        parts = [(al, am, bl, bm, diff), (am, ah, bm, bh, diff), (al, am, bm, bh, diff + 1), (am, ah, bl, bm, diff + 1)]
        if same:  # of a node paired with itself the two mixed pairs are one
            other = (al != bl) | (ah != bh)
            parts[3] = tuple(x[other] for x in parts[3])
        al, ah, bl, bh, diff = (np.concatenate(x) for x in zip(*parts))
        go = (ah > al) & (bh > bl) & (diff <= distance)
        node = [x[go] for x in (al, ah, bl, bh, diff)]
        stack += [(depth + 1, tuple(x[k:k + block] for x in node)) for k in range(0, len(node[0]), block)]


class Forest:
    """Union-find over 0..n-1 that keeps one parent per node."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def flatten(self) -> None:
        while True:
            top = self.up[self.up]
            if (top == self.up).all():
                return
            self.up = top

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        i, j = self.up[i], self.up[j]
        apart = i != j
        for x, y in np.unique(np.stack([i[apart], j[apart]], 1), axis=0).tolist():
            while self.up[x] != x:
                x = self.up[x]
            while self.up[y] != y:
                y = self.up[y]
            if x != y:
                self.up[max(x, y)] = min(x, y)
        self.flatten()


def trie_links(fps: DataFrame, distance: int, leaf_size: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect just those
    that chains of links up to ``distance`` bits connect. Each task takes one pair
    of trie leaves, at most ``2 * leaf_size`` fingerprints, and returns a spanning
    forest of the links it finds, never all pairs."""
    spark = fps.sparkSession
    leaves = partition_trie(fps, leaf_size)
    pairs = leaf_pairs(leaves, distance)
    options = F.array(*[F.struct(F.lit(d).alias("depth"), prefix(F.col("fp"), d).alias("p")) for d in sorted({d for d, _ in leaves})])
    parts = [(d, p, k, side, i == j) for k, (i, j) in enumerate(pairs) for side, (d, p) in enumerate({i: leaves[i], j: leaves[j]}.values())]
    where = spark.createDataFrame(parts, "depth int, p long, pair long, side int, same boolean")
    placed = fps.select("fp", F.explode(options).alias("o")).select("fp", "o.*")
    placed = placed.join(F.broadcast(where) if len(parts) <= 1 << 20 else where, ["depth", "p"]).select("fp", "pair", "side", "same")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, side = pdf["fp"].to_numpy().view(np.uint64), pdf["side"].to_numpy()
        same = bool(pdf["same"].iloc[0])
        a = np.sort(fp[side == 0])
        b = a if same else np.sort(fp[side == 1])
        both = a if same else np.concatenate([a, b])
        forest = Forest(len(both))
        for i, j in close_pairs(a, b, distance, same):
            forest.join(i, j if same else j + len(a))
        child = np.flatnonzero(forest.up != np.arange(len(both)))
        both = both.view(np.int64)
        return pd.DataFrame({"a": both[child], "b": both[forest.up[child]]})

    return placed.groupBy("pair").applyInPandas(run, "a long, b long")


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, distance: int = 2, leaf_size: int | None = None) -> DataFrame:
    """(key, fingerprint, component_id, text_hash) for each row of ``docs``.

    Fingerprints link at ``distance`` or fewer differing bits; component_id is the
    smallest key reachable over links, its own included. Documents of one
    fingerprint are one node of the join, so copies cost nothing there.
    ``leaf_size`` bounds the fingerprints of a trie leaf (default: a 64th of all,
    between 2^14 and 2^18); it does not change the result.

    Defined cases: a null or empty text has the fingerprint zero and links like
    any other; a null key takes part, and a component of null keys alone has a
    null component_id; repeated rows each come back; an empty table gives no rows.
    """
    marked = stored(with_fingerprints(docs, key, text, words), "fingerprints")
    by_fp = stored(marked.groupBy("fp").agg(F.min("key").alias("least")), "by_fp")
    fps = by_fp.select("fp")
    n = by_fp.count()
    size = leaf_size or min(1 << 18, max(1 << 14, n // 64))
    links = stored(trie_links(fps, distance, size), "links")
    group = components(links)
    grouped = by_fp.join(group, by_fp.fp == group.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    lowest = grouped.groupBy("c").agg(F.min("least").alias("component_id"))
    found = stored(grouped.join(lowest, "c").select("fp", "component_id"), "groups")
    dropped(links)
    dropped(by_fp)
    return marked.join(found, "fp").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash")


def simhash_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest key (null
    last; of equal keys the one with the smallest text hash; of repeated rows one).
    All columns are kept. Groups as in ``simhash_groups``."""
    groups = simhash_groups(set_aside(docs, OWN), key, text, words, distance)
    order = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("text_hash").alias("h"))
    # a component of null keys alone is named by no key: its fingerprint groups it
    name = F.coalesce(F.col("component_id").cast("string"), F.col("fingerprint"))
    kept = groups.groupBy(name.alias("c")).agg(F.min(order).alias("o")).select("o.k", "o.h")
    times = groups.groupBy(F.col(key).alias("k"), F.col("text_hash").alias("h")).agg(F.count("*").alias("times"))
    kept = stored(kept.alias("a").join(times.alias("b"), F.col("a.k").eqNullSafe(F.col("b.k")) & (F.col("a.h") == F.col("b.h"))).select("a.k", "a.h", "times"), "kept")
    rows = docs.withColumn("_h", F.xxhash64(F.col(text))).join(kept, F.col(key).cast("long").eqNullSafe(F.col("k")) & (F.col("_h") == F.col("h"))).drop("k", "h")
    single = rows.where("times = 1").drop("_h", "times")
    several = rows.where("times > 1").dropDuplicates([key, "_h"]).drop("_h", "times")
    return single.unionByName(several)
