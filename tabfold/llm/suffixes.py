"""Suffix-array dedup: bytes covered by a string that starts anywhere else, too.

Two suffixes tie for ``length`` bytes just if their first ``length`` bytes are equal, and a
byte is repeated if a tied suffix covers it. The blockwise construction finds all ties
with bounded memory:

1. Cover sample: positions whose remainder by ``V`` is in a difference cover. For any
   two positions some distance below ``V`` leads both to sampled positions, so two
   suffixes that tie for ``length`` bytes lead to sampled suffixes that tie for
   ``length - V + 1``. The sampled suffixes' ties (their ranks, equal or not) are found
   bucket by bucket.
2. Suffixes with no tied sampled suffix in reach have no long tie. The others are put
   into buckets by the key of their first ``length`` bytes and sorted one bucket at a
   time, each in a task.

Ranks are needed for equality alone, so keys are hashes of the strings, not the strings
in their order.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfold.llm.common import dropped, release, stored

LENGTH = 200
#: a perfect difference set: every remainder is the difference of two of these
V, COVER = 133, (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
BLOCK_BYTES = 2 << 20  #: text bytes of a block; the arrays of a task take about 50 times as much, 100 times where all of it repeats
BUCKET_KEYS = 3 << 20  #: keys of a bucket on average
BROADCAST_ROWS = 300_000  #: rows of about 100 bytes that are broadcast at most
WIDE_FROM = 1 << 28  #: long ties from which keys have 128 bits, not 64
BROADCAST_BYTES = 64 << 20  #: bytes of answers that are broadcast at most

_rng = np.random.default_rng(20240517)
_BYTE = [_rng.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1) for _ in range(2)]
_BASE = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2, ... by doubling, modulo 2 ** 64."""
    out = _POWERS.get(base, np.ones(1, np.uint64))
    if len(out) < n:
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
        if n <= 2 * BLOCK_BYTES:
            _POWERS[base] = out
    return out[:n]


Keys = tuple[np.ndarray, ...]  #: one or two columns of 64 bits


def in_order(keys: Keys) -> tuple[np.ndarray, np.ndarray]:
    """(order of the keys, whether each in that order differs from the one before)."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    return order, new


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each pair of a first number and a count."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


class Block:
    """Texts one after the other, as read from the table of blocks."""

    def __init__(self, data: bytes, sizes: list[int]):
        self.data = np.frombuffer(data, np.uint8)
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.sums: dict[int, np.ndarray] = {}

    def keys(self, at: np.ndarray, length: int, wide: bool = False) -> Keys:
        """Keys of the strings of ``length`` bytes at ``at``, 64 bits or 128: polynomials
        over random values of the bytes, by prefix sums, then mixed."""
        out = []
        for w in range(1 + wide):
            n, base = len(self.data), _BASE[w]
            if w not in self.sums:
                self.sums[w] = np.zeros(n + 1, np.uint64)
                np.cumsum(_BYTE[w][self.data] * powers(base, n), out=self.sums[w][1:])
            x = (self.sums[w][at + length] - self.sums[w][at]) * powers(pow(base, -1, 1 << 64), n)[at]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            out.append(x ^ (x >> np.uint64(29)))
        return tuple(out)

    def sampled(self, length: int) -> np.ndarray:
        """Positions of the cover sample whose string of ``length - V + 1`` bytes fits."""
        last = self.sizes - (length - V + 1)
        cover = np.array(sorted(COVER), np.int64)
        turns = max(int(last.max(initial=-1)), -1) // V + 1
        inside = (np.arange(turns)[:, None] * V + cover).ravel()
        count = np.searchsorted(inside, last, side="right")
        return np.repeat(self.starts, count) + inside[spread(np.zeros(len(count), np.int64), count)]

    def long_ties(self, length: int, tied: np.ndarray) -> np.ndarray:
        """Positions whose string of ``length`` bytes fits and that have a tied sampled
        position less than ``V`` ahead in their text; ``tied`` is in order."""
        text = np.searchsorted(self.ends, tied, side="right")
        first = np.maximum(tied - V + 1, self.starts[text])
        first[1:] = np.maximum(first[1:], tied[:-1] + 1)
        count = np.minimum(tied, self.ends[text] - length) - first + 1
        return spread(first, np.maximum(count, 0))


def dealt(keys: Keys, buckets: int) -> tuple[Keys, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, where each bucket begins, how often each key occurs,
    which distinct key each key is): within a block a key goes out once, however
    often it occurs. Buckets are ranges of keys."""
    order, new = in_order(keys)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    distinct = tuple(k[order][new] for k in keys)
    bucket = ((distinct[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    return distinct, np.searchsorted(bucket, np.arange(buckets + 1)), np.bincount(which, minlength=len(distinct[0])), which


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def tied_keys(blocks: DataFrame, keys: Callable[[dict], Keys], wide: bool, total: int) -> tuple[DataFrame, int]:
    """((block, ties, n), number of buckets): ``keys(block row)`` of all blocks are sorted one bucket at a time;
    the answer has, for each block and bucket, a bit for each of the block's distinct
    keys: whether it occurs anywhere else; n counts those that do."""
    buckets = max(1, math.ceil(total / BUCKET_KEYS))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            distinct, cut, times, _ = dealt(keys(row), buckets)
            part = [slice(cut[j], cut[j + 1]) for j in range(buckets)]
            full = [j for j in range(buckets) if part[j].start < part[j].stop]
            if full:
                columns = [[d[part[j]].tobytes() for j in full] for d in distinct] + [[np.packbits(times[part[j]] > 1).tobytes() for j in full]]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([row["block"]] * len(full), pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "block", *(f"k{w}" for w in range(1 + wide)), "often"])

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        every = tuple(np.frombuffer(b"".join(pdf[f"k{w}"]), np.uint64) for w in range(1 + wide))
        sizes = [len(x) // 8 for x in pdf["k0"]]
        tie = np.concatenate([np.unpackbits(np.frombuffer(o, np.uint8), count=n) for o, n in zip(pdf["often"], sizes)]).astype(bool)
        order, new = in_order(every)
        same = ~new[1:]
        tie[order[1:][same]] = True
        tie[order[:-1][same]] = True
        parts = np.split(tie, np.cumsum(sizes)[:-1])
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "ties": [np.packbits(t).tobytes() for t in parts], "n": [int(t.sum()) for t in parts]})

    sent = blocks.mapInArrow(send, "bucket int, block long, k0 binary, " + "k1 binary, " * int(wide) + "often binary")
    ties = sent.groupBy("bucket").applyInPandas(sort, "block long, bucket int, ties binary, n long")
    return stored(ties.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "ties"))).alias("ties"), F.sum("n").alias("n")), "ties"), buckets


def read_ties(keys: Keys, answer: list[dict] | None, buckets: int) -> np.ndarray:
    """For each of a block's keys whether it occurs anywhere else."""
    distinct, cut, _, which = dealt(keys, buckets)
    tie = np.zeros(len(distinct[0]), bool)
    for a in answer or []:
        part = slice(cut[a["bucket"]], cut[a["bucket"] + 1])
        tie[part] = np.unpackbits(np.frombuffer(a["ties"], np.uint8), count=part.stop - part.start)
    return tie[which]


def with_answers(blocks: DataFrame, ties: DataFrame, name: str) -> DataFrame:
    """``blocks`` with the answers of their keys: broadcast while they are small, a bit a key."""
    size = ties.agg(F.sum(F.aggregate("ties", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t["ties"])))).first()[0] or 0
    ties = ties.select("block", F.col("ties").alias(name))
    return blocks.join(F.broadcast(ties) if size <= BROADCAST_BYTES else ties, "block", "left")


def covered(block: Block, at: np.ndarray, length: int) -> np.ndarray:
    """Mask of the bytes that a string of ``length`` bytes from one of ``at`` covers."""
    n = len(block.data)
    step = np.bincount(at, minlength=n + 1) - np.bincount(at + length, minlength=n + 1)
    return np.cumsum(step[:-1]) > 0


def text_blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, sizes, data): the documents (id, text) of each task in blocks of about
    ``BLOCK_BYTES``, a longer text in a block of its own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId() << 32, 0
        ids, data, size = [], [], 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([part + n], pa.int64()), pa.array([ids], pa.list_(pa.string())), pa.array([[len(d) for d in data]], pa.list_(pa.int64())), pa.array([b"".join(data)], pa.binary())], names=["block", "ids", "sizes", "data"])

        for b in batches:
            for k in range(0, b.num_rows, 256):
                for i, t in zip(b.column(0).slice(k, 256).to_pylist(), b.column(1).slice(k, 256).to_pylist()):
                    if size and size + len(t) > BLOCK_BYTES:
                        yield block()
                        n, ids, data, size = n + 1, [], [], 0
                    ids.append(i)
                    data.append(t)
                    size += len(t)
        if ids:
            yield block()

    return docs.mapInArrow(pack, "block long, ids array<string>, sizes array<long>, data binary")


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep_text: bool = True) -> DataFrame:
    """Each document without the bytes that a string of ``length`` bytes covers which also
    starts anywhere else in ``docs``, the same document included: (key, n_bytes,
    n_removed, n_spans, kept_sha256, kept). Strings are judged on the whole input;
    texts are UTF-8 bytes; kept (binary) is what is left, joined.

    Equal texts are one class: its bytes are all removed where it has ``length`` bytes and
    two documents, and one of them stands for it in the construction (copies take part
    as they are where there are too many to broadcast their keys; that changes
    nothing but the work). A string that a third of all texts share goes out once from
    each block of texts, so no bucket grows with it.

    Keys have 64 bits up to about 2 ** 28 long ties (estimated from the tied samples), beyond
    it 128. Defined cases: a null text is
    an empty one; texts below ``length`` bytes keep all; a null key and repeated rows each
    come back; an empty table gives no rows; a text over 2 GB is beyond the method
    (a row's limit); other columns are not read. Set ``keep_text=False`` to leave kept out.
    """
    if length <= V:
        raise ValueError(f"strings must be longer than {V} bytes")
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    sha = F.sha2(raw, 256)
    base = stored(docs.select(F.col(key).alias("key"), F.octet_length(raw).cast("long").alias("n_bytes"), sha.alias("sha")), "base")
    classes = stored(base.groupBy("sha").agg(F.count("*").alias("times"), F.min("key").alias("least")), "classes")
    copies = base.join(classes.where("times > 1"), "sha").where(~F.col("key").eqNullSafe(F.col("least"))).select("sha", F.col("key").alias("k")).distinct()
    few = copies.count() <= BROADCAST_ROWS
    rows = docs.select(F.col(key).alias("key"), sha.alias("id"), raw.alias("text")).where(F.octet_length("text") >= length)
    if few:
        rows = rows.join(F.broadcast(copies), (F.col("id") == F.col("sha")) & F.col("key").eqNullSafe(F.col("k")), "left_anti")
    blocks = stored(text_blocks(rows.select("id", "text")), "blocks", long_rows=True)
    n_sampled = (blocks.agg(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0) * len(COVER) // V

    def sample_keys(row: dict) -> Keys:
        block = Block(row["data"], row["sizes"])
        return block.keys(block.sampled(length), length - V + 1)

    data = blocks.select("block", "sizes", "data")
    ranks, buckets = tied_keys(data, sample_keys, False, n_sampled)
    release(spark)

    def candidates(row: dict) -> tuple[Block, np.ndarray]:
        block = Block(row["data"], row["sizes"])
        at = block.sampled(length)
        tie = read_ties(block.keys(at, length - V + 1), row["ranks"], buckets)
        return block, block.long_ties(length, at[tie])

    known = with_answers(data, ranks, "ranks")

    # in a run of ties every sampled position is tied, at its edges few are: about twice the run's share
    n_tied = ranks.agg(F.sum("n")).first()[0] or 0
    n_long = 2 * n_tied * V // len(COVER)
    wide = n_long > WIDE_FROM

    def long_keys(row: dict) -> Keys:
        block, at = candidates(row)
        return block.keys(at, length, wide)

    ties, long_buckets = tied_keys(known, long_keys, wide, n_long)
    release(spark)
    known = with_answers(with_answers(blocks, ranks, "ranks"), ties, "ties")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block, at = candidates(row)
            gone = covered(block, at[read_ties(block.keys(at, length, wide), row["ties"], long_buckets)], length)
            out = []
            for a, z in zip(block.starts, block.ends):
                g = gone[a:z]
                left = block.data[a:z][~g].tobytes()
                out.append((int(g.sum()), int(g[0]) + int((g[1:] & ~g[:-1]).sum()), hashlib.sha256(left).hexdigest(), left if keep_text else None))
            n, spans, shas, left = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"]), pa.array(n, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas), pa.array(left, pa.binary())], names=["id", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = stored(known.mapInArrow(remove, "id string, n_removed long, n_spans long, kept_sha256 string, kept binary"), "kept")
    for t in (ranks, ties, blocks):
        dropped(t)
    # a class of one document takes its own result; of several, all goes or, below the length, nothing
    single = base.join(classes.where("times = 1").select("sha"), "sha", "left_semi")
    found = single.join(done, single["sha"] == done["id"], "left")
    whole = F.col("n_bytes") >= length
    out = found.select("key", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept", "sha")
    several = base.join(classes.where("times > 1").select("sha"), "sha").select("key", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(0).alias("n_removed"), F.when(whole, 1).otherwise(0).cast("long").alias("n_spans"),
                                                                                F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.col("sha")).alias("kept_sha256"), F.when(whole, F.lit(b"")).alias("kept"), "sha")
    out = out.union(several)
    if keep_text:
        short = docs.select(sha.alias("s"), raw.alias("raw")).where(F.octet_length("raw") < length).dropDuplicates(["s"])
        out = out.join(short, F.col("sha") == F.col("s"), "left").withColumn("kept", F.coalesce("kept", "raw"))
        return out.select(F.col("key").alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    return out.select(F.col("key").alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256")
