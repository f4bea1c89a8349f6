"""Token-id output: raw id payloads with a minimal perfect hash index over the keys.

Layout below ``path``: ``payload/shard-K.bin`` holds the ids of the shard's
documents as little-endian unsigned integers, one document after the other, of 16
bits where the vocabulary fits, else 32; ``payload/shard-K.idx`` the offsets (in ids,
one more than documents, unsigned 64-bit), ``index/part-K.mph`` the index of the keys
that hash to part K and ``index/meta.json`` the number of parts and the width of ids.
"""

from __future__ import annotations

import io
import json
import math
import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabfold.llm.chunks import ChunkEncoder, Ids, by_bytes, ids_of, joined_ids, library_threads, mixed
from tabfold.llm.common import stored

SHARD_BYTES = 24 << 20  #: text bytes of a shard on average
PART_KEYS = 1 << 18  #: keys of an index part on average
GROUP = 2  #: keys that share a seed in the hash index, on average

_ENCODERS: dict[str, ChunkEncoder] = {}


#: marks the first chunk of a text, which no space precedes
FIRST = "\x01"
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: texts that are not plain: white space twice in a row or at an end, or the mark itself
ODD = f"{_SPACE}{_SPACE}|^{_SPACE}|{_SPACE}$|{FIRST}"


def byte_bpe_split(texts: pa.Array) -> pa.Array:
    """Chunks at single spaces and before single line ends, each between two
    characters that are no white space: the byte-level pattern starts a new token
    at each of them. Chunks are without the space before them; the first has a
    mark, others may begin with their line end."""
    marked = pc.binary_join_element_wise(FIRST, pc.replace_substring(texts, "\n", " \n"), "")
    return pc.split_pattern(marked, " ")


def byte_bpe_split_odd(text: str) -> list[str]:
    if FIRST in text:
        return [FIRST + text]
    parts = re.split(r"(?<=\S) (?=\S)", text)
    return [FIRST + parts[0], *parts[1:]]


def byte_bpe_encoder(tokenizer_file: str) -> ChunkEncoder:
    """One encoder for each Python worker; special tokens in a text are ordinary text."""
    if tokenizer_file not in _ENCODERS:
        library_threads(1)
        tokenizer = Tokenizer.from_file(tokenizer_file)
        tokenizer.encode_special_tokens = True
        opens = {c: np.zeros(tokenizer.get_vocab_size(), bool) for c in "ĠĊ"}  # how a space and a line end are written
        for token, i in tokenizer.get_vocab().items():
            if token[0] in opens:
                opens[token[0]][i] = True

        def library(texts: list[str]) -> list[list[int]]:
            # the same ids as encode_batch, without their places in the text
            return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        def kind_of(c: str) -> int:
            """0: after a space, 1: after a line end, 2: neither, or with white space at its ends."""
            if c[0] == FIRST:
                return 2
            core = c.strip()
            return 0 if c == core else 1 if c[0] == "\n" and c[1:] == core != "" else 2

        def encode(chunks: list[str]) -> Ids:
            kind = np.array([kind_of(c) for c in chunks], np.int8)
            some = lambda k: [c for c, x in zip(chunks, kind) if x == k]
            spaced = joined_ids(some(0), " ", library, opens["Ġ"])
            lines = joined_ids([c[1:] for c in some(1)], "\n", library, opens["Ċ"])
            rest = ids_of(library([c[1:] if c[0] == FIRST else c if c[0] == "\n" else " " + c for c in some(2)]))
            return mixed(kind == 0, spaced, mixed((kind == 1)[kind != 0], lines, rest))

        _ENCODERS[tokenizer_file] = ChunkEncoder(encode, byte_bpe_split, ODD, byte_bpe_split_odd)
    return _ENCODERS[tokenizer_file]


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared-folder URI, as seen by any task."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def put(path: str, data) -> None:
    """Write a file under a name of its own and move it into place, so that a task
    that runs again, or twice at once, leaves one whole file."""
    fs, p = opened(path)
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    part = f"{p}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, p)


def get(path: str) -> bytes:
    fs, p = opened(path)
    with fs.open_input_stream(p) as f:
        return f.read()


# ---- minimal perfect hash ----

def mix(x: np.ndarray, seed) -> np.ndarray:
    """Seeded 64-bit finaliser over unsigned keys."""
    with np.errstate(over="ignore"):
        x = x ^ (np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def blocks(groups: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of groups of one size, at most 4096 groups each."""
    cuts = np.flatnonzero(np.diff(size[groups])) + 1
    for run in np.split(groups, cuts):
        for at in range(0, len(run), 4096):
            yield run[at:at + 4096]


def build_mph(keys: np.ndarray) -> tuple[int, np.ndarray]:
    """(salt, one number for each group) such that ``mph_slot`` maps the distinct
    unsigned keys onto 0 .. n-1 one to one. Groups of keys, largest first, take the
    first seed that puts all their keys on free slots; a group of one key takes a
    free slot by its number, stored as ``-1 - slot``."""
    n = len(keys)
    groups = max(1, -(-n // GROUP))
    owner = np.full(n, n, np.int64)
    for salt in range(1, 64):
        group = (mix(keys, salt) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        size = np.bincount(group, minlength=groups)
        start = np.cumsum(size) - size
        seeds, free = np.zeros(groups, np.int32), np.ones(n, bool)
        largest_first = np.argsort(-size, kind="stable")
        left = largest_first[:0]
        for left in blocks(largest_first[:int((size > 1).sum())], size):  # a block tries seed after seed; groups that collide stay
            for seed in range(1, 1 << 17):
                of = np.repeat(np.arange(len(left)), size[left])
                k = order[np.arange(len(of)) + np.repeat(start[left] - (np.cumsum(size[left]) - size[left]), size[left])]
                slot = (mix(keys[k], seed + (salt << 24)) % np.uint64(n)).astype(np.int64)
                np.minimum.at(owner, slot, of)
                lost = ~free[slot] | (owner[slot] != of)
                owner[slot] = n
                by = np.lexsort((slot, of))  # two keys of one group on one slot
                lost[by[1:]] |= (slot[by][1:] == slot[by][:-1]) & (of[by][1:] == of[by][:-1])
                bad = np.bincount(of, weights=lost, minlength=len(left)) > 0
                free[slot[~bad[of]]] = False
                seeds[left[~bad]] = seed
                left = left[bad]
                if not len(left):
                    break
            if len(left):
                break
        if not len(left):
            seeds[size == 1] = -1 - np.flatnonzero(free)
            return salt, seeds
    raise ValueError("no perfect hash found: the keys are not distinct")


def mph_slot(keys: np.ndarray, n: int, salt: int, seeds: np.ndarray) -> np.ndarray:
    """Slot of each key: two hashes and one look-up, whatever the number of keys."""
    seed = seeds[(mix(keys, salt) % np.uint64(len(seeds))).astype(np.int64)].astype(np.int64)
    hashed = (mix(keys, (seed + (salt << 24)).astype(np.uint64)) % np.uint64(n)).astype(np.int64)
    return np.where(seed < 0, -1 - seed, hashed)


HEAD = struct.Struct("<QQQ")
ENTRY = np.dtype([("print", "<u4"), ("first", "<u8"), ("count", "<u4")])


def pack_part(keys: np.ndarray, first: np.ndarray, count: np.ndarray) -> bytes:
    salt, seeds = build_mph(keys)
    table = np.zeros(len(keys), ENTRY)
    slot = mph_slot(keys, len(keys), salt, seeds)
    table["print"][slot] = mix(keys, 0xF1) >> np.uint64(32)
    table["first"][slot], table["count"][slot] = first, count
    return HEAD.pack(len(keys), salt, len(seeds)) + seeds.astype("<i4").tobytes() + table.tobytes()


def lookup_part(data: bytes, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first document, number of documents) of each key; 0 documents for a key
    whose stored fingerprint differs, so which is not in the index."""
    n, salt, groups = HEAD.unpack_from(data)
    seeds = np.frombuffer(data, "<i4", groups, HEAD.size)
    table = np.frombuffer(data, ENTRY, n, HEAD.size + 4 * groups)
    row = table[mph_slot(keys, n, salt, seeds)]
    known = row["print"] == mix(keys, 0xF1) >> np.uint64(32)
    return np.where(known, row["first"], 0).astype(np.int64), np.where(known, row["count"], 0).astype(np.int64)


def key_code(key):
    """Key of the index: a long, where a null key has a value that no other key of
    the table has (the smallest long)."""
    return F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))


# ---- writing ----

def write_token_files(docs: DataFrame, tokenizer_file: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = 0,
                      shard_bytes: int = SHARD_BYTES, part_keys: int = PART_KEYS) -> DataFrame:
    """Encode the whole texts, append ``end_id`` to each and write payload and index
    below ``path`` (a URI that every task can reach, see ``opened``).

    Documents lie in ascending key order (null first; equal keys in order of text).
    Ranges of keys are the shards; each task sorts, encodes and writes one shard, so
    a lost task writes the same file again. The returned shard table (shard, n_docs,
    n_ids, first_doc, start) has one row for each shard; first_doc and start count
    the documents and ids of the shards before it. A key that repeats is one index
    entry: its first document and how many there are.

    Defined cases: a null text is an empty one, which has the end id alone; an empty
    table writes no files and gives no rows; all keys but null must be above the
    smallest long; other columns are not written.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 1)).first()[0]
    if not size:
        return spark.createDataFrame([], "shard int, n_docs long, n_ids long, first_doc long, start long")
    n_shards = max(1, math.ceil(size / shard_bytes))
    vocabulary = Tokenizer.from_file(tokenizer_file).get_vocab_size()
    width = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = byte_bpe_encoder(tokenizer_file), TaskContext.get().partitionId()
        payload, sizes, keys = io.BytesIO(), [], []
        for part in by_bytes(batches, 1):
            ids, n = encode(part.column(1))
            ends = np.cumsum(n + 1)
            out = np.full(len(ids) + len(n), end_id, width)
            text = np.ones(len(out), bool)
            text[ends - 1] = False
            out[text] = ids
            payload.write(out.tobytes())
            sizes.append(n + 1)
            keys.append(part.column(0).to_numpy())
        encode.keep([])  # the worker goes on to other work
        if not sizes:
            return
        sizes, keys = np.concatenate(sizes), np.concatenate(keys)
        put(f"{path}/payload/shard-{shard}.bin", payload.getbuffer())
        put(f"{path}/payload/shard-{shard}.idx", np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes())
        # one row for each run of a key, and one for the shard
        head = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(head), shard, np.int32)), pa.array(keys[head]), pa.array(head), pa.array(np.diff(np.append(head, len(keys)))), pa.nulls(len(head), pa.int64())], names=["shard", "key", "first", "count", "n_ids"])
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.nulls(1, pa.int64()), pa.array([0]), pa.array([len(keys)]), pa.array([int(sizes.sum())])], names=["shard", "key", "first", "count", "n_ids"])

    rows = docs.select(key_code(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(n_shards, "key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"), "text")
    written = stored(ordered.mapInArrow(write, "shard int, key long, first long, count long, n_ids long"), "runs")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    shards = written.where("key is null").select("shard", F.col("count").alias("n_docs"), "n_ids")
    shards = stored(shards.select("*", F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("first_doc"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start")), "shards")
    n_parts = max(1, math.ceil(written.count() / part_keys))
    runs = written.where("key is not null").join(F.broadcast(shards.select("shard", "first_doc")), "shard")
    entries = runs.groupBy("key").agg(F.min(F.col("first") + F.col("first_doc")).alias("first"), F.sum("count").alias("count"))

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        put(f"{path}/index/part-{pdf['part'].iloc[0]}.mph", pack_part(pdf["key"].to_numpy().view(np.uint64), pdf["first"].to_numpy(), pdf["count"].to_numpy()))
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "n": [len(pdf)]})

    done = entries.withColumn("part", part_of(F.col("key"), n_parts)).groupBy("part").applyInPandas(index, "part int, n long")
    put(f"{path}/index/meta.json", json.dumps({"parts": n_parts, "width": width}).encode())
    stored(done, "parts")
    return shards


def part_of(key, n_parts):
    return F.pmod(F.xxhash64(key), F.lit(n_parts)).cast("int")


# ---- reading ----

def read_documents(keys: DataFrame, key: str, shards: DataFrame, path: str) -> DataFrame:
    """Documents of the given keys from the files: (key, doc, start, n_tokens, ids),
    one row for each document of a key, none for a key that the index does not know.
    ``doc`` counts documents from 0 in file order, ``start`` the ids of all before
    it; ``ids`` are little-endian unsigned 32-bit integers.

    Each key costs one look-up in its index part and one slice of a payload; keys
    are dealt out by index part, then by shard."""
    meta = json.loads(get(f"{path}/index/meta.json"))
    n_parts, width = meta["parts"], meta["width"]

    def look_up(pdf: pd.DataFrame) -> pd.DataFrame:
        first, count = lookup_part(get(f"{path}/index/part-{pdf['part'].iloc[0]}.mph"), pdf["key"].to_numpy().view(np.uint64))
        return pdf[["key"]].assign(first=first, count=count)[count > 0]

    asked = keys.select(key_code(key).alias("key")).distinct().withColumn("part", part_of(F.col("key"), n_parts))
    found = asked.groupBy("part").applyInPandas(look_up, "key long, first long, count long")
    docs = found.select("key", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("doc"))
    # a range join by binary search in the shards' first documents: one long for each shard
    firsts = shards.orderBy("first_doc").select("shard", "first_doc", "start").collect()
    base, name = np.array([r["first_doc"] for r in firsts]), np.array([r["shard"] for r in firsts])
    start = np.array([r["start"] for r in firsts])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            i = np.searchsorted(base, b["doc"], side="right") - 1
            yield b.assign(shard=name[i], at=b["doc"] - base[i], shard_start=start[i])

    placed = docs.mapInPandas(place, "key long, doc long, shard int, at long, shard_start long")

    def read_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = pdf["shard"].iloc[0]
        ids = np.frombuffer(get(f"{path}/payload/shard-{shard}.bin"), width)
        offsets = np.frombuffer(get(f"{path}/payload/shard-{shard}.idx"), "<u8").astype(np.int64)
        a, z = offsets[pdf["at"]], offsets[pdf["at"] + 1]
        return pd.DataFrame({"key": pdf["key"], "doc": pdf["doc"], "start": pdf["shard_start"] + a, "n_tokens": z - a,
                             "ids": [ids[i:j].astype("<u4").tobytes() for i, j in zip(a, z)]})

    return placed.groupBy("shard").applyInPandas(read_shard, "key long, doc long, start long, n_tokens long, ids binary")
