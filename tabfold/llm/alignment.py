"""Alignment of two tokenizers' ids of the same texts.

Both tokenize a whole text; byte offsets where a token of each ends cut it into groups,
and the tokens of a group are linked each with each. Where a shared end is followed by a
token of each that opens with a space, the text is cut into windows. A window's
groups follow from its ids alone, so they are found once for each pair of id tuples
and remembered in bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabfold.llm.chunks import ChunkEncoder, by_bytes, library_threads
from tabfold.llm.common import stored
from tabfold.llm.sentencepiece_codec import BYTE, MARK, Codec
from tabfold.llm.token_files import ODD, byte_bpe_encoder, byte_bpe_split_odd
from tabfold.operators.joins import bounded

CHUNKS = 300_000  #: remembered chunks of each tokenizer in a worker
LARGE = 1 << 12  #: links of a group that are written out one by one
TOKENS = 3_000_000  #: tokens of remembered windows in a worker (about 250 MB); beyond that they are found anew

OWN = "row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def byte_level_bytes(tokenizer_file: str) -> list[bytes]:
    """The bytes of each entry of a byte-level tokenizer. Printable Latin-1 bytes are
    written as themselves, the others in their order from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    vocab = Tokenizer.from_file(tokenizer_file).get_vocab()
    table = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        table[i] = bytes(map(byte_of.__getitem__, token))
    return table


def piece_bytes(pieces: list[tuple[str, float, int]]) -> list[bytes]:
    """The bytes of each piece of a SentencePiece model."""
    return [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in pieces]


def cross(groups_a: np.ndarray, groups_b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, times): the ids of each group linked each with each. Groups are
    numbered from 0, in order on both sides. A group of over ``LARGE`` links is counted
    by its distinct ids, so that its times are products."""
    n = int(groups_a[-1]) + 1 if len(groups_a) else 0
    n_a, n_b = np.bincount(groups_a, minlength=n), np.bincount(groups_b, minlength=n)
    start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    small = np.flatnonzero(n_a * n_b <= LARGE)
    each = (n_a * n_b)[small]
    group = np.repeat(small, each)
    at = np.arange(len(group)) - np.repeat(np.cumsum(each) - each, each)
    left, right = start_a[group] + at // n_b[group], start_b[group] + at % n_b[group]
    out = [(group, ids_a[left].astype(np.int64) << 32 | ids_b[right], np.ones(len(group), np.int64))]
    for g in np.flatnonzero(n_a * n_b > LARGE).tolist():
        x, n_x = np.unique(ids_a[start_a[g]:start_a[g] + n_a[g]].astype(np.int64), return_counts=True)
        y, n_y = np.unique(ids_b[start_b[g]:start_b[g] + n_b[g]].astype(np.int64), return_counts=True)
        out.append((np.full(len(x) * len(y), g), (x[:, None] << 32 | y).ravel(), (n_x[:, None] * n_y).ravel()))
    if len(out) == 1:
        return out[0]
    group, pair, times = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(group, kind="stable")
    return group[order], pair[order], times[order]


def owned(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the lists ``which`` of joined lists of these sizes, one after the other, and their sizes."""
    start, n = (np.cumsum(sizes) - sizes)[which], sizes[which]
    return ids[np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)], n


class Aligner:
    """Encodes texts both ways and aligns them; one for each Python worker and pair of files."""

    def __init__(self, bpe_file: str, piece_file: str):
        library_threads(1)
        spaced = byte_bpe_encoder(bpe_file)
        # a space before the text makes its first chunk like those after a space
        self.first = ChunkEncoder(spaced.encode, lambda texts: pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " "), ODD, lambda t: byte_bpe_split_odd(" " + t), most=CHUNKS)
        with open(piece_file, "rb") as f:
            self.second = Codec(f.read())
        if self.second.chunks:
            self.second.chunks.most = CHUNKS
        a, b = byte_level_bytes(bpe_file), piece_bytes(self.second.model.pieces)
        self.bytes_a, self.bytes_b = np.array(a, object), np.array(b, object)
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (a, b))
        numbers = [str(i) for i in range(max(len(a), len(b)))]
        self.written = np.array([[x + "," for x in numbers], [x + "|" for x in numbers], [x + ";" for x in numbers]], object).T
        self.opens_a, self.opens_b = (np.array([x[:1] == b" " for x in t]) for t in (a, b))
        self.forget()

    def forget(self) -> None:
        """Of each window by its code: groups as text, and the linked pairs' place, number and times."""
        self.codes: dict[bytes, int] = {}
        self.text = np.zeros(0, object)
        self.n_groups, self.n_links, self.start, self.count, self.pairs, self.times = (np.zeros(0, np.int64) for _ in range(6))
        self.tokens = 0

    def forget_all(self) -> None:
        self.forget()
        self.first.keep([])
        if self.second.chunks:
            self.second.chunks.keep([])

    def learn(self, ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray) -> None:
        """Append the alignments of windows, given as joined ids and sizes."""
        end_a, end_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        ends = np.intersect1d(end_a, end_b, assume_unique=True)  # each window's end is one of them
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        window = np.searchsorted(np.cumsum(n_a), np.searchsorted(end_a, ends), side="right")  # of each group
        group, pair, times = cross(group_a, group_b, ids_a, ids_b)
        count = np.bincount(window[group], minlength=len(n_a))
        links = np.zeros(len(n_a), np.int64)
        np.add.at(links, window[group], times)
        # a group is written as its ids of one side, a bar, those of the other, and a semicolon
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        written = np.concatenate([self.written[ids_a, np.where(last_a, 1, 0)], self.written[ids_b, np.where(last_b, 2, 0)]])
        side = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        parts, upto = written[side].tolist(), np.cumsum(n_a + n_b).tolist()
        text = np.array(["".join(parts[s:e])[:-1] for s, e in zip([0, *upto], upto)], object)
        self.text = np.concatenate([self.text, text])
        self.n_groups = np.concatenate([self.n_groups, np.bincount(window, minlength=len(n_a))])
        self.n_links = np.concatenate([self.n_links, links])
        self.start = np.concatenate([self.start, len(self.pairs) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.pairs, self.times = np.concatenate([self.pairs, pair]), np.concatenate([self.times, times])
        self.tokens += len(ids_a) + len(ids_b)

    def joined(self, table: np.ndarray, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        parts, ends = table[ids].tolist(), np.cumsum(n).tolist()
        return [b"".join(parts[s:e]) for s, e in zip([0, *ends], ends)]

    def __call__(self, texts: pa.Array) -> tuple:
        """For texts: numbers of tokens of both, of groups and links, digests, and the
        linked pairs of each text with their times, as lists' ends and values."""
        texts = texts.fill_null("")
        (ids_a, n_a), (ids_b, n_b) = self.first(texts), self.second.encode(texts)
        want = [b" " + t.encode() for t in texts.to_pylist()]
        whole = np.array([len(w) > 1 and w == x == y for w, x, y in zip(want, self.joined(self.bytes_a, ids_a, n_a), self.joined(self.bytes_b, ids_b, n_b))], bool)
        ids_a, ids_b = ids_a[np.repeat(whole, n_a)], ids_b[np.repeat(whole, n_b)]
        n_a, n_b = np.where(whole, n_a, 0), np.where(whole, n_b, 0)
        codes, of_text = self.window_codes(ids_a, n_a, ids_b, n_b)
        groups, links = (np.bincount(of_text, minlength=len(n_a)) * 0 for _ in range(2))
        np.add.at(groups, of_text, self.n_groups[codes])
        np.add.at(links, of_text, self.n_links[codes])
        written = self.text[codes].tolist()
        ends = np.searchsorted(of_text, np.arange(len(n_a)), side="right").tolist()
        digests = [hashlib.sha256(";".join(written[s:e]).encode()).hexdigest() if e > s else "" for s, e in zip([0, *ends], ends)]
        pair_ends, pairs, times = self.linked(codes, of_text, len(n_a))
        if self.tokens > TOKENS:
            self.forget()
        return n_a, n_b, groups, links, digests, pair_ends, pairs, times

    def window_codes(self, ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A code for each window of all texts in order, and the text it is in."""
        if not len(ids_a):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end_a, end_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        other = np.searchsorted(end_b, end_a)  # both sides cover the same bytes, text by text
        shared = np.flatnonzero(end_b[other] == end_a)
        next_a, next_b = shared + 1, other[shared] + 1
        text_ends = np.cumsum(n_a)
        is_end = np.zeros(len(ids_a) + 1, bool)
        is_end[text_ends] = True
        cut = is_end[next_a]
        inner = np.flatnonzero(next_a < len(ids_a))
        cut[inner] |= self.opens_a[ids_a[next_a[inner]]] & self.opens_b[ids_b[next_b[inner]]]
        to_a, to_b = next_a[cut], next_b[cut]
        wide_a, wide_b = (np.min_scalar_type(len(t)).newbyteorder("<") for t in (self.size_a, self.size_b))
        raw_a, raw_b = ids_a.astype(wide_a).tobytes(), ids_b.astype(wide_b).tobytes()
        upto_a, upto_b = (wide_a.itemsize * to_a).tolist(), (wide_b.itemsize * to_b).tolist()
        between = np.array(len(self.size_a), wide_a).tobytes()  # no id of A: one key of bytes tells both sides
        keys = [raw_a[s:e] + between + raw_b[t:f] for s, e, t, f in zip([0, *upto_a], upto_a, [0, *upto_b], upto_b)]
        codes = np.fromiter(map(self.codes.get, keys, repeat(-1)), np.int64, len(keys))
        unknown = np.flatnonzero(codes < 0)
        if len(unknown):
            new = [keys[k] for k in unknown.tolist()]
            # where each new window is seen first, in the order of their codes
            first = np.array(sorted(dict(zip(reversed(new), unknown[::-1].tolist())).values()))
            self.codes.update(zip([keys[k] for k in first.tolist()], range(len(self.codes), len(self.codes) + len(first))))
            codes[unknown] = np.fromiter(map(self.codes.get, new), np.int64, len(new))
            self.learn(*owned(ids_a, np.diff(to_a, prepend=0), first), *owned(ids_b, np.diff(to_b, prepend=0), first))
        return codes, np.searchsorted(text_ends, to_a - 1, side="right")

    def linked(self, codes: np.ndarray, of_text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct linked pairs of each text and how often each is linked in it."""
        each = self.count[codes]
        where = np.arange(each.sum()) + np.repeat(self.start[codes] - (np.cumsum(each) - each), each)
        pairs, times, text = self.pairs[where], self.times[where], np.repeat(of_text, each)
        order = np.lexsort((pairs, text))
        pairs, times, text = pairs[order], times[order], text[order]
        first = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]) | (text[1:] != text[:-1]))) if len(pairs) else np.zeros(0, np.int64)
        total = np.add.reduceat(times, first) if len(first) else times
        return np.searchsorted(text[first], np.arange(n_texts), side="right"), pairs[first], total


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner_for(bpe_file: str, piece_file: str) -> Aligner:
    """One aligner for each Python worker and pair of files (of the node's own copies)."""
    if (bpe_file, piece_file) not in _ALIGNERS:
        _ALIGNERS[bpe_file, piece_file] = Aligner(bpe_file, piece_file)
    return _ALIGNERS[bpe_file, piece_file]


def align_documents(docs: DataFrame, bpe_file: str, piece_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document, written to the shared folder: its key, ``row`` (a number
    of its own), n_a and n_b (tokens by the byte-level tokenizer of space + text and by
    the SentencePiece model of the text), n_groups, n_links, groups_sha256, and the
    distinct linked ``pairs`` (id of A times 2^32 plus id of B) with their ``times``.

    groups_sha256 is the digest of ``a1,a2|b1;a3|b2,b3``: ids of each group in order.
    No special tokens: their strings in a text are ordinary text. Files lie at the same
    place on every node. Rows stay where they are.

    Defined cases: a null or empty text, or one whose tokens' joined bytes are not
    space + text on both sides (a marker character in it, say), has no tokens: zeros,
    an empty digest and empty lists; very long texts are encoded whole; repeated rows
    and keys, also null ones, each come back; an empty table gives no rows; other
    columns are not read, whatever their names.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = aligner_for(bpe_file, piece_file), TaskContext.get().partitionId() << 40
        for part in by_bytes(batches, 1, 2 << 20):
            n_a, n_b, groups, links, digests, ends, pairs, times = aligner(part.column(1))
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (pairs, times)]
            row = np.arange(number, number + part.num_rows)
            number += part.num_rows
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (row, n_a, n_b, groups, links, digests)), *lists], names=names)
        aligner.forget_all()  # the worker goes on to other work

    schema = f"key {rows.schema['key'].dataType.simpleString()}, {OWN}"
    names = ["key", *(c.split()[0] for c in OWN.split(", "))]
    return stored(rows.mapInArrow(run, schema), "aligned").withColumnRenamed("key", key)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a, b, docs, best): in how many rows a pair is linked, and whether that is the
    most of all pairs of its a. Tasks count before the shuffle; there are at most
    as many rows as pairs of vocabulary entries."""
    counts = stored(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")), "pair-counts")
    counts = counts.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "docs")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))  # one row an id of the first vocabulary
    return counts.join(most, "a").select("pair", "a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` with n_best and count_sum: over a row's links, how many are of a best
    pair, and the sum of their pairs' docs. The counts meet the rows where they lie
    as long as they are measured to be small, else by a shuffle."""
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    found = links.join(bounded(counts.select("pair", "docs", "best")), "pair")
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return aligned.join(sums, "row", "left").select(*aligned.columns, zero("n_best"), zero("count_sum"))
