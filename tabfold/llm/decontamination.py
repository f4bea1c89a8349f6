"""Benchmark decontamination: a BM25 index of test items, block-max WAND over every
training passage, and a check of question and answer overlap."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfold.llm.common import with_text

OWN = ["item_id", "passage", "score", "question_overlap", "answer_overlap"]
K1, B = 1.2, 0.75
BLOCK = 4  #: postings a block of an inverted list covers, by item position
PART_ITEMS = 1024  #: items of one index part
BROADCAST_BYTES = 64 << 20  #: text of items that one pass over the documents carries
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[str, str]:
    """Split of an item given as one text: the answer is its last sentence or line, if
    that leaves a question of at least five words."""
    cuts = [m.end() for m in re.finditer(r"[.!?]\s+|\n+", text.rstrip())]
    for at in reversed(cuts):
        if words_of(text[at:]) and len(words_of(text[:at])) >= 5:
            return text[:at], text[at:]
    return text, ""


def shingles(words: list[str], n: int = 5) -> set[tuple[str, ...]]:
    """Word shingles; of fewer words than ``n``, the whole sequence."""
    return {tuple(words[k:k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def overlap(part: list[str], words: list[str], found: set[tuple[str, ...]], n: int = 5) -> float:
    """Share of the shingles of ``part`` that are among those of ``words``."""
    mine = shingles(part, n)
    if not mine:
        return 1.0
    if len(part) < n:
        return float(any(words[k:k + len(part)] == part for k in range(len(words) - len(part) + 1)))
    return len(mine & found) / len(mine)


@dataclass
class IndexPart:
    """Inverted lists of up to ``PART_ITEMS`` items. Impacts are BM25 weights divided
    by the score of the item against itself, so one threshold serves all items."""

    ids: list
    questions: list[list[str]]
    answers: list[list[str]]
    terms: dict[str, int]
    postings: list[tuple[list[int], list[float]]]  # per term: items ascending, impacts
    block_max: np.ndarray  # term, block: largest impact
    largest: list[float]  # per term: largest impact
    longest: int  # words of the longest item


def build_part(items: list[tuple], n_items: int, frequency: Counter, mean_words: float) -> IndexPart:
    """``items``: (id, question, answer); the statistics cover all items."""
    questions, answers = [words_of(q) for _, q, _ in items], [words_of(a) for *_, a in items]
    lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
    for i, (q, a) in enumerate(zip(questions, answers)):
        counts, length = Counter(q + a), len(q) + len(a)
        weight = {t: np.log1p((n_items - frequency[t] + 0.5) / (frequency[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * length / mean_words)) for t, c in counts.items()}
        own = sum(weight.values())
        for t, w in weight.items():
            lists[t].append((i, w / own))
    terms = {t: k for k, t in enumerate(sorted(lists))}
    postings = [tuple(map(list, zip(*lists[t]))) for t in terms]
    block_max = np.zeros((len(terms), max(1, -(-len(items) // BLOCK))), np.float32)
    for k, (at, w) in enumerate(postings):
        np.maximum.at(block_max[k], np.array(at) // BLOCK, (np.array(w) * (1 + 1e-6)).astype(np.float32))
    return IndexPart([i for i, *_ in items], questions, answers, terms, postings, block_max, block_max.max(axis=1).tolist() if len(terms) else [], max((len(q) + len(a) for q, a in zip(questions, answers)), default=0))


def wand(part: IndexPart, query: list[int], threshold: float) -> list[tuple[int, float]]:
    """Block-max WAND: items whose impacts over the query's terms sum to at least
    ``threshold``, with the sums. List cursors stand in order of their items; the
    pivot is the first at which the terms' largest impacts reach the threshold. If
    the blocks there cannot reach it, the cursors skip to the end of the block."""
    cursors = [[0, *part.postings[t], part.largest[t], part.block_max[t]] for t in query]
    out = []
    while cursors:
        cursors.sort(key=lambda c: c[1][c[0]])
        bound, pivot = 0.0, None
        for n, c in enumerate(cursors):
            bound += c[3]
            if bound >= threshold:
                pivot = n
                break
        if pivot is None:
            break
        item = cursors[pivot][1][cursors[pivot][0]]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][1][cursors[pivot + 1][0]] == item:
            pivot += 1
        before = cursors[:pivot + 1]
        following = cursors[pivot + 1][1][cursors[pivot + 1][0]] if pivot + 1 < len(cursors) else None
        block = item // BLOCK
        if sum(float(c[4][block]) for c in before) < threshold:
            # no item up to the end of the block, or to the next cursor, can reach it
            to = max(item + 1, (block + 1) * BLOCK if following is None else min((block + 1) * BLOCK, following))
        elif cursors[0][1][cursors[0][0]] == item:
            score = sum(c[2][c[0]] for c in before)
            if score >= threshold:
                out.append((item, score))
            to = item + 1
        else:
            to = item
        for c in before:
            c[0] = bisect_left(c[1], to, c[0])
        cursors = [c for c in cursors if c[0] < len(c[1])]
    return out


def matches(part: IndexPart, texts: list[str], threshold: float, least: float) -> Iterator[tuple[int, int, object, float, float, float]]:
    """(text, word position, item id, score, question overlap, answer overlap) of the
    verified items of each text's passages. Passages are windows of twice the longest
    item, one item's length apart, so each item's copy lies whole in one of them."""
    step = max(1, part.longest)
    tokens = [words_of(t) for t in texts]
    code, spans = part.terms.get, []
    flat, owner = [], []
    for k, w in enumerate(tokens):
        codes = [code(x, -1) for x in w]
        for a in range(0, max(1, len(w) - step), step):
            seen = set(codes[a:a + 2 * step])
            seen.discard(-1)
            if seen:
                owner.append(len(seen))
                flat += sorted(seen)
                spans.append((k, a))
    if not spans:
        return
    # the largest impacts of whole blocks, for all passages at once: a passage goes on if some block can reach the threshold
    starts = np.cumsum(owner) - owner
    bound = np.zeros(len(spans))
    for k in range(0, len(spans), 4096):
        z = starts[k + 4096] if k + 4096 < len(spans) else len(flat)
        rows = part.block_max[flat[starts[k]:z]]
        bound[k:k + 4096] = np.add.reduceat(rows, starts[k:k + 4096] - starts[k], axis=0, dtype=np.float32).max(axis=1)
    for n in np.flatnonzero(bound * (1 + 1e-4) >= threshold):
        k, a = spans[n]
        found = wand(part, flat[starts[n]:starts[n] + owner[n]], threshold)
        if found:
            window = tokens[k][a:a + 2 * step]
            mine = shingles(window)
            for i, score in found:
                q, x = overlap(part.questions[i], window, mine), overlap(part.answers[i], window, mine)
                if q >= least and x >= least:
                    yield k, a, part.ids[i], score, q, x


def index_parts(benchmark: DataFrame, item: str, text: str) -> Iterator[list[IndexPart]]:
    """The index in lists of parts, each list of at most ``BROADCAST_BYTES`` of item
    text: a benchmark of any size is searched in as many passes."""
    cols = benchmark.columns
    q, a = (F.col("question"), F.col("answer")) if {"question", "answer"} <= set(cols) else (F.col(text), F.lit(None))
    rows = benchmark.select(F.col(item).alias("id"), q.cast("string").alias("q"), a.cast("string").alias("a")).where(F.col("q").rlike(r"(?U)\w")).distinct()
    frequency, n, words = Counter(), 0, 0

    def items():
        for r in rows.orderBy("id", "q", "a").toLocalIterator():
            yield (r["id"], *(question_and_answer(r["q"]) if r["a"] is None else (r["q"], r["a"])))

    for _, q, a in items():
        w = words_of(q + " " + a)
        frequency.update(set(w))
        n, words = n + 1, words + len(w)
    pack, parts, size = [], [], 0
    for x in items():
        pack.append(x)
        size += len(x[1]) + len(x[2])
        if len(pack) == PART_ITEMS or size >= BROADCAST_BYTES:
            parts.append(build_part(pack, n, frequency, words / n))
            pack = []
        if size >= BROADCAST_BYTES:
            yield parts
            parts, size = [], 0
    if pack:
        parts.append(build_part(pack, n, frequency, words / n))
    if parts:
        yield parts


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
                 threshold: float = 0.5, least: float = 0.8) -> DataFrame:
    """(key, item_id, passage, score, question_overlap, answer_overlap): the verified
    test items of each document, one row each with the best passage (its first word's
    number).

    Every passage of every document queries the index; items whose BM25 score is at
    least ``threshold`` of their score against themselves are retrieved, all of them.
    Verified are those of whose question and of whose answer at least the share
    ``least`` of the five-word shingles is in the passage (of fewer words: the whole
    sequence). Items have columns question and answer, or one text (see
    ``question_and_answer``). The index (test items) is broadcast, in passes of
    bounded size.

    Defined cases: null and empty texts match nothing; items without words, or null,
    are left out; a null key comes back null; repeated documents count as one of
    their key; empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    keyed = dict(docs.dtypes)[key]
    fields = f"key {keyed}, item_id {dict(benchmark.dtypes)[item]}, passage int, score double, question_overlap double, answer_overlap double"
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    out = spark.createDataFrame([], fields)
    for parts in index_parts(benchmark, item, item_text):
        shared = spark.sparkContext.broadcast(parts)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(0, b.num_rows, 256):
                    part = b.slice(k, 256)
                    texts = [t or "" for t in part.column(1).to_pylist()]
                    best: dict[tuple, tuple] = {}
                    for index in shared.value:
                        for d, a, i, score, q, x in matches(index, texts, threshold, least):
                            if (d, i) not in best or best[d, i][1] < score:
                                best[d, i] = (a, score, q, x)
                    if best:
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([d for d, _ in best])), pa.array([i for _, i in best]), pa.array([v[0] for v in best.values()], pa.int32()),
                                                          *(pa.array([v[j] for v in best.values()], pa.float64()) for j in (1, 2, 3))], names=["key", *OWN])

        out = out.union(rows.mapInArrow(run, fields))
    return out.groupBy("key", "item_id").agg(F.max_by(F.struct("passage", "score", "question_overlap", "answer_overlap"), F.struct("score", -F.col("passage"))).alias("m")).select(F.col("key").alias(key), "item_id", "m.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
                  threshold: float = 0.5, least: float = 0.8) -> DataFrame:
    """``docs`` without the documents that hold a test item (see ``contaminated``),
    with their columns unchanged. Each text is judged where it lies, so rows that
    share a key, or have none, are judged one by one and nothing is joined."""
    names = docs.columns
    kept, at_text = with_text(docs, text)
    for parts in index_parts(benchmark, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(parts)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(0, b.num_rows, 256):
                    part = b.slice(k, 256)
                    texts = [t or "" for t in part.column(at_text).to_pylist()]
                    bad = {m[0] for index in shared.value for m in matches(index, texts, threshold, least)}
                    clean = part.filter(pa.array([i not in bad for i in range(part.num_rows)]))
                    yield clean

        kept = kept.mapInArrow(run, kept.schema)
    return kept.select(*[F.col(f"`{c}`") for c in names])
