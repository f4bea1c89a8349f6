"""Spelling variants: words of a corpus that differ by one edit, grouped under common forms.

Two words are one inserted, deleted or replaced code point apart exactly if their common
prefix and common suffix together reach the longer length L minus one. The prefix's
length says where the edit is, so pairs are sorted by an interval [lo, hi) it lies in:
such pairs share their first lo code points and their last L - hi. Words that share
both are a group; a group over ``GROUP`` words is divided into the two halves of its
interval, at most until the interval is one place, where a group can't exceed the
alphabet. Inside groups, padded code-point matrices are compared block against block.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfold.llm.chunks import by_bytes
from tabfold.llm.common import dropped, stored

LETTERS = "A-Za-zÀ-ÿ"
GROUP = 512  #: words of a group that is compared without further division
BLOCK = 128  #: rows of a matrix block
TILE = 8 << 20  #: code points compared at once
BUCKET = 40_000  #: group rows of a task's unit on average
KEPT = 400_000  #: words that a counting task holds before it hands counts on


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int | None = None) -> DataFrame:
    """(word, n): maximal runs of ``LETTERS`` in whole texts, only A-Z lower-cased.

    With ``slip``, a run loses the code point h % length if ``slip`` divides h, the
    unsigned crc32 of ``<key>:<run>``: made typing errors, the same on every run. What
    becomes empty is no word. Null texts have no words; a null key is written as
    nothing. Tasks count before the shuffle, in bounded memory."""
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).cast("string").alias("t"))
    between = f"[^{LETTERS}]+"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for part in by_bytes(batches, 1):
            lists = pc.split_pattern_regex(part.column(1).fill_null("").cast(pa.large_string()), between)
            flat = lists.flatten().dictionary_encode()
            which = flat.indices.to_numpy()
            lower = [w.encode().lower() for w in flat.dictionary.to_pylist()]  # of bytes, lower() changes A-Z alone
            words = [w.decode() for w in lower]
            whole = np.bincount(which, minlength=len(words))
            if slip:
                starts = np.array([zlib.crc32(f"{k}:".encode()) for k in part.column(0).to_pylist()], np.uint32)
                starts = np.repeat(starts, lists.value_lengths().to_numpy(zero_copy_only=False))
                runs = np.array(lower, object)[which]
                h = np.fromiter(map(zlib.crc32, runs.tolist(), starts.tolist()), np.uint32, len(runs))
                hit = np.flatnonzero(h % slip == 0)
                whole -= np.bincount(which[hit], minlength=len(words))
                for code, x in zip(which[hit].tolist(), h[hit].tolist()):
                    if words[code]:
                        at = x % len(words[code])
                        counts[words[code][:at] + words[code][at + 1:]] += 1
            for w, n in zip(words, whole.tolist()):
                counts[w] += n
            if len(counts) > KEPT:
                yield batch(counts)
                counts = Counter()
        yield batch(counts)

    def batch(counts: Counter) -> pa.RecordBatch:
        found = [(w, n) for w, n in counts.items() if w and n]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["word", "n"])

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def grouped(rows: DataFrame) -> DataFrame:
    """Rows (word, n, size, lo, hi) with the hash of what a group's words share."""
    shared = F.xxhash64(F.substring("word", F.lit(1), F.col("lo")), F.lit(0), F.expr("right(word, size - hi)"))
    return rows.withColumn("shared", shared)


def groups_of(words: DataFrame) -> DataFrame:
    """(word, n, size, lo, hi, shared): each word in groups of at most ``GROUP`` words,
    so that every pair at one edit meets in exactly one group that its prefix's length
    allows. A word of l code points enters as the longer (size l) and as the
    shorter one (size l + 1). A shared hash only costs comparisons."""
    key = ["size", "lo", "hi", "shared"]
    sized = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("size"))

    def halved(rows: DataFrame) -> DataFrame:
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        two = F.array(F.struct("lo", mid.alias("hi")), F.struct(mid.alias("lo"), "hi"))
        return grouped(rows.select("word", "n", "size", F.explode(two).alias("i")).select("word", "n", "size", "i.lo", "i.hi"))

    rows = halved(sized.where("size > 1").withColumns({"lo": F.lit(0), "hi": F.col("size")}))
    done = grouped(sized.where("size = 1").withColumns({"lo": F.lit(0), "hi": F.lit(1)}))
    while True:
        rows = stored(rows, "spelling-groups")
        # each group's size comes as a flag with one row a large group, so hot groups cost a join key each
        large = rows.where("hi - lo > 1").groupBy(*key).agg(F.count("*").alias("c")).where(F.col("c") > GROUP).select(*key)
        large = stored(large, "spelling-large")
        if large.isEmpty():
            return done.unionByName(rows)
        done = done.unionByName(rows.join(large, key, "left_anti").select(*rows.columns))
        rows = halved(rows.join(large, key, "left_semi"))


def first_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix lengths of all rows of a[i] with all rows of b[i], for words that differ."""
    return (a[:, :, None, :] != b[:, None, :, :]).argmax(axis=3)


def near_pairs(words: list[str], group: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs at one edit, each once, of rows sorted by ``group`` and
    rising ``size`` between groups: groups are padded to blocks, small ones many in a
    matrix, large ones cut into blocks that meet each other."""
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    counts = np.diff(np.r_[starts, len(group)])
    length = np.array([len(w) for w in words])

    def compare(rows_a: np.ndarray, rows_b: np.ndarray) -> None:
        """Blocks of row numbers, -1 where padded."""
        width = int(size[rows_a[:, 0]].max())
        step = max(1, TILE // (rows_a.shape[1] * rows_b.shape[1] * width))
        for k in range(0, len(rows_a), step):
            a, b = rows_a[k:k + step], rows_b[k:k + step]
            used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            at = at.reshape(2, *a.shape)
            text = [words[i] if i >= 0 else "" for i in used.tolist()]
            fore = np.array(text, f"U{width}").view(np.uint32).reshape(len(text), width)
            back = np.array([w[::-1] for w in text], f"U{width}").view(np.uint32).reshape(len(text), width)
            if fore.max(initial=0) < 256:
                fore, back = fore.astype(np.uint8), back.astype(np.uint8)
            of = a[:, :1, None]
            prefix = first_difference(fore[at[0]], fore[at[1]])
            ok = (a[:, :, None] < b[:, None, :]) & (a[:, :, None] >= 0) & (prefix >= lo[of]) & (prefix < hi[of])
            ok &= np.maximum(length[a][:, :, None], length[b][:, None, :]) == size[of]
            t, i, j = np.nonzero(ok)
            differs = back[at[0][t, i]] != back[at[1][t, j]]
            near = prefix[t, i, j] + differs.argmax(axis=1) >= size[a[t, 0]] - 1
            t, i, j = t[near], i[near], j[near]
            out_a.append(a[t, i])
            out_b.append(b[t, j])

    room = 2
    while room <= BLOCK:
        some = np.flatnonzero((counts > room // 2) & (counts <= room) & (counts > 1))
        for k in range(0, len(some), 4096):  # rising sizes: the groups of a matrix are of like width
            s = some[k:k + 4096]
            rows = starts[s][:, None] + np.arange(room)
            rows = np.where(np.arange(room) < counts[s][:, None], rows, -1)
            compare(rows, rows)
        room *= 2
    for s in np.flatnonzero(counts > BLOCK).tolist():
        n = -(-int(counts[s]) // BLOCK)
        rows = np.full(n * BLOCK, -1)
        rows[:counts[s]] = np.arange(starts[s], starts[s] + counts[s])
        blocks = rows.reshape(n, BLOCK)
        for i in range(n):
            compare(np.repeat(blocks[i:i + 1], n - i, axis=0), blocks[i:])
    return np.concatenate(out_a), np.concatenate(out_b)


def compare_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """For each word with near words in this bucket: how many, and the best of them."""
    rows = rows.sort_values(["size", "lo", "hi", "shared", "word"], ignore_index=True)
    words = rows["word"].tolist()
    key = rows[["size", "lo", "hi", "shared"]].to_numpy()
    group = np.cumsum(np.r_[False, (key[1:] != key[:-1]).any(axis=1)])
    a, b = near_pairs(words, group, key[:, 0], key[:, 1], key[:, 2])
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    code, distinct = pd.factorize(rows["word"], sort=True)
    n = rows["n"].to_numpy()
    order = np.lexsort((code[b], -n[b], code[a]))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, code[a][1:] != code[a][:-1]]) if len(a) else np.zeros(0, np.int64)
    return pd.DataFrame({"word": distinct[code[a[first]]], "n_near": np.diff(np.r_[first, len(a)]), "best_n": n[b[first]], "best": distinct[code[b[first]]]})


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word reached from each word over (word, form), by doubling
    the steps each round; forms lead to ever larger counts, so there are no rings."""
    steps = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = stored(steps.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        dropped(steps)
        steps = joined
        if steps.where("moved").isEmpty():
            return steps.select("word", "root")


def variant_groups(words: DataFrame, ratio: float = 2.0) -> DataFrame:
    """Every row of (word, n) with form, root, n_near and form_n.

    n_near: words at one inserted, deleted or replaced code point. form: that of
    them with the largest n (of equal ones the smallest in code-point order), if its n
    is at least ``ratio`` (over 1) times the word's, else null; root: the word that the
    forms lead to, the word itself if it has none.

    Defined cases: rows with a null or empty word or a null n are left out; rows
    of one word are one word with their sum; an empty table gives no rows; other
    columns are not read; words of any length are compared whole. Tasks return one row
    a word and bucket, no pairs."""
    if ratio <= 1:
        raise ValueError("ratio must be over 1, so that forms lead upwards")
    words = words.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n")).where("word <> '' and n is not null")
    words = stored(words.groupBy("word").agg(F.sum("n").alias("n")), "spelling-words")
    rows = stored(groups_of(words), "spelling-pairs")
    buckets = max(1, rows.count() // BUCKET)
    bucket = F.pmod(F.xxhash64("size", "lo", "hi", "shared"), F.lit(buckets))
    found = rows.groupBy(bucket.alias("bucket")).applyInPandas(compare_bucket, "word string, n_near long, best_n long, best string")
    empty = {"n_near": F.lit(0).cast("long"), "best_n": F.lit(None).cast("long"), "best": F.lit(None).cast("string")}
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    every = found.withColumn("n", F.lit(None).cast("long")).unionByName(words.withColumns(empty))
    one = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    taken = -F.col("b.less") >= F.lit(float(ratio)) * F.col("n")
    forms = stored(one.select("word", "n", "n_near", F.when(taken, F.col("b.best")).alias("form"), F.when(taken, -F.col("b.less")).alias("form_n")), "spelling-forms")
    ends = roots(forms.where("form is not null"))
    return forms.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 5, min_count: int = 3, ratio: float = 2.0, slip: int | None = None) -> DataFrame:
    """``variant_groups`` of the words of whole texts that have at least ``min_chars``
    code points and ``min_count`` occurrences. Null and empty texts have no words; very
    long texts are read whole; repeated rows count each; an empty table gives no
    rows; other columns are not read, whatever their names."""
    words = count_words(docs, key, text, slip)
    return variant_groups(words.where((F.length("word") >= min_chars) & (F.col("n") >= min_count)), ratio)
