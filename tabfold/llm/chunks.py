"""Ids of texts from the ids of their space-separated chunks.

A tokenizer that never lets a token reach across certain spaces gives a text the
ids of its chunks, one after the other. Most chunks repeat, so their ids are kept
and each batch sends only new chunks to the tokenizer, many in one string.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def library_threads(n: int) -> None:
    """Threads of the tokenizers library in this worker; counts before its first batch.
    Left alone, each task's worker would take all cores of its machine."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(n))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true" if n > 1 else "false")


Ids = tuple[np.ndarray, np.ndarray]  #: ids of several texts, number of ids of each
PACK = 256  #: chunks of one string


def ids_of(lists: list[list[int]]) -> Ids:
    return np.fromiter(chain.from_iterable(lists), np.uint32, sum(map(len, lists))), np.fromiter(map(len, lists), np.int64, len(lists))


def joined_ids(chunks: list[str], mark: str, encode: Callable[[list[str]], list[list[int]]], opens: np.ndarray) -> Ids:
    """Ids of ``mark + chunk`` for each chunk, encoded in strings of ``PACK`` of them.
    ``opens`` tells of each id whether its token begins with the mark, as that of a
    chunk's first token alone does; strings where the count shows otherwise are
    encoded chunk by chunk."""
    packs = [chunks[k:k + PACK] for k in range(0, len(chunks), PACK)]
    out = []
    for pack, ids in zip(packs, encode([mark + mark.join(p) for p in packs])):
        ids = np.array(ids, np.uint32)
        at = np.flatnonzero(opens[ids])
        if len(at) == len(pack) and at[0] == 0:
            out.append((ids, np.diff(np.append(at, len(ids)))))
        else:
            out.append(ids_of(encode([mark + c for c in pack])))
    return np.concatenate([np.zeros(0, np.uint32), *(x for x, _ in out)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in out)])


def mixed(first: np.ndarray, yes: Ids, no: Ids) -> Ids:
    """Ids of texts of which those where ``first`` is true are in ``yes``, the others in ``no``."""
    sizes = np.zeros(len(first), np.int64)
    sizes[first], sizes[~first] = yes[1], no[1]
    from_yes = np.repeat(first, sizes)
    ids = np.zeros(len(from_yes), np.uint32)
    ids[from_yes], ids[~from_yes] = yes[0], no[0]
    return ids, sizes


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose texts have about ``most`` bytes, or one row."""
    for b in batches:
        size = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < b.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
            yield b.slice(at, to - at)
            at = to


class ChunkEncoder:
    """Ids of texts with memory of the ids of their chunks.

    ``split`` gives an Arrow array of texts as lists of chunks where that is plain, and
    ``split_odd`` the chunks of one of the texts that match the pattern ``odd``; a
    chunk says itself how it stands in its text. ``encode(chunks) -> (ids, sizes)``.
    Beyond ``most`` chunks (about 200 bytes each) the less used half is forgotten, and
    after a chunk of over ``longest`` characters everything; neither changes a result."""

    def __init__(self, encode: Callable[[list[str]], Ids], split: Callable[[pa.Array], pa.Array], odd: str, split_odd: Callable[[str], list[str]], most: int = 400_000, longest: int = 10_000):
        self.encode, self.split, self.odd, self.split_odd, self.most, self.longest = encode, split, odd, split_odd, most, longest
        self.keep([])

    def keep(self, chunks: list[str]) -> None:
        """Start anew with these known chunks."""
        old = np.array([self.code[c] for c in chunks], np.int64)
        sizes = self.size[old] if chunks else np.zeros(0, np.int64)
        ids = self.gather(old) if chunks else np.zeros(0, np.uint32)
        hits = self.hits[old] // 2 if chunks else np.zeros(0, np.int64)
        self.code = dict(zip(chunks, range(len(chunks))))
        room = max(1 << 16, 2 * len(chunks))
        self.size, self.start, self.hits = (np.zeros(room, np.int64) for _ in range(3))
        self.size[:len(chunks)], self.hits[:len(chunks)] = sizes, hits
        self.start[:len(chunks)] = np.cumsum(sizes) - sizes
        self.used = len(ids)
        self.ids = np.zeros(max(1 << 18, 2 * len(ids)), np.uint32)
        self.ids[:len(ids)] = ids

    def gather(self, codes: np.ndarray) -> np.ndarray:
        sizes = self.size[codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(self.start[codes] - (ends - sizes), sizes)]

    def learn(self, chunks: list[str]) -> None:
        ids, sizes = self.encode(chunks)
        n, k = len(ids), len(self.code)
        while len(self.size) < k + len(chunks):
            self.size, self.start, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.start, self.hits))
        while len(self.ids) < self.used + n:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.size[k:k + len(chunks)] = sizes
        self.start[k:k + len(chunks)] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used:self.used + n] = ids
        self.used += n
        self.code.update(zip(chunks, range(k, k + len(chunks))))

    def lists(self, texts: pa.Array) -> pa.Array:
        """The chunks of each text."""
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False) | (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0)
        if not odd.any():
            return self.split(texts)
        plain = self.split(texts.filter(pa.array(~odd)))
        others = pa.array([self.split_odd(t) if t else [] for t in texts.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string()))
        order = np.empty(len(odd), np.int64)
        order[~odd], order[odd] = np.arange(len(plain)), len(plain) + np.arange(len(others))
        return pa.concat_arrays([plain, others]).take(pa.array(order))

    def __call__(self, texts: pa.Array | list[str]) -> Ids:
        """(ids of all texts, number of ids of each); a null text is an empty one."""
        texts = (pa.array(texts, pa.string()) if isinstance(texts, list) else texts).fill_null("")
        lists = self.lists(texts)
        flat = lists.flatten().dictionary_encode()
        # by way of numpy, which makes the strings several times faster than to_pylist
        which, distinct = flat.indices.to_numpy(), flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = np.fromiter(map(self.code.get, distinct, repeat(-1)), np.int64, len(distinct))
        unknown = np.flatnonzero(codes < 0)
        new = [distinct[k] for k in unknown.tolist()]
        if new:
            codes[unknown] = np.arange(len(self.code), len(self.code) + len(new))
            self.learn(new)
        self.hits[codes] += np.bincount(which, minlength=len(codes))
        each = codes[which]
        ids = self.gather(each)
        ends = np.concatenate([[0], np.cumsum(self.size[each])])
        n = lists.value_lengths().to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        if max(map(len, new), default=0) > self.longest:
            self.keep([])
        elif len(self.code) > self.most:
            used = self.hits[:len(self.code)]
            half = set(np.argpartition(-used, self.most // 2)[:self.most // 2].tolist())
            self.keep([c for c, k in self.code.items() if k in half])
        return ids, ends[at[1:]] - ends[at[:-1]]
