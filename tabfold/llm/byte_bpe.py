"""Byte-level BPE by longest matches and backtracking: encode and decode with rank files.

A token list is what the merges give exactly if every two neighbours are
compatible, that is, if the merges of the two tokens' joined bytes give the two tokens
again. So a text is covered left to right with the longest vocabulary entry that is
compatible with the token before it, shorter ones after it; a place where none fits is
marked as dead and the last token taken back. No place is marked twice, which bounds the
work by the text's length times the number of prefixes of a token. The longest entries at
all places come from one Aho-Corasick pass over the bytes, written as Latin-1 characters.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabfold.llm.chunks import ChunkEncoder, Ids, by_bytes, ids_of
from tabfold.llm.common import set_aside, with_text
from tabfold.llm.token_files import FIRST, ODD, byte_bpe_split, byte_bpe_split_odd

OWN = ["ids", "n_tokens", "decoded"]
MEMO = 1 << 20  #: remembered token pairs of a worker (about 100 bytes each); more are forgotten and found again

PIECES, LONG = 200_000, 40  #: remembered matches of a worker, and the most characters of one


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merged(ranks: dict[bytes, int], piece: bytes) -> list[bytes]:
    """The lowest-ranked pair of neighbours joined until none is left, the leftmost
    of equal ones first: what a table of ranks means, one merge at a time."""
    parts = [bytes([b]) for b in piece]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return parts
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


class ByteBPE:
    """Encoder and decoder of one table of ranks; a token's id is its rank.

    Ranks are distinct, every single byte is a token, and each entry that merges give
    comes after the entries it is merged of (true of every trained table, else an
    error). An entry that no merges give is found by whole matches alone, as the
    tiktoken library has it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("each single byte needs a rank")
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for rank in sorted(self.bytes_of):
            token = self.bytes_of[rank]
            prefixes = [ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ranks]
            self.shorter[rank] = prefixes[0] if prefixes else None
            for left in prefixes:
                right = ranks.get(token[len(self.bytes_of[left]):])
                if right is not None and left < rank and right < rank and left in self.parts and right in self.parts and self.compatible(left, right):
                    self.merge[left, right] = rank
                    self.parts[rank] = left, right
                    break
            else:
                if len(token) == 1:
                    self.parts[rank] = rank, rank
                elif len(merged(ranks, token)) == 1:
                    raise ValueError(f"the merges of entry {rank} go through a later entry")
        self.fits.clear()  # judged while merges were still missing
        self.sizes = {r: len(t) for r, t in self.bytes_of.items()}
        self.reachable = {t: r for t, r in ranks.items() if r in self.parts}
        for rank in self.parts:  # a prefix that merges cannot give is passed over
            while self.shorter[rank] is not None and self.shorter[rank] not in self.parts:
                self.shorter[rank] = self.shorter[self.shorter[rank]]
        self.matches = ahocorasick.Automaton()
        for token, rank in self.reachable.items():
            self.matches.add_word(token.decode("latin-1"), (len(token), rank))
        self.matches.make_automaton()

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` leaves the border between them.

        Undoes the merges on both sides of the border from the latest on: a merge
        across it counts if it comes before the undone one (on the right side, also
        if both have the same rank, since equal merges go from left to right)."""
        before = None  # merges across the border count below this (rank, side)
        while True:
            across = self.merge.get((a, b))
            if across is not None and (before is None or (across, 0) < before):
                return False
            if a > b:  # the left side's last merge is the later one
                order = [0, 1]
            else:
                order = [1, 0]
            for side in order:
                x = b if side else a
                left, right = self.parts[x]
                if left == x:
                    continue  # a single byte has no merge to undo
                if side:
                    before, b = (x, 1), left
                else:
                    before, a = (x, 0), right
                break
            else:
                return True

    def fit(self, a: int, b: int) -> bool:
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) >= MEMO:
                self.fits.clear()
            found = self.fits[a, b] = self.compatible(a, b)
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of the bytes of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if not piece:
            return []
        longest: list[int] = [0] * len(piece)
        for end, (size, rank) in self.matches.iter(piece.decode("latin-1")):
            longest[end + 1 - size] = rank  # ends rise, so the last one stored is the longest
        alive = bytearray(b"\x01") * (len(piece) + 1)
        sizes, shorter, known, fit = self.sizes, self.shorter, self.fits.get, self.fit
        out: list[int] = []
        at, token, last = 0, longest[0], None
        while True:
            while token is not None:
                end = at + sizes[token]
                if alive[end]:
                    if last is None:
                        break
                    fits = known((last, token))
                    if fits or fits is None and fit(last, token):
                        break
                token = shorter[token]
            if token is None:  # nothing fits here: take the last token back and try a shorter one
                alive[at] = 0
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else None
            else:
                out.append(token)
                if end == len(piece):
                    return out
                at, last, token = end, token, longest[end]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Codec:
    """Ids of whole texts: matches of ``pattern`` are encoded each by itself; ids of
    text chunks that repeat are kept in bounded memory."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.bpe = ByteBPE(ranks)
        # white space as the tiktoken library's engine has it: without U+001C to U+001F
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.pieces: dict[str, list[int]] = {}
        # chunks are only known to stand apart for this pattern; others take whole texts
        apart = pattern == public_tokenizers.PATTERN
        self.chunks = ChunkEncoder(self.encode_chunks, byte_bpe_split, ODD, byte_bpe_split_odd) if apart else None
        self.table = np.array([self.bpe.bytes_of.get(i) for i in range(max(self.bpe.bytes_of) + 1)], object)

    def encode_text(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pattern.findall(text):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = self.bpe.encode_piece(piece.encode())
                if len(piece) <= LONG:
                    if len(self.pieces) >= PIECES:
                        self.pieces.clear()
                    self.pieces[piece] = ids
            out += ids
        return out

    def encode_chunks(self, chunks: list[str]) -> Ids:
        """A chunk stands after a space but where it begins with a line end or is a text's first."""
        return ids_of([self.encode_text(c[1:] if c[0] == FIRST else c if c[0] == "\n" else " " + c) for c in chunks])

    def encode(self, texts: pa.Array | list[str]) -> Ids:
        """(ids of all texts, number of ids of each); a null text is an empty one."""
        if self.chunks:
            return self.chunks(texts)
        return ids_of([self.encode_text(t or "") for t in (texts if isinstance(texts, list) else texts.to_pylist())])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Bytes of the id lists that end at ``ends`` of the joined ids."""
        parts = self.table[ids].tolist()
        return [b"".join(parts[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def forget(self) -> None:
        self.bpe.fits.clear()
        self.pieces.clear()
        if self.chunks:
            self.chunks.keep([])


_CODECS: dict[tuple[str, str], Codec] = {}


def codec_for(ranks_file: str, pattern: str) -> Codec:
    """One codec for each Python worker, rank file (of the node's own copy) and pattern."""
    if (ranks_file, pattern) not in _CODECS:
        _CODECS[ranks_file, pattern] = Codec(read_ranks(ranks_file), pattern)
    return _CODECS[ranks_file, pattern]


def encode_byte_bpe(docs: DataFrame, ranks_file: str, text: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``docs`` with ids (array of int), n_tokens and decoded (binary).

    Each match of ``pattern`` in a whole text is encoded by the ranks, without
    special tokens: their strings in a text are ordinary text. ``decoded`` is what the
    ids give back. ``ranks_file`` lies at the same place on every node. Rows stay
    where they are: nothing is shuffled, and a hot text costs its rows alone.

    Defined cases: a null text is an empty one, with no ids and decoded empty; very
    long texts are encoded whole; repeated rows each come back; an empty table
    gives no rows; a null in any other column is kept; input columns named like the
    result's come back as ``<name>_in``.
    """
    docs = set_aside(docs, OWN)
    names = docs.columns
    rows, at_text = with_text(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(ranks_file, pattern)
        for part in by_bytes(batches, at_text, 2 << 20):
            ids, n = codec.encode(part.column(at_text))
            ends = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            own = [lists, pa.array(n), pa.array(codec.decode(ids, ends), pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(names))] + own, names=[*names, *OWN])
        codec.forget()  # the worker goes on to other work

    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("ids array<int>, n_tokens long, decoded binary").fields])
    return rows.mapInArrow(run, schema)
