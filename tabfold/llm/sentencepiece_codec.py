"""SentencePiece models on the tokenizers library: encode, decode, check parity."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

from tabfold.llm.chunks import ChunkEncoder, Ids, by_bytes, ids_of, joined_ids, library_threads, mixed
from tabfold.llm.common import set_aside, with_text

OWN = ["ids", "n_tokens", "decoded", "round_trip", "parity"]
MARK = "▁"
#: types of pieces in the model file
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message, in order."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
        elif kind in (1, 5):
            width = 8 if kind == 1 else 4
            yield number, data[at:at + width]
            at += width
        elif kind == 2:
            width = varint()
            yield number, data[at:at + width]
            at += width
        else:
            raise ValueError(f"wire type {kind} is not used by model files")


@dataclass
class Model:
    """What a model file says. Field numbers are those of the public schema."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = 1  # 1 unigram, 2 BPE
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True
    suffix_mark: bool = False

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls()
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                m.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif number == 2:
                spec = dict(fields(value))
                m.kind, m.byte_fallback, m.unk_id = spec.get(3, 1), bool(spec.get(35, 0)), spec.get(40, 0)
                m.suffix_mark = bool(spec.get(24, 0))
            elif number == 3:
                spec = dict(fields(value))
                m.charsmap, m.dummy_prefix = spec.get(2, b""), bool(spec.get(3, 1))
                m.squeeze_spaces, m.escape_spaces = bool(spec.get(4, 1)), bool(spec.get(5, 1))
        return m


def build_tokenizer(m: Model) -> Tokenizer:
    """The model as a tokenizers-library pipeline: normaliser, marker, scores or merge
    order, byte fallback and decoder."""
    if m.suffix_mark or not m.escape_spaces:
        raise ValueError("models that mark white space as a suffix or not at all are not covered")
    if m.kind == 1:
        core = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unk_id, byte_fallback=m.byte_fallback)
    elif m.kind == 2:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        normal = {p for p, _, t in m.pieces if t == NORMAL}
        score = {p: s for p, s, t in m.pieces if t == NORMAL}
        merges = [(-score[p], vocab[p[:k]], vocab[p[k:]], p[:k], p[k:]) for p in normal for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
        core = models.BPE(vocab, [(a, b) for *_, a, b in sorted(merges)], unk_token=m.pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"model type {m.kind} is neither unigram nor BPE")
    t = Tokenizer(core)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    strip = [decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    user = [AddedToken(p, normalized=False) for p, _, kind in m.pieces if kind == USER_DEFINED]
    if user:
        t.add_tokens(user)
    return t


def apart_at_marks(m: Model) -> bool:
    """Whether no token can reach across a marker that follows another character:
    then chunks that start at markers can be encoded one by one. It holds if no
    piece has a marker after another character and the normaliser changes nothing
    but spaces."""
    return (not m.charsmap and not m.squeeze_spaces and m.dummy_prefix and m.kind == 2
            and not any(MARK in p.lstrip(MARK) or kind == USER_DEFINED for p, _, kind in m.pieces))


#: texts that are not plain: spaces twice in a row or at an end, or the marker itself
ODD = f"  |^ | $|{MARK}"


def split_at_marks(text: str) -> list[str]:
    """Chunks of a text, each with its leading spaces but one: a chunk is what is
    encoded with the model's own prefix before it. Spaces at the end stay with the
    last chunk."""
    return [c[1:] for c in re.findall(r" +[^ ]+(?: +\Z)?| +\Z", " " + text.replace(MARK, " "))]


class Codec:
    """Encoder and decoder of one model file, for whole texts."""

    def __init__(self, data: bytes, threads: int = 1):
        library_threads(threads)
        self.model = Model.parse(data)
        self.tokenizer = build_tokenizer(self.model)
        self.theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.threads = threads
        self.chunks = ChunkEncoder(self.encode_chunks, lambda texts: pc.split_pattern(texts, " "), ODD, split_at_marks) if apart_at_marks(self.model) else None
        self.opens = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        # Bytes fused before markers become spaces, once a text, not once a token: the same
        # unless a marker is spelt in bytes, of which the first is looked for.
        self.in_steps, self.fused, self.mark_byte = self.tokenizer.decoder, None, -1
        if self.model.dummy_prefix:
            self.fused = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse(), decoders.Replace(MARK, " "), decoders.Strip(" ", 1, 0)])
            self.mark_byte = next((i for i, (p, _, _) in enumerate(self.model.pieces) if p == f"<0x{MARK.encode()[0]:02X}>"), -1)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        # the same ids as encode_batch, without their places in the text
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_chunks(self, chunks: list[str]) -> Ids:
        plain = np.array([c != "" and " " not in c for c in chunks])
        # the model puts a marker before a text, as joined_ids puts a space
        found = joined_ids([c for c, p in zip(chunks, plain) if p], " ", lambda texts: self.encode_batch([t[1:] for t in texts]), self.opens)
        return found if plain.all() else mixed(plain, found, ids_of(self.encode_batch([c for c, p in zip(chunks, plain) if not p])))

    def encode(self, texts: pa.Array | list[str]) -> Ids:
        """(ids of all texts, number of ids of each); a null text is an empty one."""
        if self.chunks:
            return self.chunks(texts)
        return ids_of(self.encode_batch([t or "" for t in (texts if isinstance(texts, list) else texts.to_pylist())]))

    def normal(self, text: str) -> str:
        """What the ids of a text decode to, where nothing is lost."""
        if self.chunks:
            return text.replace(MARK, " ")
        text = self.tokenizer.normalizer.normalize_str(text).replace(MARK, " ")
        return text[1:] if self.model.dummy_prefix else text

    def agree(self, texts: list[str], ids: list[list[int]], decoded: list[str]) -> list[bool]:
        """Whether the sentencepiece library gives each whole text the same ids, and
        these the same text."""
        theirs = self.theirs.encode(texts, num_threads=self.threads)
        back = [self.theirs.decode(np.array(i, np.int32)) if i else "" for i in ids]  # an array is taken as a whole, a list id by id
        return [a == b and c == d for a, b, c, d in zip(ids, theirs, decoded, back)]

    def forget(self) -> None:
        if self.chunks:
            self.chunks.keep([])

    def decode(self, ids: list[list[int]]) -> list[str]:
        slow = [k for k, i in enumerate(ids) if self.fused is None or self.mark_byte in i]
        if self.fused is None or len(slow) == len(ids):
            return self.decode_by(self.in_steps, ids)
        out = self.decode_by(self.fused, ids)
        for k, t in zip(slow, self.decode_by(self.in_steps, [ids[k] for k in slow])):
            out[k] = t
        return out

    def decode_by(self, decoder: decoders.Decoder, ids: list[list[int]]) -> list[str]:
        self.tokenizer.decoder = decoder
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


_CODECS: dict[tuple, Codec] = {}


def codec_for(model_file: str, threads: int) -> Codec:
    """One codec for each Python worker and model file (of the node's own copy)."""
    if (model_file, threads) not in _CODECS:
        with open(model_file, "rb") as f:
            _CODECS[model_file, threads] = Codec(f.read(), threads)
    return _CODECS[model_file, threads]


def encode_documents(docs: DataFrame, model_file: str, text: str = "text", threads: int = 1) -> DataFrame:
    """``docs`` with ids (array of int), n_tokens, decoded, round_trip and parity.

    The tokenizers library, rebuilt from the model file, encodes the whole texts in
    batches on ``threads`` threads and decodes the ids again. round_trip: the decoded
    text is the normalised one (a marker character in a text decodes as a space, as
    in the sentencepiece library). parity: the sentencepiece library gave the row's
    whole text the same ids, and the same text for them. ``model_file`` lies at the
    same place on every node.

    Defined cases: a null text is encoded like an empty one, to no ids, and decoded
    is empty; very long texts are encoded whole; repeated rows each come back; an
    empty table gives no rows; input columns named like the result's come back as
    ``<name>_in``.
    """
    docs = set_aside(docs, OWN)
    names = docs.columns
    rows, at_text = with_text(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(model_file, threads)
        for part in by_bytes(batches, at_text, 2 << 20):
            texts = [t or "" for t in part.column(at_text).to_pylist()]
            ids, n = codec.encode(part.column(at_text))
            ends = np.concatenate([[0], np.cumsum(n)])
            lists = [x.tolist() for x in np.split(ids, ends[1:-1])]
            ours = codec.decode(lists)
            whole = [a == b for a, b in zip(ours, map(codec.normal, texts))]
            cols = [part.column(i) for i in range(len(names))] + [
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(n), pa.array(ours),
                pa.array(whole), pa.array(codec.agree(texts, lists, ours), pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *OWN])
        codec.forget()  # the worker goes on to other work

    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("ids array<int>, n_tokens long, decoded string, round_trip boolean, parity boolean").fields])
    return rows.mapInArrow(run, schema)
