"""SentencePiece encoding that keeps, for every piece, the bytes of the original text it stands for."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from .common import batch_steps, with_columns

SPACE = "▁".encode()


class CharacterMap:
    """The compiled character map of a model: a double-array trie over UTF-8 prefixes whose
    values point into a block of replacement strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size :]
        self.first = np.zeros(256, bool)
        if self.units:
            self.first[[b for b in range(256) if self._step(0, b) is not None]] = True

    def _step(self, at: int, byte: int) -> int | None:
        unit = self.units[at]
        child = at ^ ((unit >> 10) << ((unit & 0x200) >> 6)) ^ byte
        ok = child < len(self.units) and self.units[child] & 0x800000FF == byte
        return child if ok else None

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of ``text[at:]`` and what replaces it."""
        found, node, k = None, 0, at
        while self.units and k < len(text) and (child := self._step(node, text[k])) is not None:
            node, k = child, k + 1
            unit = self.units[node]
            if unit >> 8 & 1:  # a value ends here
                leaf = self.units[node ^ ((unit >> 10) << ((unit & 0x200) >> 6))] & 0x7FFFFFFF
                found = k - at, self.strings[leaf : self.strings.index(0, leaf)]
        return found


class Normaliser:
    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.trim = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.mark = SPACE if spec.escape_whitespaces else b" "

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them (and the end) its place in ``text``."""
        if not text:
            return b"", np.zeros(1, np.int64)
        raw = np.frombuffer(text, np.uint8)
        if self.trim or self.map.first[raw].any():
            return self._walk(text)
        gap = raw == 32
        wide = np.where(gap, len(self.mark), 1)
        whole = text.replace(b" ", self.mark)
        # every byte of a character stands at the character's first byte
        start = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, np.arange(len(raw)), 0))
        place = np.append(np.repeat(start, wide), len(raw))
        if self.prefix:
            whole, place = self.mark + whole, np.concatenate([np.zeros(len(self.mark), np.int64), place])
        return whole, place

    def _walk(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The same, prefix by prefix, where the map or the trimming of spaces applies."""
        parts: list[tuple[bytes, int]] = []
        at = 0
        while at < len(text):
            hit = self.map.longest(text, at) if self.map.first[text[at]] else None
            lead = text[at]
            length = hit[0] if hit else 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            parts.append((hit[1] if hit else text[at : at + length], at))
            at += length
        end = len(text)
        if self.trim:
            while parts and parts[0][0].strip(b" ") == b"":
                parts.pop(0)
            while parts and parts[-1][0].strip(b" ") == b"":
                end = parts.pop()[1]
            if not parts:
                return b"", np.full(1, end, np.int64)
        out, place, gap = bytearray(), [], self.trim
        if self.prefix:
            out += self.mark
            place += [parts[0][1]] * len(self.mark)
        for new, start in parts:
            if self.trim and gap:
                new = new.lstrip(b" ")
            if new:
                gap = new.endswith(b" ") if self.trim else False
                new = new.replace(b" ", self.mark)
                out += new
                place += [start] * len(new)
        return bytes(out), np.array([*place, end], np.int64)


class PieceCodec:
    """Encodes with a model file and projects every piece to original bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = file.read()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        proto = sentencepiece_model_pb2.ModelProto.FromString(data)
        self.normalise = Normaliser(proto.normalizer_spec)
        kinds = proto.SentencePiece.Type
        self.length = np.array(
            [1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64
        )
        self.byte = np.array([p.type == kinds.BYTE for p in proto.pieces])
        self.unknown = self.model.unk_id()

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one byte of ``text`` for every piece. Of a character that was
        spelled in bytes, the last piece has the character and the others are empty before it."""
        if not len(ids):
            return ids, ids
        whole, place = self.normalise(text.encode())
        if (ids == self.unknown).any():
            pieces = self.model.encode(text, return_type="proto").pieces
            lengths = np.array([len(p.piece.encode()) for p in pieces], np.int64)
        else:
            lengths = self.length[ids]
        end = np.cumsum(lengths)
        if end[-1] != len(whole):
            raise ValueError("the pieces do not cover the normalised text")
        begin = end - lengths
        if not self.byte[ids].any():
            return place[begin], place[end]
        inside = np.frombuffer(whole, np.uint8)[np.minimum(end, len(whole) - 1)] & 0xC0 == 0x80
        inside &= (end < len(whole)) & self.byte[ids]
        first, last = place[begin], np.where(inside, place[begin], place[end])
        return first, last

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]

    def decode(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist())


def encode_pieces(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, ids, begins and ends (bytes of the original text), decoded text.

    Ids are those of the sentencepiece library without begin or end ids; null is empty, an empty
    text has no pieces. Nulls of the id pass through; other columns play no part. ``model`` is
    the path of the model file, present on every executor.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model)
        for batch in batches:
            for rows, texts in batch_steps(batch, "text"):
                ids = codec.encode(texts)
                spans = [codec.spans(t, x) for t, x in zip(texts, ids, strict=True)]
                yield with_columns(
                    rows,
                    ["doc_id"],
                    ids=pa.array(ids, pa.list_(pa.int64())),
                    begins=pa.array([x[0] for x in spans], pa.list_(pa.int64())),
                    ends=pa.array([x[1] for x in spans], pa.list_(pa.int64())),
                    decoded=[codec.decode(x) for x in ids],
                )

    return _named(docs, doc_id, text).mapInArrow(work, _schema(docs, doc_id, _FULL))


def piece_digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256, and how many bytes of the text the
    pieces cover together; otherwise as ``encode_pieces``, whose arrays need not leave the task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model)
        for batch in batches:
            for rows, texts in batch_steps(batch, "text"):
                ids = codec.encode(texts)
                spans = [codec.spans(t, x) for t, x in zip(texts, ids, strict=True)]
                yield with_columns(
                    rows,
                    ["doc_id"],
                    n_tokens=pa.array([len(x) for x in ids], pa.int64()),
                    ids_sha256=[hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in ids],
                    decoded_sha256=[hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in ids],
                    n_covered=pa.array([int((b - a).sum()) for a, b in spans], pa.int64()),
                )

    return _named(docs, doc_id, text).mapInArrow(work, _schema(docs, doc_id, _DIGESTS))


_FULL = "ids array<bigint>, begins array<bigint>, ends array<bigint>, decoded string"
_DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_covered bigint"


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))


def _schema(docs: DataFrame, doc_id: str, rest: str) -> str:
    return f"doc_id {docs.schema[doc_id].dataType.simpleString()}, {rest}"
