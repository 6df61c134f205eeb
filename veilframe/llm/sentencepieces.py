"""SentencePiece encoding and decoding with the tokenizers library.

The model file is a protocol buffer. Its pieces, scores and normalizer settings are read with a
small reader of the wire format, and an equal tokenizer is put together: the precompiled
character map, the handling of spaces and the marker U+2581 as normalizer, the piece scores as a
Unigram model or as the merge order of a BPE model, pieces for single bytes as fallback. Where no
piece reaches over a marker, a text is the sum of its words, so each different word is encoded once,
in batches; other models get whole texts.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_batches, texts_of

MARKER = "▁"
# Fixed values of the model format: kinds of pieces, kinds of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
CACHED_WORDS = 500_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a message: integers for varints, bytes for everything else."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError("not a SentencePiece model")
            size = varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True
    suffix: bool = False


def parse_model(data: bytes) -> Model:
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            own = dict(_fields(value))
            model.kind = own.get(3, UNIGRAM)
            model.suffix = bool(own.get(24, 0))
            model.byte_fallback = bool(own.get(35, 0))
        elif number == 3:
            own = dict(_fields(value))
            model.charsmap = own.get(2, b"")
            model.dummy_prefix = bool(own.get(3, 1))
            model.remove_extra = bool(own.get(4, 1))
            model.escape = bool(own.get(5, 1))
    if model.kind not in (UNIGRAM, BPE) or model.suffix or not model.escape:
        raise ValueError("only Unigram and BPE models with a leading space marker are supported")
    return model


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Joins of two pieces to a third, best score of the result first."""
    ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    joins = []
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
            if left is not None and right is not None:
                joins.append((-pieces[i][1], left, right, piece[:cut], piece[cut:]))
    return [(a, b) for *_, a, b in sorted(joins)]


class PieceTokenizer:
    """Encoder and decoder of one model, with the ids of words kept."""

    def __init__(self, data: bytes) -> None:
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.model = model = parse_model(data)
        unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), None)
        if model.kind == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
            unk = None if unknown is None else model.pieces[unknown][0]
            core = models.BPE(vocab, _merges(model.pieces), unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback)
        else:
            # control and unused pieces never match a text
            scores = [(p if kind in (NORMAL, UNKNOWN, USER_DEFINED, BYTE) else f"\0{i}", s) for i, (p, s, kind) in enumerate(model.pieces)]
            core = models.Unigram(scores, unk_id=unknown, byte_fallback=model.byte_fallback)
        self.tokenizer = Tokenizer(core)
        defined = [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED]
        if defined:
            self.tokenizer.add_tokens(defined)
        self.clean = []
        if model.charsmap:
            self.clean.append(normalizers.Precompiled(model.charsmap))
        if model.remove_extra:
            self.clean += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
        marks = [normalizers.Prepend(MARKER)] if model.dummy_prefix else []
        self.tokenizer.normalizer = normalizers.Sequence([*self.clean, *marks, normalizers.Replace(" ", MARKER)])
        strip = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
        self.tokenizer.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
        crossing = any(MARKER in p.lstrip(MARKER) for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED))
        self.by_word = model.dummy_prefix and not model.remove_extra and not model.charsmap and not defined and not crossing
        self.known: dict[str, bytes] = {}
        control = {i for i, (_, _, kind) in enumerate(model.pieces) if kind == CONTROL}
        self.control = control
        # a byte below 0x80 is a character of its own; others need their neighbours
        value = [int(p[3:5], 16) if kind == BYTE else 0 for p, _, kind in model.pieces]
        self.bytes_ids = np.array([v >= 0x80 for v in value])
        self.plain = [
            "" if kind == CONTROL else " \u2047 " if kind == UNKNOWN else chr(v) if kind == BYTE else p.replace(MARKER, " ")
            for (p, _, kind), v in zip(model.pieces, value, strict=True)
        ]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, text: str) -> list[str]:
        """Pieces of text that start at a space each; the space itself is what the dummy prefix adds."""
        if MARKER in text:  # means a space to a model
            text = text.replace(MARKER, " ")
        words = text.split(" ")
        if all(words):
            return words
        if not text:
            return []
        out, spaces = [], 0
        for w in words:
            if w:
                out.append(" " * spaces + w)
                spaces = 0
            else:
                spaces += 1
        return out + [" " * (spaces - 1)] if spaces else out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.by_word:
            filled = iter(self._encode([t for t in texts if t]))
            return [next(filled) if t else b"" for t in texts]
        cut = [self._words(t) for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        new: set[str] = set()
        for words in cut:
            new.update(words)
        fresh = list(new.difference(self.known))
        # an empty piece is a single marker, which the library would not put before nothing
        self.known.update(zip(fresh, self._encode([w or " " for w in fresh]), strict=True))
        if "" in new:
            self.known[""] = self._encode_marker()
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def _encode_marker(self) -> bytes:
        return np.array([self.tokenizer.token_to_id(MARKER)], "<u4").tobytes()

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Text of each id array. Control pieces leave nothing; bytes that are no UTF-8 become U+FFFD."""
        out: list[str] = []
        get = self.plain.__getitem__
        for own in ids:
            if len(own) and self.bytes_ids[own].any():
                kept = [i for i in own.tolist() if i not in self.control]
                out.append(self.tokenizer.decode(kept, skip_special_tokens=False))
                continue
            text = "".join(map(get, own.tolist()))
            marked = self.model.dummy_prefix and len(own) and self.model.pieces[own[0]][0].startswith(MARKER)
            out.append(text[1:] if marked else text)
        return out


_tokenizers: dict[str, PieceTokenizer] = {}  # one for each worker process, its words are kept between tasks


def tokenizer_of(path: str) -> PieceTokenizer:
    if path not in _tokenizers:
        with open(path, "rb") as file:
            _tokenizers[path] = PieceTokenizer(file.read())
    return _tokenizers[path]


def _texts(batch: pa.RecordBatch, size: int = 1024) -> Iterator[tuple[list, list[str]]]:
    for at in range(0, batch.num_rows, size):
        part = batch.slice(at, size)
        yield part.column("doc_id").to_pylist(), [t or "" for t in part.column("text").to_pylist()]


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id`` and ``ids`` of every row; a null text counts as empty and has no ids.

    ``model`` is the path of a SentencePiece model, the same on every worker.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer_of(model)
        for batch in batches:
            for keys, texts in _texts(batch):
                found = encoder.encode(texts)
                bounds = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found])))
                flat = pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists], names=["doc_id", "ids"])

    return in_batches(texts_of(docs), rows, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id`` and ``text`` of rows with ``ids``; null ids give an empty text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = tokenizer_of(model)
        for batch in batches:
            ids = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(decoder.decode(ids), pa.string())], names=["doc_id", "text"])

    return in_batches(encoded.select("doc_id", "ids"), rows, "doc_id long, text string")


def verify_pieces(docs: DataFrame, model: str) -> DataFrame:
    """Per row: number and checksum of the ids, whether they are those of the sentencepiece library, and
    whether decoding gives the text back (its normalised form can differ from the text itself)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        own = tokenizer_of(model)
        other = sentencepiece.SentencePieceProcessor(model_file=model)
        names = ["doc_id", "n_ids", "ids_crc32", "parity", "round_trip"]
        for batch in batches:
            for keys, texts in _texts(batch):
                found = own.encode(texts)
                arrays = [np.frombuffer(x, "<u4") for x in found]
                wanted = other.encode(texts, num_threads=1)
                parity = [x.tolist() == y for x, y in zip(arrays, wanted, strict=True)]
                back = [a == b for a, b in zip(own.decode(arrays), texts, strict=True)]
                columns = [pa.array(keys, pa.int64()), pa.array([len(x) for x in arrays], pa.int64())]
                columns += [pa.array([zlib.crc32(x) for x in found], pa.int64()), pa.array(parity), pa.array(back)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return in_batches(texts_of(docs), rows, "doc_id long, n_ids long, ids_crc32 long, parity boolean, round_trip boolean")
