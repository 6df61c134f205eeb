"""Byte-level BPE by two tiers: a minimal perfect hash of the vocabulary, and merges over linked bytes.

A text is cut into pre-tokens by the pattern of its tokenizer. A pre-token that is a token of the vocabulary as
it stands is resolved by a minimal perfect hash (hash and displace): a bucket's displacement sends each of its
tokens to a slot of its own, there are as many slots as tokens, and the bytes stored at the slot decide whether it
is this token. All pre-tokens of a batch are looked up at once, as blocks of eight bytes. The others are merged:
bytes form a linked list, a heap holds the pairs that the vocabulary knows by rank and place, and a pair that has
changed since it was pushed is passed over, so a pre-token of n bytes takes n log n steps.

The tables are built once, on the driver, from the rank file, and have its size. Ids travel as little-endian
unsigned 32-bit integers in one binary column.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches

BUCKET = 4  # tokens in a bucket of the hash, on average
BATCH_CHARACTERS = 1 << 20
KEPT_MERGES = 600_000  # merged pre-tokens that a worker remembers; forgetting them changes no result
_TRIES = 4096
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (overflow wraps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Strings:
    """Byte strings inside one buffer, read as blocks of eight bytes that are zero behind their end."""

    def __init__(self, data: bytes, starts: np.ndarray, lengths: np.ndarray) -> None:
        padded = data + bytes(8)
        self.at_byte = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
        self.starts, self.lengths = starts, lengths

    def block(self, which: np.ndarray, k: int) -> np.ndarray:
        """Block ``k`` of strings that are longer than 8k bytes."""
        left = np.minimum(self.lengths[which] - 8 * k, 8)
        return self.at_byte[self.starts[which] + 8 * k] & _MASKS[left]

    def hashes(self, longest: int) -> np.ndarray:
        """One hash for each string; what stands beyond ``longest`` bytes has no part in it."""
        found = _mixed(self.lengths.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        which, k = np.flatnonzero(self.lengths > 0), 0
        while len(which) and 8 * k < longest:
            found[which] = _mixed(found[which] ^ self.block(which, k))
            k += 1
            which = which[self.lengths[which] > 8 * k]
        return found


def _displaced(hashes: np.ndarray, by: np.ndarray | int, size: int) -> np.ndarray:
    return (_mixed(hashes + np.asarray(by, np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(size)).astype(np.int64)


@dataclass
class PerfectHash:
    """Slots for ``keys``, one each, with the keys' bytes in the order of the slots."""

    data: bytes
    starts: np.ndarray
    lengths: np.ndarray
    displacements: np.ndarray  # by bucket; negative: the slot itself, less one
    order: np.ndarray  # number of the key in each slot

    @classmethod
    def of(cls, keys: list[bytes]) -> PerfectHash:
        """Keys must differ from each other."""
        n = len(keys)
        lengths = np.fromiter(map(len, keys), np.int64, n)
        longest = int(lengths.max(initial=0))
        hashes = Strings(b"".join(keys), np.cumsum(lengths) - lengths, lengths).hashes(longest)
        buckets = max(1, -(-n // BUCKET))
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        sizes = np.bincount(bucket, minlength=buckets)
        members = np.argsort(bucket, kind="stable")
        firsts = np.cumsum(sizes) - sizes
        displacements = np.zeros(buckets, np.int64)
        taken = np.zeros(n, bool)
        order = np.zeros(n, np.int64)
        free: Iterator[int] | None = None
        for b in np.argsort(-sizes, kind="stable").tolist():
            own = members[firsts[b] : firsts[b] + sizes[b]]
            if len(own) == 0:
                break
            if len(own) == 1:  # large buckets come first, so what is left is free for the single ones
                free = iter(np.flatnonzero(~taken).tolist()) if free is None else free
                slots = np.array([next(free)])
                displacements[b] = -int(slots[0]) - 1
            else:
                first, tries, slots = 0, 16, None
                while slots is None:
                    offered = _displaced(hashes[own][None, :], np.arange(first, first + tries)[:, None], n)
                    offered.sort(1)
                    fits = np.flatnonzero(~taken[offered].any(1) & (offered[:, 1:] != offered[:, :-1]).all(1))
                    if len(fits):
                        displacements[b] = first + fits[0]
                        slots = _displaced(hashes[own], displacements[b], n)
                    first, tries = first + tries, min(4 * tries, _TRIES)
                    if first > 1 << 26:
                        raise ValueError("two keys of the vocabulary have the same hash")
            taken[slots] = True
            order[slots] = own
        held = [keys[i] for i in order.tolist()]
        lengths = lengths[order]
        return cls(b"".join(held), np.cumsum(lengths) - lengths, lengths, displacements, order)

    def find(self, wanted: Strings) -> np.ndarray:
        """Number of the key that each string is; -1 where it is none."""
        count, n = len(wanted.lengths), len(self.order)
        if not count or not n:
            return np.full(count, -1, np.int64)
        mine = Strings(self.data, self.starts, self.lengths)
        hashes = wanted.hashes(int(self.lengths.max()))
        by = self.displacements[(hashes % np.uint64(len(self.displacements))).astype(np.int64)]
        slots = np.where(by < 0, -by - 1, _displaced(hashes, np.maximum(by, 0), n))
        same = self.lengths[slots] == wanted.lengths
        which, k = np.flatnonzero(same & (wanted.lengths > 0)), 0
        while len(which):
            equal = mine.block(slots[which], k) == wanted.block(which, k)
            same[which[~equal]] = False
            k += 1
            which = which[equal & (wanted.lengths[which] > 8 * k)]
        return np.where(same, self.order[slots], -1)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranks of the parts of ``piece`` when the pair of lowest rank, leftmost first, is joined as long as one is known."""
    size = len(piece)
    ends = list(range(1, size + 1))  # of the part that starts at a byte; 0: no part starts there any more
    before = list(range(-1, size - 1))
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(size - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        middle = ends[i]
        # joined into a part before it, or one of the two has grown since
        if not middle or middle >= size or ends[middle] != end:
            continue
        ends[i], ends[middle] = end, 0
        if end < size:
            before[end] = i
            if (r := get(piece[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        if (j := before[i]) >= 0 and (r := get(piece[j:end])) is not None:
            heapq.heappush(heap, (r, j, end))
    parts, i = [], 0
    while i < size:
        parts.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return parts


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token in base64 and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class BytePairs:
    """Encoder and decoder of one vocabulary, in which every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"{len(missing)} single bytes are no tokens")
        self.ranks, self.pattern = ranks, pattern
        self.hash = PerfectHash.of(list(ranks))
        self.ids = np.fromiter(ranks.values(), np.int64, len(ranks))
        self._ready = False

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_ready": False, "_split": None, "_kept": {}, "_bytes": {}}

    def _prepare(self) -> None:
        if not self._ready:
            self._split = regex.compile(self.pattern).findall
            self._kept: dict[bytes, bytes] = {}
            self._bytes = {rank: token for token, rank in self.ranks.items()}
            self._ready = True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        self._prepare()
        found: list[np.ndarray] = []
        first = held = 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= BATCH_CHARACTERS:
                found += self._encode(texts[first : i + 1])
                first, held = i + 1, 0
        return found + self._encode(texts[first:])

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        pieces: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = self._split(text)
            counts[i] = len(own)
            pieces += own
        # what the pattern leaves out is no part of any pre-token, so the pieces themselves are joined
        joined = "".join(pieces)
        data = joined.encode()
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        if len(data) != len(joined):  # from characters to bytes
            begins = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            ends = np.append(begins, len(data))[ends]
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        keys = self.hash.find(Strings(data, starts, ends - starts))
        whole = self.ids[keys]
        missed = np.flatnonzero(keys < 0)
        if len(self._kept) > KEPT_MERGES:
            self._kept.clear()
        kept = self._kept
        rest: list[bytes] = []
        for a, b in zip(starts[missed].tolist(), ends[missed].tolist(), strict=True):
            piece = data[a:b]
            if (parts := kept.get(piece)) is None:
                parts = np.array(merged(piece, self.ranks), "<u4").tobytes()
                if len(piece) <= 256:
                    kept[piece] = parts
            rest.append(parts)
        # each pre-token has one id or those of its parts
        sizes = np.ones(len(pieces), np.int64)
        sizes[missed] = np.fromiter(map(len, rest), np.int64, len(rest)) // 4
        ids = np.repeat(whole, sizes).astype("<u4")
        ids[np.repeat(keys < 0, sizes)] = np.frombuffer(b"".join(rest), "<u4")
        cuts = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(counts)]
        return np.split(ids, cuts[:-1]) if len(texts) else []

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens; an id that is no token raises ``KeyError``."""
        self._prepare()
        return b"".join(map(self._bytes.__getitem__, ids.tolist()))


def _codec(docs: DataFrame, codec: BytePairs):
    return docs.sparkSession.sparkContext.broadcast(codec)  # as large as the rank file


def encode_texts(docs: DataFrame, codec: BytePairs) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` of every row's whole text; null texts are empty, without ids.

    A row stands for itself: repeated ids and rows stay, a null id stays null, other columns are not read. Bytes
    that are no UTF-8 become U+FFFD first, as a Python string could not hold them.
    """
    shared = _codec(docs, codec)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = coder.encode([t or "" for t in part.column("text").to_pylist()])
                sizes, packed = pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, packed], names=["doc_id", "n_tokens", "ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8(F.col("text").cast("string")).alias("text"))
    return in_batches(texts, rows, "doc_id long, n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, codec: BytePairs) -> DataFrame:
    """``encoded`` with the column ``ids`` and ``decoded``, the bytes of its tokens (null ids: null)."""
    shared = _codec(encoded, codec)
    names = [c for c in encoded.columns if c != "decoded"]
    kept = encoded.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            found = [None if x is None else coder.decode(np.frombuffer(x, "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*names, "decoded"])

    return in_batches(kept, rows, schema)
