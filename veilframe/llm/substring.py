"""Repeated passages by an index of the windows of the whole corpus, in place of relative Lempel-Ziv parsing.

No document is parsed into factors with sources. A word goes if a window of ``WINDOW`` words that holds
it stands earlier in the corpus: a factor of that length or more is a run of such windows, so these are
the words that a parse without shorter factors, with windows checked over its borders, would remove.
Every block of documents contributes its windows, and the index is dealt over the tasks by digest.

Sending every window to the index would move the corpus many times over. So the blocks are indexed
twice. First come anchors, the smallest hashes of ``ANCHOR`` words among any ``WINDOW - ANCHOR + 1``
neighbours: equal windows have equal anchors, and only one place in six is one. Windows with an
anchor that occurs nowhere else cannot repeat; the others are sent with 128-bit digests. Tasks put
together what they hold of an anchor or a window before sending, so a passage that stands in a third
of all documents arrives once from each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import as_bytes, in_batches

WINDOW = 20
ANCHOR = 10
_FLUSH = 2_000_000  # anchors or windows that a task puts together at once
_CARRIED = "__carried_"
_SHAPE = (T.LongType(), T.LongType(), T.LongType(), T.BinaryType())
RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
        T.StructField("kept_text", T.StringType()),
        T.StructField(
            "factors",
            T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])),
        ),
    ]
)
_LISTED = -1  # start of a row that lists windows
_LAST = (1 << 63) - 1  # stands for a null id: such documents come after all others


def _mix(a: np.ndarray) -> np.ndarray:
    """Finishing steps of splitmix64."""
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))


def rolling(hashes: np.ndarray, length: int) -> np.ndarray:
    """A digest of each ``length`` consecutive hashes, put together from halves."""
    count = len(hashes) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    power, run, done, out = 1, hashes, 0, None
    while True:
        if length & power:
            part = run[done : done + count]
            out = part if out is None else _pair(out, part)
            done += power
        if done == length:
            return out
        run = _pair(run[: len(run) - power], run[power:])
        power *= 2


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def anchors(hashes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of every window, and the places (of ``anchor`` words) that are one, as values."""
    grams = rolling(hashes, anchor)
    width = window - anchor + 1
    if len(grams) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    least = np.lib.stride_tricks.sliding_window_view(grams, width).min(1)
    # a place is an anchor if it holds the least value of a window over it
    widest = np.zeros(len(grams), np.uint64)
    padded = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
    widest = np.lib.stride_tricks.sliding_window_view(padded, width).max(1)
    return least, grams[grams == widest]


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each different anchor of a task with the documents it stands in, once for each place."""
    held: list[np.ndarray] = []
    docs: list[int] = []
    size = 0

    def out() -> pa.RecordBatch:
        values = np.concatenate(held)
        owner = np.repeat(np.array(docs, np.int64), [len(v) for v in held])
        order = np.argsort(values, kind="stable")
        values = values[order]
        first = np.flatnonzero(_starts([values]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(values)), pa.int32()), pa.array(owner[order]))
        return pa.RecordBatch.from_arrays([_signed(values[first]), lists], names=["anchor", "docs"])

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
            _, found = anchors(word_hashes(text.split()))
            if len(found):
                held.append(found)
                docs.append(doc)
                size += len(found)
            if size > _FLUSH:
                yield out()
                held, docs, size = [], [], 0
    if held:
        yield out()


def _repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, anchor) of anchors that stand in two places. Rows come sorted; one row waits for its successor."""
    rest: pa.RecordBatch | None = None
    known = False  # the waiting row's anchor was in the row before it

    def rows(batch: pa.RecordBatch, mask: np.ndarray) -> pa.RecordBatch:
        chosen = batch.filter(pa.array(mask))
        lengths = chosen.column("docs").value_lengths().to_numpy(zero_copy_only=False)
        keys = np.repeat(chosen.column("anchor").to_numpy(zero_copy_only=False), lengths)
        pairs = pa.table([chosen.column("docs").flatten(), pa.array(keys)], names=["doc", "anchor"])
        return pairs.group_by(["doc", "anchor"]).aggregate([]).combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        keys = batch.column("anchor").to_numpy(zero_copy_only=False)
        same = keys[1:] == keys[:-1]
        many = batch.column("docs").value_lengths().to_numpy(zero_copy_only=False) > 1
        many[1:] |= same
        many[:-1] |= same
        many[0] |= known
        known = bool(many[-1]) if len(same) == 0 else bool(same[-1])
        many[-1] = False
        yield from rows(batch, many)
        rest = batch.slice(batch.num_rows - 1)
    if rest is not None:
        yield from rows(rest, (rest.column("docs").value_lengths().to_numpy(zero_copy_only=False) > 1) | known)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with a repeated anchor: each different one of a task once, at its first place; and for each document
    a row that lists its windows that stand earlier in the same task."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    unpack = zstandard.ZstdDecompressor().decompress

    def out() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        places = _starts(columns)  # repeated rows of the table stand at the same place
        columns = [c[places] for c in columns]
        new = _starts(columns[:2])
        first = [c[new] for c in columns]
        # the others are later whatever other tasks hold; they go by document, so none of them meets its hot window
        doc, twin, start = (c[~new] for c in columns[2:])
        order = np.lexsort((start, twin, doc))
        doc, twin, start = doc[order], twin[order], start[order]
        heads = np.flatnonzero(_starts([doc, twin])) if len(doc) else np.zeros(0, np.int64)
        bounds = np.concatenate((np.zeros(len(first[0]), np.int64), heads, [len(doc)]))
        spread = _mix(doc[heads].view(np.uint64) + np.uint64(1))
        rest = [spread, spread, doc[heads], twin[heads], np.full(len(heads), _LISTED, np.int32)]
        both = [np.concatenate(c) for c in zip(first, rest, strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(start))
        return pa.RecordBatch.from_arrays(
            [_signed(both[0]), _signed(both[1]), *map(pa.array, both[2:]), lists], names=["d1", "d2", "doc", "twin", "start", "others"]
        )

    for batch in batches:
        for doc, twin, z, repeated in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "twin", "z", "anchors")), strict=True):
            words = unpack(z).split()
            hashes = word_hashes(words)
            own, _ = anchors(hashes)
            starts = np.flatnonzero(np.isin(own, np.array(repeated, np.int64).view(np.uint64)))
            if len(starts):
                digests = [rolling(hashes, WINDOW)[starts], rolling(word_hashes(words, 1), WINDOW)[starts]]
                held.append((*digests, np.full(len(starts), doc, np.int64), np.full(len(starts), twin, np.int32), starts.astype(np.int32)))
                size += len(starts)
            if size > _FLUSH:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, twin, start) of windows that also start earlier. Rows come sorted by digest and place."""
    names = ["doc", "twin", "start"]
    head: tuple | None = None  # digest and place of the group that is open
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("d1", "d2", *names)]
        new = _starts(columns[:2])
        new[0] = head is None or (columns[0][0], columns[1][0]) != head[:2]
        leader = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        open_place = head[2:] if head is not None else (0, 0, 0)
        firsts = [np.where(leader < 0, open_place[i], c[np.maximum(leader, 0)]) for i, c in enumerate(columns[2:])]
        later = np.logical_or.reduce([c != f for c, f in zip(columns[2:], firsts, strict=True)]) & (columns[4] != _LISTED)
        if leader[-1] >= 0:
            head = tuple(c[leader[-1]] for c in columns)
        sizes = batch.column("others").value_lengths().to_numpy(zero_copy_only=False)
        listed = [np.repeat(c, sizes) for c in columns[2:4]]
        listed.append(batch.column("others").flatten().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((c[later], x))) for c, x in zip(columns[2:], listed, strict=True)], names=names
        )


def cut_words(text: bytes, starts: np.ndarray, count: int) -> tuple[bytes, np.ndarray, list[tuple[int, int]]]:
    """Text without the words of the windows at ``starts``, which words stay, and the factors as (start, length)."""
    keep = np.ones(count, bool)
    starts = np.unique(starts)
    factors: list[tuple[int, int]] = []
    if len(starts):
        breaks = np.flatnonzero(np.diff(starts) > 1)
        for a, b in zip(starts[np.append(0, breaks + 1)].tolist(), starts[np.append(breaks, len(starts) - 1)].tolist(), strict=True):
            factors.append((a, b - a + WINDOW))
            keep[a : b + WINDOW] = False
    if keep.all():
        return text, keep, factors
    # a removed word goes with the white space behind it
    space = np.isin(np.frombuffer(text, np.uint8), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    begins = np.flatnonzero(~space & np.append(True, space[:-1]))
    word = np.searchsorted(begins, np.arange(len(text)), side="right") - 1
    stays = np.append(keep, True)[word]  # what stands before the first word stays
    return np.frombuffer(text, np.uint8)[stays].tobytes(), keep, factors


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        digests = [xxhash.xxh128_intdigest(b" ".join(t.split())) for t in texts]
        halves = [np.array([d >> shift & (1 << 64) - 1 for d in digests], np.uint64) for shift in (64, 0)]
        z = pa.array([pack(t) for t in texts], pa.binary())
        others = [c for c in batch.schema.names if c.startswith(_CARRIED)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *map(_signed, halves), z, *map(batch.column, others)], names=["doc_id", "h", "g", "z", *others]
        )


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out = []
        for doc, copy, z, starts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "copy", "z", "starts")), strict=True):
            text = unpack(z)
            words = text.split()
            if copy:
                starts = range(len(words) - WINDOW + 1)
            cut, keep, factors = cut_words(text, np.array(starts or [], np.int64), len(words))
            left = words if keep.all() else [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            sha = hashlib.sha256(b" ".join(left)).hexdigest()
            spans = [{"start": a, "length": b} for a, b in factors]
            out.append((None if doc == _LAST else doc, len(words), len(words) - len(left), sha, cut.decode("utf-8", "replace"), spans))
        schema = to_arrow_schema(RESULT)
        columns = list(zip(*out, strict=True)) if out else [[]] * len(schema)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
        others = [c for c in batch.schema.names if c.startswith(_CARRIED)]
        yield pa.RecordBatch.from_arrays([*arrays, *map(batch.column, others)], names=[*schema.names, *others])


def remove_repeats(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Per row: words, removed words, checksum of the kept ones, the text without them, and the factors found.

    Columns named in ``carry`` are handed through.

    A window that also starts earlier (smaller id, or earlier in the same document) is removed. Null texts count
    as empty. Rows with a null id come after all others. Rows that share an id and differ in text are taken in
    the order of a digest of the text; rows equal in both are one document, written once for each row.
    """
    handed = [F.col(f"`{c}`").alias(f"{_CARRIED}{i}") for i, c in enumerate(carry or [])]
    own = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.col("text").cast("string").alias("text")]
    rows, full = docs.select(*own), docs.select(*own, *handed)
    extra = T.StructType([f for f in full.schema if f.name.startswith(_CARRIED)])
    shape = T.StructType([T.StructField(c, t) for c, t in zip(("doc_id", "h", "g", "z"), _SHAPE, strict=True)] + extra.fields)
    packed = in_batches(full, _digest_rows, shape)
    # copies of whole texts need no look at their words
    marked = packed.select("doc_id", "h", "g").distinct()
    first = marked.groupBy("h", "g").agg(F.min("doc_id").alias("first"))
    known = marked.join(first, ["h", "g"]).groupBy("doc_id")
    known = known.agg(F.sort_array(F.collect_list(F.struct("h", "g", "first"))).alias("own"))
    anchored = in_batches(rows, _anchor_rows, "anchor long, docs array<long>")
    anchored = anchored.repartition("anchor").sortWithinPartitions("anchor")
    repeated = in_batches(anchored, _repeated_anchors, "doc_id long, anchor long")
    repeated = repeated.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))

    def place(df: DataFrame) -> DataFrame:
        return (
            df.withColumn("at", F.expr("filter(own, x -> x.h = h and x.g = g)[0]"))
            .withColumn("twin", F.expr("cast(array_position(own, at) - 1 as int)"))
            .withColumn("copy", F.expr("at.first <> doc_id"))
        )

    to_look_up = place(packed.join(known, "doc_id").join(repeated, "doc_id")).filter("not copy").select("doc_id", "twin", "z", "anchors")
    windows = in_batches(
        to_look_up, _window_rows, "d1 long, d2 long, doc long, twin int, start int, others array<int>"
    )
    windows = windows.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "doc", "twin", "start")
    later = in_batches(windows, _later_windows, "doc_id long, twin int, start int")
    later = later.groupBy("doc_id").agg(F.collect_list(F.struct("twin", "start")).alias("found"))
    ready = place(packed.join(known, "doc_id").join(later, "doc_id", "left"))
    starts = F.expr("transform(filter(found, x -> x.twin = twin), x -> x.start)").alias("starts")
    ready = ready.select("doc_id", "copy", "z", starts, *extra.names)
    result = in_batches(ready, _cut_rows, T.StructType(RESULT.fields + extra.fields))
    return result.select("*", *[F.col(f"{_CARRIED}{i}").alias(c) for i, c in enumerate(carry or [])]).drop(*extra.names)
