"""Quality rules, and repetition found with suffix arrays over words.

A task sorts the suffixes of its documents by prefix doubling: after step k the rank of a
position stands for the 2**k words from there. Ranks start from (document, word), so documents
never match each other and a whole batch is sorted at once. Neighbours in the sorted order share
their longest common prefix; the larger of a suffix's two is the longest repeat that starts there.
A repeat that the one before it does not already contain is maximal to the left, so these are the
occurrences of the maximal repeated substrings (the intervals of the common-prefix array). Their
spans are united, and a text is refused if they cover too large a part of it or one is too long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, concat_words, in_batches, texts_of

LEAST_REPEAT = 10  # words; shorter repeats are ordinary language
MOST_COVERED = 0.25
LONGEST_REPEAT = 100
WINDOW = 8
_CHUNK_BYTES = 3_000_000

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_covered long, longest_repeat long, repeats array<struct<start:int,length:int>>"
)


def sorted_suffixes(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order of ``codes`` and the ranks after every doubling.

    ``ends`` marks the closing position of each document; they are all different from each other
    and from every word. A rank is the place of its group's first suffix in the order so far, so
    only groups of several suffixes have to be sorted again.
    """
    n = len(codes)
    keys = np.where(ends, codes.max(initial=0) + 1 + np.arange(n), codes)
    order = np.argsort(keys, kind="stable")
    new = np.ones(n, bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, step = [rank.copy()], 1
    active = order[~(new & np.append(new[1:], True))]
    while len(active):
        # an active suffix is longer than the step: the words up to its end would be unlike any other
        first, second = rank[active], rank[active + step]
        active = active[np.lexsort((second, first))]
        first, second = rank[active], rank[active + step]
        group = np.ones(len(active), bool)
        group[1:] = first[1:] != first[:-1]
        part = group.copy()
        part[1:] |= second[1:] != second[:-1]
        place = np.arange(len(active))
        begin = np.maximum.accumulate(np.where(group, place, 0))
        rank[active] = first + np.maximum.accumulate(np.where(part, place, 0)) - begin
        active = active[~(part & np.append(part[1:], True))]
        levels.append(rank.copy())
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, levels


def longest_repeats(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position the length of the longest word sequence there that also starts elsewhere in its document.

    Equal words of different documents need different codes.
    """
    n = len(codes)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    order, levels = sorted_suffixes(codes, ends)
    same = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    left, right = order[same], order[same + 1]
    common = np.zeros(len(same), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = np.minimum(left + common, n - 1), np.minimum(right + common, n - 1)
        common += np.where((a != b) & (levels[k][a] == levels[k][b]), 1 << k, 0)
    np.maximum.at(longest, left, common)
    np.maximum.at(longest, right, common)
    return longest


def covered_by(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Whether each of ``n`` positions lies in one of the spans."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges[:-1]) > 0


def _measure(ids: list, texts: list[bytes]) -> pa.RecordBatch:
    words, owner, sizes = concat_words(texts)
    count = len(texts)
    codes: dict[bytes, int] = {}
    own = np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)
    # one closing position behind each document
    at = np.arange(len(words)) + owner
    total = len(words) + count
    closing = np.cumsum(sizes + 1) - 1
    keys = np.zeros(total, np.int64)
    keys[at] = owner * max(len(codes), 1) + own
    ends = np.zeros(total, bool)
    ends[closing] = True
    longest = longest_repeats(keys, ends)
    document = np.repeat(np.arange(count), sizes + 1)

    def per_document(marks: np.ndarray) -> np.ndarray:
        return np.bincount(document, weights=marks, minlength=count).astype(np.int64)

    base = np.flatnonzero(longest >= WINDOW)
    repeat_words = per_document(covered_by(base, np.full(len(base), WINDOW), total))
    # a repeat whose predecessor is longer by one is the tail of that one
    before = np.concatenate(([0], longest[:-1]))
    maximal = np.flatnonzero((longest >= LEAST_REPEAT) & (before <= longest))
    covered = per_document(covered_by(maximal, longest[maximal], total))
    most = np.zeros(count, np.int64)
    np.maximum.at(most, document, longest)
    chars, symbols, lines = [], [], []
    stop = np.cumsum(sizes)
    for i, text in enumerate(texts):
        chars.append(len(b"".join(words[stop[i] - sizes[i] : stop[i]]).decode("utf-8", "replace")))
        symbols.append(len(text) - len(text.translate(None, b"#*$%&|<>")))
        filled = [line for line in text.split(b"\n") if line.strip()]
        lines.append(len(filled) - len(set(filled)))
    failed = (sizes < 20) | (100 * repeat_words > 30 * sizes)
    kept = ~failed & (covered <= MOST_COVERED * sizes) & (most <= LONGEST_REPEAT)
    place = maximal - (closing - sizes)[document[maximal]]
    spans = pa.StructArray.from_arrays(
        [pa.array(place, pa.int32()), pa.array(longest[maximal], pa.int32())], names=["start", "length"]
    )
    bounds = np.searchsorted(document[maximal], np.arange(count + 1))
    columns = [
        pa.array(ids, pa.int64()),
        *[pa.array(x, pa.int64()) for x in (sizes, chars, symbols, lines, repeat_words)],
        pa.array(failed), pa.array(kept), pa.array(covered), pa.array(most),
        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))
        start = size = 0
        for i, text in enumerate(texts):
            if i > start and size + len(text) > _CHUNK_BYTES:
                yield _measure(ids[start:i], texts[start:i])
                start, size = i, 0
            size += len(text)
        if texts:
            yield _measure(ids[start:], texts[start:])


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base rules, the repeats found, and the verdict.

    ``repeats`` holds the occurrences of maximal repeats of ``LEAST_REPEAT`` words and more as (start, length)
    in words. A text without words (null too) has zeros everywhere and fails the base rules. Repeated rows and
    null ids are kept as they are; other columns are not read.
    """
    return in_batches(texts_of(docs), _rows, SCHEMA)
