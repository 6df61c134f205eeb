"""Packing token sequences of bounded length with balanced attention cost.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n``: the layers see each token once, and
attention sees each pair. Documents are cut into full sequences and one rest; the rests of a
buffer of documents go, in descending length, to the sequence of lowest cost so far that has room,
so that expensive long rests meet cheap short ones. A rest that fits nowhere whole is cut over the
sequences with most room. The number of sequences is the least possible, so at most one sequence of
a buffer is not full after the last document. Buffers are cut from a task's own rows: nothing is
shuffled, and the sequence numbers of tasks do not meet.
"""

from __future__ import annotations

import heapq
import os
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import in_batches, texts_of

LENGTH = 2048
LINEAR = 1.0
QUADRATIC = 1.0 / 2048
BUFFER_TOKENS = 4_000_000
CACHED_WORDS = 1_500_000
_TASK_SEQUENCES = 1 << 36  # numbers set aside for each task

#: White space other than a space and a line end.
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(tokens: int) -> float:
    return LINEAR * tokens + QUADRATIC * tokens * tokens


@dataclass
class Sequence:
    """Filled length, cost so far, and pieces (document, start, length, offset)."""

    used: int = 0
    price: float = 0.0
    pieces: list[tuple[int, int, int, int]] = field(default_factory=list)

    def add(self, document: int, start: int, length: int) -> None:
        self.pieces.append((document, start, length, self.used))
        self.used += length
        self.price += cost(length)


def pack(sizes: Iterable[int], capacity: int = LENGTH) -> list[Sequence]:
    """Spread documents of ``sizes`` tokens over the fewest sequences of ``capacity`` tokens."""
    full: list[Sequence] = []
    rests: list[tuple[int, int, int]] = []  # length, document, start
    for document, size in enumerate(sizes):
        for start in range(0, size - capacity + 1, capacity):
            own = Sequence()
            own.add(document, start, capacity)
            full.append(own)
        if size % capacity:
            rests.append((size % capacity, document, size - size % capacity))
    total = sum(r[0] for r in rests)
    # the last sequence is only as long as what is left for it, so the others end up full
    count = -(-total // capacity)
    shared = [Sequence() for _ in range(count)]
    room = [capacity] * count
    if count:
        room[-1] = total - capacity * (count - 1)
    open_ = _ByRoom(capacity)
    for i in range(count):
        open_.put(room[i], (0.0, i))
    for length, document, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        while length:
            # the cheapest sequence with room for all of it; where there is none it is cut
            found = open_.cheapest(length)
            at = room[found[1]] if found else open_.most()
            _, i = open_.take(at)
            part = min(length, at)
            shared[i].add(document, start, part)
            room[i] -= part
            start, length = start + part, length - part
            if room[i]:
                open_.put(room[i], (shared[i].price, i))
    return full + shared


class _ByRoom:
    """Open sequences as (price, number), by the room that is left in them.

    Those of equal room form a heap, and a tree over the rooms holds the cheapest of every stretch.
    """

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.tree: list[tuple[float, int] | None] = [None] * (2 * self.size)

    def _changed(self, room: int) -> None:
        heap, at = self.heaps[room], room + self.size
        self.tree[at] = heap[0] if heap else None
        while at > 1:
            at //= 2
            left, right = self.tree[2 * at], self.tree[2 * at + 1]
            self.tree[at] = right if left is None else left if right is None else min(left, right)

    def put(self, room: int, item: tuple[float, int]) -> None:
        heapq.heappush(self.heaps[room], item)
        self._changed(room)

    def take(self, room: int) -> tuple[float, int]:
        item = heapq.heappop(self.heaps[room])
        self._changed(room)
        return item

    def cheapest(self, room: int) -> tuple[float, int] | None:
        """Among those with at least this room."""
        at = room + self.size
        best = self.tree[at]
        while at > 1:
            if at % 2 == 0 and (other := self.tree[at + 1]) is not None and (best is None or other < best):
                best = other
            at //= 2
        return best

    def most(self) -> int:
        """The most room that any has."""
        at = 1
        while at < self.size:
            at = 2 * at + (self.tree[2 * at + 1] is not None)
        return at - self.size


def _little_endian(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder != "little":
        packed.byteswap()
    return packed.tobytes()


class WordTokenizer:
    """Token ids of whole texts, with the ids of words kept.

    Byte-level BPE never joins what its own pattern separates, and the pattern always separates
    before a single space between two characters that are not white space. A text is cut there,
    and each different word is encoded once. Texts with other white space around their spaces, or
    with a special token in them, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}  # by word, as it stands behind a space
        self.bare: dict[str, bytes] = {}  # as it stands behind a line end
        self.line_end = self._encode(["\n"])[0]
        self.marks = {m: self._encode([m])[0] for m in ".,;:!?"}
        self.model = self.tokenizer.model if self.tokenizer.normalizer is None else None
        # fixed rule of byte-level models: printable bytes stand for themselves, the others for U+0100 and on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in own]
        self.signs = {b: 256 + i for i, b in enumerate(others)}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [_little_endian(x.ids) for x in found]

    def _simple(self, word: str, behind: str = "\u0120") -> bytes | None:
        """Ids of letters, with a mark behind them or not: they need no pattern, the model gets them directly."""
        core = word[:-1] if word[-1:] in self.marks else word
        known = self.known if behind else self.bare
        if (ids := known.get(core)) is None:
            if self.model is None or not core.isalpha():
                return None
            text = core
            if not core.isascii():
                if max(core) >= "\u0250":
                    return None
                text = core.encode().decode("latin-1").translate(self.signs)
            ids = known[core] = _little_endian([t.id for t in self.model.tokenize(behind + text)])
        return ids if core is word else ids + self.marks[word[-1]]

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Encode words that are not known yet, as they stand behind a space.

        Returned, not kept, are those with a line end in them: they seldom come again, their parts do.
        """
        known, rest, once = self.known, [], {}
        for w in new:
            if w[0] == "\n":
                if (ids := self._simple(w[1:], "")) is None:
                    rest.append(w)
                else:
                    known[w] = self.line_end + ids
            elif "\n" in w:  # a single line end between words is always cut out
                first, *others = w.split("\n")
                parts = [self._simple(first), *(self._simple(x, "") for x in others)]
                if None in parts:
                    rest.append(w)
                else:
                    once[w] = self.line_end.join(parts)
            elif (ids := self._simple(w)) is None:
                rest.append(w)
            else:
                known[w] = ids
        known.update(zip(rest, self._encode([w if w[0] == "\n" else " " + w for w in rest]), strict=True))
        return once

    def _words(self, text: str) -> list[str] | None:
        """The words between single spaces, and those behind single line ends with them; None where white space stands
        beside one, or a special token in the text."""
        words = text.split(" ")
        if not all(words) or any(s in text for s in self.special):
            return None
        if any(c in text for c in _OTHER_SPACE):
            return None if any(w[0].isspace() or w[-1].isspace() for w in words) else words
        if "\n" in text:
            if "\n " in text or " \n" in text or text[0] == "\n" or text[-1] == "\n":
                return None
            if "\n\n" not in text:  # single line ends are cut out too, and go to the word behind them
                return text.replace("\n", " \n").split(" ")
        return words

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cut = list(map(self._words, texts))
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
            self.bare.clear()
        # texts that are not cut, and the first word of the others, which no space precedes
        alone = iter(self._encode([t if words is None else words[0] for t, words in zip(texts, cut, strict=True)]))
        once = self._learn(set().union(*filter(None, cut)).difference(self.known))
        self.known.update(once)  # until these texts are done
        ids = self.known.__getitem__
        done = [first + b"".join(map(ids, words[1:] if words else ())) for first, words in zip(alone, cut, strict=True)]
        for word in once:
            del self.known[word]
        return done


def _pieces(ids: list, tokens: list[bytes], first: int, capacity: int) -> tuple[pa.RecordBatch, int]:
    sequences = pack([len(t) // 4 for t in tokens], capacity)
    rows = []
    for number, sequence in enumerate(sequences, first):
        for document, start, length, offset in sequence.pieces:
            crc = zlib.crc32(memoryview(tokens[document])[4 * start : 4 * (start + length)])
            rows.append((ids[document], start, length, crc, len(tokens[document]) // 4, number, offset))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    arrays = [pa.array(c, pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCHEMA.split(", ")]), first + len(sequences)


_tokenizers: dict[str, WordTokenizer] = {}  # one for each worker process, its words are kept between tasks


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = LENGTH) -> DataFrame:
    """One row per piece: where it is in its document, the checksum of its ids, and its place in a sequence.

    A document is the ids of its text (null: empty) and then ``end_id``, so every row of the table gives at
    least one token; repeated rows are packed each for itself, and a null id stays null. ``tokenizer`` is the
    path of a byte-level BPE file for the tokenizers library, the same on every worker.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        if tokenizer not in _tokenizers:
            _tokenizers[tokenizer] = WordTokenizer(tokenizer)
        encoder = _tokenizers[tokenizer]
        number = TaskContext.get().partitionId() * _TASK_SEQUENCES
        end = np.array([end_id], "<u4").tobytes()
        ids: list = []
        tokens: list[bytes] = []
        held = 0
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for at in range(0, len(texts), 1024):
                ids += batch.column("doc_id")[at : at + 1024].to_pylist()
                new = [t + end for t in encoder.encode(texts[at : at + 1024])]
                tokens += new
                held += sum(map(len, new)) // 4
                if held >= BUFFER_TOKENS:
                    out, number = _pieces(ids, tokens, number, capacity)
                    yield out
                    ids, tokens, held = [], [], 0
        if ids:
            yield _pieces(ids, tokens, number, capacity)[0]

    return in_batches(texts_of(docs), rows, SCHEMA)
