"""Repairing the structure of conversations by iterative-deepening A*.

A conversation should be an optional system turn and then pairs of a user's and an assistant's turn. Each turn may
be kept, given another role or deleted, and empty turns may be inserted, at a price each. The cheapest edits are
searched depth first, in ASCII order of their initials, under a bound of cost that rises to the least cost that
exceeded it. A table holds for each state (turn, place in the grammar) that failed how much it needs at least; a
state is not entered with less. The first accepting path is the answer, so ties go to the least string.

Rows are sorted by range over (conversation, turn, role, text) and read as a stream, so a conversation is never
gathered. One that lies within a partition and has at most ``SEGMENT`` rows is repaired where it is read. Others are cut
into segments; each is searched for every pair of grammar states at its two ends, and the segments of a conversation
are joined in order, as cheapest costs with their least strings add up. Only what must be sequential is so: the
audit string and the checksum of one conversation, both over a sorted stream.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

SEGMENT = 32
KEPT_SHAPES = 100_000

# prices and grammar: fixed values
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = ("su", "ua", "au")
_REACHED = {START: (START, SYSTEM, USER, ASSISTANT), SYSTEM: (SYSTEM, USER, ASSISTANT), USER: (USER, ASSISTANT), ASSISTANT: (USER, ASSISTANT)}

_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ROW = "part int, segment long, place int, turn long, role string, text string, is_blank boolean, cut boolean, local boolean"


def following(state: int) -> int:
    """The state after a turn whose role is chosen: the one the grammar asks for."""
    return ASSISTANT if state == USER else USER


def cheapest(turns: list[tuple[str, str]], start: int = START, ends: Iterable[int] = ENDS) -> tuple[int, str]:
    """Least cost and ASCII-least initials of edits that lead from ``start`` to one of ``ends``.

    A turn is its role's initial and its fault: ``b`` and ``d`` must be deleted, ``t`` costs more unless it is, a
    space is none. There has to be a way: one end other than ``SYSTEM``, or a system turn that may stay.
    """
    ends = frozenset(ends)
    size = len(turns)
    floor = [0] * (size + 1)  # every faulty turn costs its deletion at least
    for i in range(size - 1, -1, -1):
        floor[i] = floor[i + 1] + (DELETE if turns[i][1] != " " else 0)
    need: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def moves(i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        if i < size:
            yield "D", DELETE, i + 1, state
        yield "I", INSERT, i, following(state)
        if i < size and turns[i][1] not in "bd":
            extra = TRUNCATED if turns[i][1] == "t" else 0
            if (kept := _NEXT.get((state, turns[i][0]))) is not None:
                yield "K", KEEP + extra, i + 1, kept
            yield "R", REROLE + extra, i + 1, following(state)

    def visit(i: int, state: int, room: int) -> int | float | None:
        """None if a path was found, else the least cost from here, which exceeds ``room``."""
        if i == size and state in ends:
            return None
        least = need.get((i, state), floor[i])
        if least > room:
            return least
        least = math.inf
        for letter, price, j, then in moves(i, state):
            if price > room:
                least = min(least, price + need.get((j, then), floor[j]))
                continue
            path.append(letter)
            rest = visit(j, then, room - price)
            if rest is None:
                return None
            path.pop()
            least = min(least, price + rest)
        need[i, state] = least
        return least

    bound = floor[0]
    while (more := visit(0, start, bound)) is not None:
        bound = more
    return bound, "".join(path)


def apply_edits(audit: str, rows: Iterable[tuple[str, str]], state: int = START) -> Iterator[str]:
    """``role:text`` of each turn that the edits leave."""
    rows = iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = _NEXT[state, role[:1]]
        else:
            state = following(state)
            role = _ROLES[state]
        yield f"{role}:{text}"


@dataclass
class Turns:
    """What is counted over consecutive turns; ``then`` adds those of the stretch behind."""

    low: int | None = None
    high: int | None = None
    distinct: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None  # initials at the two ends
    last: str | None = None

    def then(self, other: Turns) -> Turns:
        if other.low is not None:  # sorted, so only the turn at the border can be common
            if self.high is not None:
                self.distinct -= self.high == other.low
            self.low = other.low if self.low is None else self.low
            self.high = other.high
            self.distinct += other.distinct
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if other.first is not None:
            self.illegal += self.last is not None and self.last + other.first not in _LEGAL
            self.first = other.first if self.first is None else self.first
            self.last = other.last
        return self

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        kind = {"b": "blank", "d": "duplicate", "t": "truncated"}.get(fault)
        own = Turns(turn, turn, int(turn is not None), first=initial, last=initial)
        if kind:
            setattr(own, kind, 1)
        self.then(own)

    def values(self) -> tuple[int, ...]:
        return self.gaps, self.blank, self.duplicate, self.truncated, self.illegal


def fault_of(blank: bool, duplicate: bool, cut: bool) -> str:
    return "b" if blank else "d" if duplicate else "t" if cut else " "


class Repairer:
    """The search, with the answers for shapes seen before (roles' initials and faults)."""

    def __init__(self) -> None:
        self.kept: dict[tuple, tuple[int, str]] = {}

    def __call__(self, turns: list[tuple[str, str]], start: int = START, ends: tuple[int, ...] = ENDS) -> tuple[int, str]:
        key = (tuple(turns), start, ends)
        if key not in self.kept:
            if len(self.kept) > KEPT_SHAPES:
                self.kept.clear()
            self.kept[key] = cheapest(turns, start, ends)
        return self.kept[key]


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults made by the crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row (``copies`` 0), 1 empties the text, 2 takes its ``.!?``, 3 repeats it (``copies`` 2), 4 sets the role
    to user. Nulls in role and text, and in the key's text, are read as one space.
    """
    part = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _sorted(rows: DataFrame) -> DataFrame:
    """Sorted over all partitions. Range bounds are sampled on the driver, so long texts count there by their beginning."""
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64))
    return ranged.sortWithinPartitions("conv_id", "turn", "role", "text")


@dataclass
class _Run:
    """Rows of one conversation as they come by, at most a segment of them."""

    conv: int | None
    whole: bool  # its beginning is in this partition
    segment: int = 0
    rows: list[tuple] = field(default_factory=list)  # turn, role, text, blank, cut
    seen: set[tuple[str, str]] = field(default_factory=set)
    local: list[bool] = field(default_factory=list)  # first of its role and text in the segment


def _first_pass(segment: int):
    """Sorted rows -> results of the conversations that a partition holds whole, rows of the others."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        repair = Repairer()
        results: list[tuple] = []
        open_rows: list[tuple] = []

        def unfinished(run: _Run) -> None:
            for place, (row, local) in enumerate(zip(run.rows, run.local, strict=True)):
                open_rows.append((run.conv, part, run.segment, place, *row, local))
            if not run.rows:  # every conversation is told of, also one of which nothing is left
                open_rows.append((run.conv, part, run.segment, -1, None, None, None, None, None, None))
            run.segment, run.rows, run.seen, run.local = run.segment + 1, [], set(), []

        def finished(run: _Run) -> None:
            counted, shape = Turns(), []
            for (turn, role, _, blank, cut), local in zip(run.rows, run.local, strict=True):
                shape.append((role[:1], fault_of(blank, not local, cut)))
                counted.add(turn, *shape[-1])
            price, audit = repair(shape)
            text = "\n".join(apply_edits(audit, ((r[1], r[2]) for r in run.rows)))
            results.append((run.conv, *counted.values(), price, audit, hashlib.sha256(text.encode()).hexdigest()))

        def out() -> Iterator[pa.RecordBatch]:
            if results or open_rows:
                yield _batch(results, open_rows)
                results.clear()
                open_rows.clear()

        run: _Run | None = None
        for batch in batches:
            for conv, turn, role, text, copies, blank, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if run is None or run.conv != conv:
                    if run is not None:
                        (finished if run.whole and not run.segment else unfinished)(run)
                    run = _Run(conv, run is not None)
                for _ in range(copies):
                    if len(run.rows) == segment:
                        unfinished(run)
                    run.rows.append((turn, role, text, blank, cut))
                    run.local.append((role, text) not in run.seen)
                    run.seen.add((role, text))
            yield from out()
        if run is not None:  # it may go on in the next partition
            unfinished(run)
        yield from out()

    return read


def _fields(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    return [(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))]


def _batch(results: list[tuple], rows: list[tuple]) -> pa.RecordBatch:
    left, right = _fields(_RESULT), _fields(_ROW)
    filled = [(*r, *[None] * len(right)) for r in results]
    filled += [(r[0], *[None] * (len(left) - 1), *r[1:]) for r in rows]
    return _records(filled, left + right)


def _records(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


_PAIRS = [(a, b) for a, ends in _REACHED.items() for b in ends]
_COUNTED = "low long, high long, distinct long, blank long, duplicate long, truncated long, illegal long, first string, last string"
_WAYS = ", ".join(f"cost{a}{b} long, audit{a}{b} string" for a, b in _PAIRS)
_SEGMENTS = f"conv_id long, part int, segment long, {_COUNTED}, {_WAYS}"


def _solve(table: pa.Table) -> pa.Table:
    """One segment: what is counted in it, and the cheapest way between every two states of the grammar."""
    rows = table.sort_by("place").select(["conv_id", "part", "segment", "turn", "role", "blank", "duplicate", "cut", "place"]).to_pylist()
    counted, shape = Turns(), []
    for r in rows:
        if r["place"] < 0:
            continue
        shape.append((r["role"][:1], fault_of(r["blank"], r["duplicate"], r["cut"])))
        counted.add(r["turn"], *shape[-1])
    ways: list[int | str | None] = []
    for a, b in _PAIRS:
        possible = (a, b) != (START, SYSTEM) or any(initial == "s" and fault in " t" for initial, fault in shape)
        ways += cheapest(shape, a, (b,)) if possible else (None, None)
    own = [counted.low, counted.high, counted.distinct, counted.blank, counted.duplicate, counted.truncated, counted.illegal, counted.first, counted.last]
    row = (rows[0]["conv_id"], rows[0]["part"], rows[0]["segment"], *own, *ways)
    return pa.Table.from_batches([_records([row], _fields(_SEGMENTS))])


class Joined:
    """Segments of one conversation in order: the best way to each state, as the part all ways share and the rest."""

    def __init__(self) -> None:
        self.counted = Turns()
        self.shared: list[str] = []
        self.ways: dict[int, tuple[int, str]] = {START: (0, "")}

    def then(self, counted: Turns, ways: dict[tuple[int, int], tuple[int, str]]) -> None:
        self.counted.then(counted)
        best: dict[int, tuple[int, str]] = {}
        for (a, b), (price, audit) in ways.items():
            if a in self.ways:
                new = (self.ways[a][0] + price, self.ways[a][1] + audit)
                best[b] = min(best.get(b, new), new)
        common = os.path.commonprefix([audit for _, audit in best.values()])
        self.shared.append(common)
        self.ways = {state: (price, audit[len(common) :]) for state, (price, audit) in best.items()}

    def result(self) -> tuple[int, str]:
        price, audit = min(self.ways[end] for end in ENDS if end in self.ways)
        return price, "".join([*self.shared, audit])


def _join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by conversation and place -> a result for each, its checksum still open."""
    conv, joined = None, None

    def result() -> pa.RecordBatch:
        return _records([(conv, *joined.counted.values(), *joined.result(), None)], _fields(_RESULT))

    for batch in batches:
        for row in batch.to_pylist():
            if joined is None or conv != row["conv_id"]:
                if joined is not None:
                    yield result()
                conv, joined = row["conv_id"], Joined()
            counted = Turns(**{name: row[name] for name, _ in _fields(_COUNTED)})
            joined.then(counted, {(a, b): (row[f"cost{a}{b}"], row[f"audit{a}{b}"]) for a, b in _PAIRS if row[f"cost{a}{b}"] is not None})
    if joined is not None:
        yield result()


def _checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A result and then its conversation's rows in order -> the result with the checksum of what is left."""
    names = [n for n, _ in _fields(_RESULT)]
    result: dict | None = None
    letters, state, digest, empty = iter(()), START, hashlib.sha256(), True

    def write(piece: str) -> None:
        nonlocal empty
        digest.update((piece if empty else "\n" + piece).encode())
        empty = False

    def edits(rows: list[tuple[str, str]], last: bool) -> None:
        """Spend the edits up to the given row's own, or all that are left."""
        nonlocal state
        for letter in letters:
            for piece in apply_edits(letter, rows, state):
                write(piece)
                state = _NEXT[state, rows[0][0][:1]] if letter == "K" else following(state)
            if letter != "I" and not last:
                return

    def done() -> pa.RecordBatch:
        edits([], True)
        return _records([tuple({**result, "repaired_sha256": digest.hexdigest()}[n] for n in names)], _fields(_RESULT))

    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] is None:
                if result is not None:
                    yield done()
                result, letters, state, digest, empty = row, iter(row["audit"]), START, hashlib.sha256(), True
            elif row["place"] >= 0:
                edits([(row["role"], row["text"])], False)
    if result is not None:
        yield done()


def repair(damaged: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Faults, cheapest edits and checksum of the repaired text of every conversation.

    ``damaged`` holds ``conv_id, turn, role, text`` and ``copies``, how often a row stands there (0: not at all, but its
    conversation is told of). Rows go by turn, nulls first; ties by role and text. All rows without an id are
    one conversation. ``segment`` changes no result.
    """
    seen = r"[^\x20\x09-\x0D]"
    rows = damaged.select(
        "conv_id", "turn", "role", "text", "copies",
        (~F.col("text").rlike(seen)).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
    )
    read = durable(_sorted(rows).mapInArrow(_first_pass(segment), f"{_RESULT}, {_ROW}"))
    names = [n for n, _ in _fields(_RESULT)]
    finished = read.filter("part is null").select(*names)
    place = ["part", "segment", "place"]
    unfinished = read.filter("part is not null").select("conv_id", *place, "turn", "role", "text", F.col("is_blank").alias("blank"), "cut", "local")
    # a role and text is a duplicate in all segments but its first; of a segment only the first row of each has to ask
    says = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    unfinished = unfinished.withColumn("says", says).withColumn("at", F.struct("part", "segment"))
    first = unfinished.filter("local").groupBy("conv_id", "says").agg(F.min("at").alias("first"))
    first = first.withColumnsRenamed({"conv_id": "c", "says": "s"})
    same: Column = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("says") == F.col("s")) & F.col("local")
    marked = unfinished.join(first, same, "left").withColumn("duplicate", ~F.coalesce(F.col("local"), F.lit(False)) | (F.col("at") > F.col("first")))
    solved = marked.groupBy("conv_id", "part", "segment").applyInArrow(_solve, _SEGMENTS)
    together = lambda df: df.repartition("conv_id").sortWithinPartitions("conv_id", *[c for c in place if c in df.columns])
    joined = together(solved).mapInArrow(_join_segments, _RESULT)
    texts = joined.unionByName(unfinished.select("conv_id", *place, "role", "text"), allowMissingColumns=True)
    return finished.unionByName(together(texts).mapInArrow(_checksum, _RESULT))
