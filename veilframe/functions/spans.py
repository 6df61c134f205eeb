"""Span algebra on one row: propagate, resolve, finalize, replace.

A row carries its spans as an array, so none of this shuffles. The work per row is
n log n in the number of spans apart from the literal searches of ``propagate_spans``.
Arguments named ``text`` and ``spans`` must be bound (a column or a lambda variable).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from .offsets import NO_SPANS, cut, literal_pieces, marker_free, span, spans_of_pieces, with_original_text
from .sql import (
    Sql,
    any_of,
    array,
    fold,
    keep,
    keep_indexed,
    let,
    lit,
    literal_map,
    running_max,
    struct,
    transform,
    transform_indexed,
    when,
)
from .text import strip

MIN_PROPAGATED = 4
FEW = 8  # spans up to which all are resolved as one island
MANY = 64  # spans from which on repeats are looked for in all of a text at once
_GRAMS = (32, 16, 8, 4)
_STRETCH = 1024


def span_texts(spans: Sql) -> Sql:
    return transform(spans, lambda s: f"{s}.text")


def first_label(spans: Sql, texts: Sql, text: Sql) -> Sql:
    """Label of the first span in the list whose text is ``text``."""
    return f"get({spans}, int(array_position({texts}, {text}) - 1)).label"


def _possible_repeats(text: Sql, spans: Sql) -> Sql:
    """The spans but for those that cannot occur twice in ``text``, found without a search per span.

    A span that occurs again repeats its first and its last characters too: as many as the longest of a few
    lengths that fits. The digests of all runs of that length are sorted once, and what stands next to its equal
    is repeated. Text is read in stretches, because a substring is counted from the start of its string. Spans
    whose text is not their slice stay.
    """
    stretches = f"regexp_extract_all({text}, r'(?s)(?=(.{{1,{_STRETCH + _GRAMS[0] - 1}}})).{{1,{_STRETCH}}}', 1)"

    def fits(s: Sql, k: int) -> Sql:
        longer = [g for g in _GRAMS if g > k]
        return f"length({s}.text) >= {k}" + (f" and length({s}.text) < {longer[-1]}" if longer else "")

    def repeated(chunks: Sql, k: int) -> Sql:
        runs = transform(
            chunks,
            lambda c: when(
                f"length({c}) < {k}",
                "cast(array() as array<bigint>)",
                transform(f"sequence(1, least({_STRETCH}, length({c}) - {k - 1}))", lambda i: f"xxhash64(substring({c}, {i}, {k}))"),
            ),
        )
        twice = let(
            f"sort_array(flatten({runs}))",
            lambda h: transform_indexed(h, lambda x, i: when(f"{i} > 0 and {x} = get({h}, {i} - 1)", x, "null")),
        )
        return keep(f"array_distinct({twice})", lambda x: f"{x} is not null")

    def ends(s: Sql, k: int) -> tuple[Sql, Sql]:
        return f"xxhash64(left({s}.text, {k}))", f"xxhash64(right({s}.text, {k}))"

    def hits(chunks: Sql, k: int) -> Sql:
        def look(some: Sql) -> Sql:
            asked = [transform(some, lambda s, i=i: ends(s, k)[i]) for i in (0, 1)]
            found = f"array_intersect(concat({', '.join(asked)}), {repeated(chunks, k)})"
            return when(f"size({some}) = 0", "cast(array() as array<bigint>)", found)

        return let(keep(spans, lambda s: fits(s, k)), look)

    def stays(chunks: Sql, all_hits: Sql, s: Sql) -> Sql:
        near = f"substring(get({chunks}, int({s}.start div {_STRETCH})), {s}.start % {_STRETCH} + 1, {s}.end - {s}.start)"
        own = when(f"{s}.end - {s}.start <= {_GRAMS[0]}", near, cut(text, f"{s}.start", f"{s}.end"))
        both = lambda i, k: " and ".join(f"array_contains(get({all_hits}, {i}), {h})" for h in ends(s, k))
        cases = " ".join(f"when length({s}.text) >= {k} then {both(i, k)}" for i, k in enumerate(_GRAMS))
        return f"coalesce({s}.text <> {own}, true) or case {cases} else false end"

    def kept(chunks: Sql) -> Sql:
        return let(array(hits(chunks, k) for k in _GRAMS), lambda h: keep(spans, lambda s: stays(chunks, h, s)))

    return let(stretches, kept)


def propagate_spans(text: Sql, spans: Sql) -> Sql:
    """Add a span at every occurrence of every text already marked.

    A text that occurs once has nothing to add: the copy would equal the span it came from. That
    holds only for a span whose text is its slice; others are always looked for.
    """

    def occurrences(texts: Sql, value: Sql) -> Sql:
        return let(
            first_label(spans, texts, value),
            lambda label: let(
                literal_pieces(marker_free(text), marker_free(value)), lambda p: spans_of_pieces(p, label)
            ),
        )

    def elsewhere(s: Sql) -> Sql:
        # an occurrence that starts earlier ends earlier too; this is much faster than locate
        before = f"contains(left({text}, {s}.end - 1), {s}.text)"
        foreign = f"{s}.text <> {cut(text, f'{s}.start', f'{s}.end')}"
        return f"({foreign} or {before} or contains(substring({text}, {s}.start + 2), {s}.text))"

    def more(worth: Sql) -> Sql:
        repeated = f"array_distinct({span_texts(worth)})"
        return let(span_texts(spans), lambda texts: f"flatten({transform(repeated, lambda t: occurrences(texts, t))})")

    possible = when(f"size({spans}) <= {MANY}", spans, _possible_repeats(text, spans))
    # most texts fail on a cheap test, and rows without a repeated one are done
    long = lambda s: f"length({s}.text) >= {MIN_PROPAGATED} and {elsewhere(s)} and length({strip(f'{s}.text')}) >= {MIN_PROPAGATED}"
    return let(
        keep(possible, long),
        lambda worth: when(f"size({worth}) = 0", spans, f"concat({spans}, {with_original_text(more(worth), text)})"),
    )


def _ranked(spans: Sql, priority: Mapping[str, int]) -> Sql:
    """Spans with the numbers that decide overlaps; empty ones dropped."""

    def weight(label: Sql) -> Sql:
        if not priority:
            return "0"
        return f"coalesce(try_element_at({literal_map(priority.items())}, {label}), 0)"

    ranked = transform_indexed(
        spans,
        lambda s, i: struct(
            start=f"{s}.start",
            neg_len=f"{s}.start - {s}.end",
            neg_prio=f"-{weight(f'{s}.label')}",
            ord=i,
            end=f"{s}.end",
            label=f"{s}.label",
            text=f"{s}.text",
        ),
    )
    return keep(ranked, lambda r: f"{r}.neg_len < 0")


def _by_start(ranked: Sql) -> Sql:
    return transform(ranked, lambda r: struct(**{c: f"{r}.{c}" for c in ("start", "end", "label", "text")}))


def _greedy(island: Sql) -> Sql:
    """Accept by longest, then priority, then start, then order; reject what overlaps."""
    columns = ("neg_len", "neg_prio", "start", "ord", "end", "label", "text")
    order = f"sort_array({transform(island, lambda r: struct(**{c: f'{r}.{c}' for c in columns}))})"

    def step(acc: Sql, r: Sql) -> Sql:
        overlaps = any_of(acc, lambda a: f"{r}.start < {a}.end and {r}.end > {a}.start")
        return when(overlaps, acc, f"concat({acc}, array({r}))")

    return f"sort_array({_by_start(let(order, lambda o: fold(o, f'slice({o}, 1, 0)', step)))})"


def _islands(s: Sql, reach: Sql) -> Sql:
    """Cut spans sorted by start into runs; ``reach`` is the running maximum of their ends."""
    head = transform_indexed(
        s, lambda r, i: f"case when {i} = 0 or {r}.start >= get({reach}, {i} - 1) then {i} end"
    )
    return let(
        keep(head, lambda i: f"{i} is not null"),
        lambda h: transform_indexed(
            h, lambda i, j: f"slice({s}, {i} + 1, coalesce(get({h}, {j} + 1), size({s})) - {i})"
        ),
    )


def resolve_overlaps(spans: Sql, priority: Mapping[str, int]) -> Sql:
    """Disjoint spans in text order.

    Sorted spans fall into islands, runs that overlap each other but nothing outside, and
    the greedy choice is made inside each island. A few spans are one island: what does not overlap does not
    change the choice. Spans that are in order and apart stay as they are.
    """

    def choose(s: Sql) -> Sql:
        parts = let(let(transform(s, lambda r: f"{r}.end"), running_max), lambda reach: _islands(s, reach))
        return f"flatten({transform(parts, lambda p: when(f'size({p}) = 1', _by_start(p), _greedy(p)))})"

    def as_spans(s: Sql) -> Sql:
        return transform(s, lambda r: span(f"{r}.label", f"{r}.start", f"{r}.end", f"{r}.text"))

    overlapping = let(
        _ranked(spans, priority),
        lambda r: when(f"size({r}) <= {FEW}", _greedy(r), let(f"sort_array({r})", choose)),
    )
    apart = keep_indexed(
        spans, lambda s, i: f"{s}.end > {s}.start and ({i} = 0 or {s}.start >= get({spans}, {i} - 1).end)"
    )
    return let(apart, lambda a: when(f"size({spans}) <= 1 or size({a}) = size({spans})", as_spans(a), as_spans(overlapping)))


def merge_overlaps(spans: Sql) -> Sql:
    """The areas covered by any span, as disjoint (start, end) in order."""

    def areas(s: Sql) -> Sql:
        parts = let(let(transform(s, lambda r: f"{r}.end"), running_max), lambda reach: _islands(s, reach))
        return transform(
            parts,
            lambda p: struct(start=f"get({p}, 0).start", end=f"array_max({transform(p, lambda r: f'{r}.end')})"),
        )

    plain = transform(spans, lambda s: struct(start=f"{s}.start", end=f"{s}.end"))
    return let(f"sort_array({plain})", areas)


def finalize_spans(text: Sql, spans: Sql, priority: Mapping[str, int]) -> Sql:
    """Propagate, then resolve: spans that will lose still propagate."""
    closed = let(propagate_spans(text, spans), lambda s: resolve_overlaps(s, priority))
    return when(f"size({spans}) = 0", NO_SPANS, closed)


def apply_replacements(
    text: Sql,
    spans: Sql,
    token: Callable[[Sql, Sql], Sql],
    untouched: Callable[[Sql], Sql] = lambda gap: gap,
) -> Sql:
    """Rewrite ``text`` with ``token(span, index)`` in place of each of the disjoint spans.

    The gaps are cut from the original text, so the order of replacement does not matter;
    ``untouched`` is applied to each gap.
    """

    def build(s: Sql) -> Sql:
        def part(x: Sql, i: Sql) -> Sql:
            gap = cut(text, f"coalesce(get({s}, {i} - 1).end, 0)", f"{x}.start")
            return f"concat({untouched(gap)}, {token(x, i)})"

        tail = cut(text, f"get({s}, size({s}) - 1).end", f"length({text})")
        return f"concat(array_join({transform_indexed(s, part)}, ''), {untouched(tail)})"

    return let(spans, lambda s: when(f"size({s}) = 0", untouched(text), build(s)))
