"""Match positions with built-in functions only.

Spark can list the matches of a regex but not where they are. One ``regexp_replace`` puts
a marker on both sides of every match, one ``split`` on the marker then yields gap, match,
gap, ..., and the running sum of the piece lengths gives the offsets.
"""

from __future__ import annotations

from .sql import Sql, let, lit, running_sum, struct, transform, when

MARK = "\u0001"
_STAND_IN = "\u0002"  # neither is a letter, digit, space or separator to any pattern

_FEW = 17  # pieces up to which each offset is counted from the start of the text

SPAN_SCHEMA = "label string, start int, end int, text string"
NO_SPANS = "cast(array() as array<struct<label:string,start:int,end:int,text:string>>)"


def span(label: Sql, start: Sql, end: Sql, text: Sql) -> Sql:
    return struct(label=label, start=start, end=end, text=text)


def cut(text: Sql, start: Sql, end: Sql) -> Sql:
    return f"substring({text}, {start} + 1, {end} - ({start}))"


def marked_pieces(text: Sql, pattern: str, marked: str = f"{MARK}$0{MARK}") -> Sql:
    """Gap, match, gap, ... of a regex. ``text`` must not hold the marker."""
    return f"split(regexp_replace({text}, {lit(pattern)}, {lit(marked)}), '{MARK}', -1)"


def literal_pieces(text: Sql, needle: Sql) -> Sql:
    """The same for the non-overlapping occurrences of a literal, left to right."""
    return f"split(replace({text}, {needle}, concat('{MARK}', {needle}, '{MARK}')), '{MARK}', -1)"


def spans_of_pieces(pieces: Sql, label: Sql) -> Sql:
    """Spans of the matches; ``pieces`` and ``label`` must be bound."""
    one = let(
        f"length(get({pieces}, 0))",
        lambda start: f"array({span(label, start, f'{start} + length(get({pieces}, 1))', f'get({pieces}, 1)')})",
    )
    few = transform(
        f"sequence(1, size({pieces}) div 2)",
        lambda j: let(
            f"length(array_join(slice({pieces}, 1, int(2 * {j} - 1)), ''))",
            lambda start: let(
                f"get({pieces}, int(2 * {j} - 1))", lambda t: span(label, start, f"{start} + length({t})", t)
            ),
        ),
    )
    several = let(
        let(transform(pieces, lambda p: f"length({p})"), running_sum),
        lambda ends: transform(
            f"sequence(1, size({pieces}) div 2)",
            lambda j: let(
                f"int(2 * {j} - 1)",
                lambda at: span(label, f"get({ends}, {at} - 1)", f"get({ends}, {at})", f"get({pieces}, {at})"),
            ),
        ),
    )
    return f"case size({pieces}) when 1 then {NO_SPANS} when 3 then {one} else {when(f'size({pieces}) <= {_FEW}', few, several)} end"


def marker_free(text: Sql) -> Sql:
    """``text``, with the stand-in where it holds the marker. Offsets do not change."""
    return when(f"contains({text}, '{MARK}')", f"translate({text}, '{MARK}', '{_STAND_IN}')", text)


def with_original_text(spans: Sql, text: Sql) -> Sql:
    """Cut the span texts from ``text`` again where it holds the marker."""
    return let(
        spans,
        lambda found: when(
            f"contains({text}, '{MARK}')",
            transform(found, lambda s: span(f"{s}.label", f"{s}.start", f"{s}.end", cut(text, f"{s}.start", f"{s}.end"))),
            found,
        ),
    )
