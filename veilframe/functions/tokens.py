"""Replacement tokens: the five modes, the value table of a row, and their reversal."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from .labels import NUMERIC_TYPES, type_of
from .offsets import NO_SPANS, cut, marked_pieces, marker_free, spans_of_pieces
from .spans import apply_replacements, first_label, span_texts
from .sql import Sql, keep, let, lit, struct, transform, transform_indexed, when
from .text import SPACE, only_digits, strip

# Modes, generic token, token shape, mask characters.
MODES = ("typed", "anon", "pseudo", "mask", "hash")
GENERIC_TOKEN = "<<ANOM_DATA>>"
TOKEN_PATTERN = "«[A-Z]+_[0-9A-Za-z]+»"
DOT = "•"
HASH_LENGTH = 16


def check_mode(mode: str, *, allow_off: bool = False) -> str:
    if mode in MODES or (allow_off and mode == "off"):
        return mode
    raise ValueError(f"unknown mode {mode!r}; use one of {', '.join(MODES)}")


def hmac_pads(key: bytes) -> tuple[bytes, bytes]:
    """The two padded keys of HMAC-SHA256 (inner, outer)."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    block = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_sha256(message: Sql, pads: Sql) -> Sql:
    """Hex HMAC of a string; ``pads`` is a struct with the binary fields ipad and opad."""
    inner = f"unhex(sha2(concat({pads}.ipad, cast({message} as binary)), 256))"
    return f"sha2(concat({pads}.opad, {inner}), 256)"


def hash_token(text: Sql, typ: Sql, pads: Sql) -> Sql:
    digest = hmac_sha256(f"lower({strip(text)})", pads)
    return f"concat('«', {typ}, '_', left({digest}, {HASH_LENGTH}), '»')"


def mask_value(text: Sql, typ: Sql) -> Sql:
    """Partial mask: mail domain, last characters of a number, initials of words."""

    def mail(s: Sql) -> Sql:
        first = when(f"startswith({s}, '@')", lit(DOT), f"left({s}, 1)")
        return f"concat({first}, '{DOT * 3}@', substring({s}, locate('@', {s}) + 1))"

    def number(s: Sql) -> Sql:
        shown = f"least(4, length({s}) - 1)"
        hidden = f"regexp_replace(left({s}, length({s}) - {shown}), '[0-9A-Za-z]', '{DOT}')"
        return f"concat({hidden}, right({s}, {shown}))"

    def words(s: Sql) -> Sql:
        each = transform(
            f"split({s}, {lit(f'[{SPACE}]+')}, -1)",
            lambda w: f"concat(left({w}, 1), repeat('{DOT}', greatest(1, length({w}) - 1)))",
        )
        return f"array_join({each}, ' ')"

    numeric = " or ".join(f"{typ} = {lit(t)}" for t in NUMERIC_TYPES)  # IN collects its list anew for each value
    return let(
        strip(text),
        lambda s: f"""case when {s} = '' then {text}
            when {typ} = 'EMAIL' and contains({s}, '@') then {mail(s)}
            when {typ} = 'URL' then '{DOT * 3}'
            when {numeric} or length({only_digits(s)}) >= 6 then {number(s)}
            else {words(s)} end""",
    )


def token_of(mode: str, text: Sql, typ: Sql, *, number: Sql = "null", generic: str = GENERIC_TOKEN, pads: Sql = "") -> Sql:
    """Token of one value. ``text`` and ``typ`` must be bound."""
    if mode == "typed":
        return f"concat('[', {typ}, ']')"
    if mode == "anon":
        return lit(generic)
    if mode == "mask":
        return mask_value(text, typ)
    if mode == "hash":
        return hash_token(text, typ, pads)
    return f"concat('«', {typ}, '_', {number}, '»')"


def value_table(spans: Sql, mode: str, **options) -> Sql:
    """One entry per distinct text of the row, with the token it gets everywhere.

    The first label a text appears under decides its type; ``pseudo`` numbers the values of
    each type by first appearance.
    """

    def entries(s: Sql, texts: Sql) -> Sql:
        labelled = transform(
            f"array_distinct({texts})",
            lambda t: let(
                first_label(s, texts, t), lambda lab: struct(text=t, label=lab, type=type_of(lab))
            ),
        )
        return let(labelled, numbered if mode == "pseudo" else tokened)

    def entry(v: Sql, number: Sql) -> Sql:
        token = token_of(mode, f"{v}.text", f"{v}.type", number=number, **options)
        return struct(text=f"{v}.text", label=f"{v}.label", type=f"{v}.type", token=token)

    def tokened(values: Sql) -> Sql:
        return transform(values, lambda v: entry(v, "null"))

    def numbered(values: Sql) -> Sql:
        types = f"array_distinct({transform(values, lambda v: f'{v}.type')})"
        per_type = transform(
            types,
            lambda t: transform_indexed(keep(values, lambda v: f"{v}.type = {t}"), lambda v, i: entry(v, f"{i} + 1")),
        )
        return f"flatten({per_type})"

    return let(spans, lambda s: let(span_texts(s), lambda texts: entries(s, texts)))


def replace_values(text: Sql, spans: Sql, table: Sql) -> Sql:
    """Rewrite ``text``: every span becomes the token its text has in the value table."""

    def with_keys(keys: Sql) -> Sql:
        return apply_replacements(
            text, spans, lambda s, i: f"get({table}, int(array_position({keys}, {s}.text) - 1)).token"
        )

    return let(transform(table, lambda e: f"{e}.text"), with_keys)


def replacement_parts(text: Sql, spans: Sql, modes: Sequence[str], **options) -> Sql:
    """The text before each span and the span's token in each mode: an array of structs with ``gap`` and the modes.

    The tokens are those of ``value_table``. What modes share, the distinct values, their types, numbers and the
    gaps, is found once; ``joined_parts`` makes the text of a mode.
    """

    def parts(s: Sql, texts: Sql, distinct: Sql) -> Sql:
        alone = f"size({distinct}) = size({texts})"  # no text twice: the values are the spans, in order

        def value(t: Sql, i: Sql) -> Sql:
            label = when(alone, f"get({s}, {i}).label", first_label(s, texts, t))
            return let(label, lambda lab: struct(text=t, type=type_of(lab), i=i))

        def entry(v: Sql, number: Sql) -> Sql:
            return struct(**{m: token_of(m, f"{v}.text", f"{v}.type", number=number, **options) for m in modes})

        def part(table: Sql, x: Sql, i: Sql) -> Sql:
            at = when(alone, i, f"int(array_position({distinct}, {x}.text) - 1)")
            gap = cut(text, f"coalesce(get({s}, {i} - 1).end, 0)", f"{x}.start")
            return let(f"get({table}, {at})", lambda e: struct(gap=gap, **{m: f"{e}.{m}" for m in modes}))

        def tokened(values: Sql) -> Sql:
            if "pseudo" not in modes:
                return transform(values, lambda v: entry(v, "null"))
            return let(_numbers(values), lambda n: transform(values, lambda v: entry(v, f"coalesce(get({n}, {v}.i).n, {v}.i + 1)")))

        return let(
            let(transform_indexed(distinct, value), tokened),
            lambda table: transform_indexed(s, lambda x, i: part(table, x, i)),
        )

    none = ", ".join(f"{m}:string" for m in ("gap", *modes))

    def some(s: Sql) -> Sql:
        body = let(span_texts(s), lambda texts: let(f"array_distinct({texts})", lambda d: parts(s, texts, d)))
        return when(f"size({s}) = 0", f"cast(array() as array<struct<{none}>>)", body)

    return let(spans, some)


def _numbers(values: Sql) -> Sql:
    """The number of each value among those of its type, in order of the values; null where all have one type."""

    def counted(types: Sql) -> Sql:
        per_type = transform(
            types,
            lambda t: transform_indexed(keep(values, lambda v: f"{v}.type = {t}"), lambda v, k: struct(i=f"{v}.i", n=f"{k} + 1")),
        )
        return when(f"size({types}) = 1", "null", f"sort_array(flatten({per_type}))")

    return let(f"array_distinct({transform(values, lambda v: f'{v}.type')})", counted)


def joined_parts(text: Sql, spans: Sql, parts: Sql, mode: str) -> Sql:
    """``text`` in one mode of its ``replacement_parts``."""
    tail = cut(text, f"element_at({spans}, -1).end", f"length({text})")
    joined = f"concat(array_join({transform(parts, lambda p: f'concat({p}.gap, {p}.{mode})')}, ''), {tail})"
    return when(f"size({parts}) = 0", text, joined)


def table_as_map(table: Sql) -> Sql:
    """token -> original of a pseudonym table."""
    return f"map_from_entries({transform(table, lambda e: struct(token=f'{e}.token', original=f'{e}.text'))})"


def label_counts(spans: Sql) -> Sql:
    """label -> occurrences, labels by first appearance."""
    labels = transform(spans, lambda s: f"{s}.label")
    return let(
        labels,
        lambda labs: "map_from_entries("
        + transform(
            f"array_distinct({labs})",
            lambda x: struct(label=x, n=f"size({keep(labs, lambda y: f'{y} = {x}')})"),
        )
        + ")",
    )


def token_spans(text: Sql) -> Sql:
    """Spans of everything that looks like a token; ``text`` must be bound."""
    found = let(
        marked_pieces(marker_free(text), TOKEN_PATTERN), lambda p: spans_of_pieces(p, "'TOKEN'")
    )
    return when(f"contains({text}, '«')", found, NO_SPANS)


def restore(text: Sql, mapping: Sql) -> Sql:
    """Put originals back in one pass; unknown tokens stay."""
    return apply_replacements(
        text, token_spans(text), lambda s, i: f"coalesce(try_element_at({mapping}, {s}.text), {s}.text)"
    )

