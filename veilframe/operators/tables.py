"""Anonymizing tables: every string cell or nested string, with one value -> token
assignment per row, per group of rows or for the whole table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import type_of
from ..functions.rules import Rules
from ..functions.spans import apply_replacements
from ..functions.sql import Sql, any_of, col, expr, keep, let, lit, struct, transform, transform_indexed, when
from ..functions.tokens import (
    GENERIC_TOKEN,
    check_mode,
    label_counts,
    replace_values,
    table_as_map,
    token_of,
    value_table,
)
from .anonymize import PADS, with_pads
from .detect import check_engine, with_external_leaves, with_leaf_spans
from .durable import durable, hold, sent_or_shuffled, stored_apart
from .numbering import join_on, number_within

LEAVES, FOUND, TABLE, OUT, HITS, EXTERNAL = "__leaves", "__found", "__values", "__out", "__hits", "__external"


@dataclass(frozen=True)
class Anonymized:
    """The rewritten data, the reversal map and the counts of one run.

    The map re-identifies everything: it is a table of its own, to be stored apart.
    """

    data: DataFrame
    mapping: DataFrame
    summary: DataFrame
    #: Where the three would each run the detectors: the rows that hold all of them, and how to take them apart.
    combined: DataFrame | None = None
    split: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]] | None = None


def _string_leaves(value: Sql, dtype: T.DataType) -> Sql | None:
    """Array expression of the strings inside a value, in schema order; None if it has none."""
    if isinstance(dtype, T.StringType):
        return f"array({value})"
    if isinstance(dtype, T.StructType):
        parts = [_string_leaves(f"{value}.{col(f.name)}", f.dataType) for f in dtype.fields]
        parts = [p for p in parts if p]
        # a null struct still has its (null) leaves, so positions do not depend on the data
        return f"concat({', '.join(parts)})" if parts else None
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        is_map = isinstance(dtype, T.MapType)
        inner = dtype.valueType if is_map else dtype.elementType
        if _string_leaves("x", inner) is None:
            return None
        items = f"map_values({value})" if is_map else value
        each = transform(items, lambda x: _string_leaves(x, inner))
        return f"coalesce(flatten({each}), cast(array() as array<string>))"
    return None


def _with_new_strings(value: Sql, dtype: T.DataType, new: Callable[[Sql], Sql]) -> Sql:
    """The value with ``new`` applied to each string; keys and other types are copied."""
    if _string_leaves("x", dtype) is None:
        return value
    if isinstance(dtype, T.StringType):
        return new(value)
    if isinstance(dtype, T.StructType):
        fields = ", ".join(
            f"{lit(f.name)}, {_with_new_strings(f'{value}.{col(f.name)}', f.dataType, new)}" for f in dtype.fields
        )
        return when(f"{value} is null", "null", f"named_struct({fields})")
    if isinstance(dtype, T.ArrayType):
        return transform(value, lambda x: _with_new_strings(x, dtype.elementType, new))
    entries = transform(
        f"map_entries({value})", lambda e: struct(key=f"{e}.key", value=_with_new_strings(f"{e}.value", dtype.valueType, new))
    )
    return f"map_from_entries({entries})"


def _chosen(df: DataFrame, columns: Sequence[str] | None, apart: Sequence[str]) -> list[T.StructField]:
    fields = [f for f in df.schema.fields if (f.name in columns if columns is not None else f.name not in apart)]
    return [f for f in fields if _string_leaves("x", f.dataType) is not None]


def _rebuild(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """Put the rewritten leaves back where they came from."""
    if all(isinstance(f.dataType, T.StringType) for f in fields):
        return df.withColumns({f.name: expr(f"get({OUT}, {i})") for i, f in enumerate(fields)})
    # one text always becomes the same text within a row, so nested values look theirs up
    changed = keep(f"arrays_zip({LEAVES}, {OUT})", lambda z: f"{z}.{LEAVES} <> {z}.{OUT}")
    pairs = df.withColumn("__changed", expr(f"array_distinct({changed})"))

    def new(keys: Sql) -> Callable[[Sql], Sql]:
        return lambda v: f"coalesce(get(__changed.{OUT}, int(array_position({keys}, {v}) - 1)), {v})"

    keyed = pairs.withColumn("__keys", expr(transform("__changed", lambda z: f"{z}.{LEAVES}")))
    rebuilt = {f.name: expr(_with_new_strings(col(f.name), f.dataType, new("__keys"))) for f in fields}
    return keyed.withColumns(rebuilt).drop("__changed", "__keys")


def anonymize_table(
    df: DataFrame,
    mode: str = "pseudo",
    *,
    columns: Sequence[str] | None = None,
    scope: str | Sequence[str] = "table",
    order_by: Sequence[str] = (),
    rules: Rules | Mapping | str | None = None,
    hash_key: bytes | str | None = None,
    generic: str = GENERIC_TOKEN,
    engine: str | None = "auto",
    external: DataFrame | None = None,
) -> Anonymized:
    """Rewrite the strings of a table, plain columns and nested values alike.

    Detection is per cell. ``scope`` says how far "same value, same token" and the numbering
    reach: ``"row"``, a list of columns (a file, a customer), or ``"table"``. Beyond the row,
    ``order_by`` orders the rows; "first" means first by it, then by column. It should be a unique key,
    but nothing depends on that except the numbering: rows whose key is null or repeated are told
    apart by their texts, and rows equal in both are rewritten alike.
    Scope and key columns are left alone unless named in ``columns``.

    ``external`` has another detector's findings by the columns of ``order_by`` and ``column``, the name of a
    string column, or ``leaf``, the number of the string in the row (from 0, in schema order; needed for nested
    values). Rows that share a key share its findings. ``engine`` chooses as in ``choose_spans``.
    """
    check_mode(mode)
    parsed = Rules.parse(rules)
    groups = [] if isinstance(scope, str) else list(scope)
    if isinstance(scope, str) and scope not in ("row", "table"):
        raise ValueError(f"unknown scope {scope!r}")
    fields = _chosen(df, columns, [*groups, *order_by])
    if not fields:
        raise ValueError("no string column to anonymize")
    leaves = f"concat({', '.join(_string_leaves(col(f.name), f.dataType) for f in fields)})"
    given = None
    if check_engine(engine, external) == "ml":
        given, df = EXTERNAL, _with_findings(df, external, fields, leaves, list(order_by))
    if scope == "row":
        if mode == "pseudo" and not order_by:
            raise ValueError("tokens per row need order_by, or the map cannot say which row a token is of")
        return _by_row(df, mode, fields, leaves, parsed, list(order_by), hash_key, generic, given)
    if not order_by:
        raise ValueError("a scope beyond the row needs order_by, a key of the table")
    if mode == "anon":  # one constant for all values: nothing to agree on beyond the row
        done = _by_row(df, mode, fields, leaves, parsed, groups, hash_key, generic, given)

        def split(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
            data, mapping, summary = done.split(rows)
            return data, mapping, summary.groupBy(*groups, "label").agg(F.sum("n").alias("n"))

        return Anonymized(*split(done.combined), done.combined, split)
    return _by_group(df, mode, fields, leaves, parsed, groups, list(order_by), hash_key, generic, given)


def _with_findings(df: DataFrame, external: DataFrame, fields: list[T.StructField], leaves: Sql, key: list[str]) -> DataFrame:
    if not key:
        raise ValueError("external findings need order_by, the key that says which row they are of")
    if "leaf" not in external.columns:
        if not all(isinstance(f.dataType, T.StringType) for f in fields):
            raise ValueError("findings in nested values need the column leaf, the number of the string in the row")
        place = " ".join(f"when {lit(f.name)} then {i}" for i, f in enumerate(fields))
        external = external.withColumn("leaf", expr(f"case column {place} end")).where("leaf is not null")
    return with_external_leaves(df, external, key, leaves, EXTERNAL)


def anonymize_nested(df: DataFrame, columns: Sequence[str], mode: str = "pseudo", **options) -> Anonymized:
    """``anonymize_table`` for struct, array and map columns: values change, keys do not."""
    return anonymize_table(df, mode, columns=columns, **options)


def pseudonymize_table(df: DataFrame, *, order_by: Sequence[str], **options) -> Anonymized:
    """Reversible pseudonyms that are consistent over the whole table."""
    return anonymize_table(df, "pseudo", order_by=order_by, **options)


def _by_row(df, mode, fields, leaves, rules, key, hash_key, generic, given) -> Anonymized:
    own = [c for c in df.columns if c != EXTERNAL]
    found = with_leaf_spans(df.withColumn(LEAVES, expr(leaves)), LEAVES, FOUND, rules=rules, skip_blank=True, found=given)
    options = {"generic": generic}
    if mode == "hash":
        found = with_pads(found, hash_key)
        options["pads"] = PADS
    tabled = hold(found, **{TABLE: value_table(f"flatten({FOUND})", mode, **options)})
    out = transform_indexed(LEAVES, lambda t, i: replace_values(t, f"get({FOUND}, {i})", TABLE))
    done = hold(tabled, **{OUT: out})
    # what data, map and summary are of, in one row; keys apart, as a key column may be rewritten
    names = [f"__key{i}" for i in range(len(key))]
    keyed = done.withColumns({n: F.col(col(k)) for n, k in zip(names, key, strict=True)})
    more = {"__map": expr(table_as_map(TABLE)) if mode == "pseudo" else expr("cast(map() as map<string,string>)")}
    more["__counts"] = expr(label_counts(f"flatten({FOUND})"))
    combined = _rebuild(keyed, fields).withColumns(more).select(*[expr(col(c)) for c in own], *names, *more)

    def split(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        place = [F.col(n).alias(k) for n, k in zip(names, key, strict=True)]
        mapping = rows.select(*place, F.explode("__map").alias("token", "original"))
        return rows.select(*[expr(col(c)) for c in own]), mapping, rows.select(*place, F.explode("__counts").alias("label", "n"))

    return Anonymized(*split(combined), combined, split)


ROW, ANY = "__row", "__any"


def row_mark(leaves: Sql) -> Sql:
    """128 bits of a row's texts. With the key it names what findings belong to: they depend on the
    texts alone, so a null or repeated key cannot hand them to another row or lose them."""
    return f"named_struct('a', xxhash64({leaves}), 'b', xxhash64('b', {leaves}))"


def _by_group(df, mode, fields, leaves, rules, groups, key, hash_key, generic, given) -> Anonymized:
    place = list(dict.fromkeys([*groups, *key]))
    # the one detection pass deals the rows: those without a finding are ready and meet nothing any more
    texts = df.withColumn(LEAVES, expr(leaves)).withColumn(ROW, expr(row_mark(LEAVES)))
    found = with_leaf_spans(texts, LEAVES, FOUND, rules=rules, skip_blank=True, found=given)
    found = found.withColumn(ANY, expr(any_of(FOUND, lambda s: f"size({s}) > 0"))).drop(LEAVES, EXTERNAL)
    touched, clean = stored_apart(found, ANY)
    spans = _span_rows(touched, [*place, ROW])
    if mode == "pseudo":
        tokens = value_tokens(spans, mode, groups, key)
        mapping = tokens.select(*groups, "token", F.col("text").alias("original"))
    else:  # text and type make the token, so only values that are found under several types need agreement
        mixed = F.min(expr(type_of("label"))) != F.max(expr(type_of("label")))
        agreed = spans.groupBy(*groups, "text").agg(mixed.alias("__mixed")).where("__mixed").drop("__mixed")
        asked = join_on(spans, sent_or_shuffled(durable(agreed), "octet_length(text)"), ["text"], scopes=groups)
        tokens = value_tokens(asked, mode, groups, key, hash_key=hash_key, generic=generic)
        mapping = spans.select(*groups, F.lit("").alias("token"), F.col("text").alias("original")).where("false")
        touched = with_pads(touched, hash_key) if mode == "hash" else touched
    hits = (
        join_on(spans, tokens.drop("label"), ["text"], scopes=groups)
        .groupBy(*place, ROW)
        .agg(F.sort_array(F.collect_set(F.struct("leaf", "start", "end", "token"))).alias(HITS))
    )
    if mode == "pseudo":
        joined = join_on(touched, hits, [ROW], "left", scopes=place)
        rewrite = lambda t, i: when(
            f"{HITS} is null",
            t,
            apply_replacements(t, keep(HITS, lambda h: f"{h}.leaf = {i}"), lambda h, _: f"{h}.token"),
        )
    else:
        few = sent_or_shuffled(durable(hits), f"aggregate({HITS}, 0L, (n, h) -> n + 32 + octet_length(h.token))")
        joined = join_on(touched, few, [ROW], "left", scopes=place)

        def token(s: Sql, i: Sql) -> Sql:
            agreed = f"get({keep(HITS, lambda h: f'{h}.leaf = {i} and {h}.start = {s}.start')}, 0).token"
            alone = let(f"{s}.text", lambda t: let(type_of(f"{s}.label"), lambda y: token_of(mode, t, y, generic=generic, pads=PADS)))
            return when(f"{HITS} is null", alone, f"coalesce({agreed}, {alone})")

        rewrite = lambda t, i: apply_replacements(t, f"get({FOUND}, {i})", lambda s, _: token(s, i))
    out = transform_indexed(LEAVES, lambda t, i: when(f"{t} is null", t, rewrite(t, i)))
    done = hold(joined.withColumn(LEAVES, expr(leaves)), **{OUT: out})
    names = [expr(col(c)) for c in df.columns if c != EXTERNAL]
    data = clean.select(*names).unionByName(_rebuild(done, fields).select(*names))
    return Anonymized(data, mapping, spans.groupBy(*groups, "label").agg(F.count("*").alias("n")))


def _span_rows(found: DataFrame, carried: list[str]) -> DataFrame:
    """One row per span with the ``carried`` columns, leaf, start, end, label, text."""
    rows = transform_indexed(
        FOUND,
        lambda spans, i: transform(
            spans,
            lambda s: struct(leaf=i, start=f"{s}.start", end=f"{s}.end", label=f"{s}.label", text=f"{s}.text"),
        ),
    )
    return found.select(*carried, F.inline(expr(f"flatten({rows})")))


def value_tokens(
    spans: DataFrame,
    mode: str,
    groups: Sequence[str],
    key: Sequence[str],
    *,
    hash_key: bytes | str | None = None,
    generic: str = GENERIC_TOKEN,
) -> DataFrame:
    """The tokens table: one row per scope and distinct value.

    The occurrences of a value are reduced before the shuffle, so a value found everywhere
    costs one row per task; numbering runs over distinct values and splits large scopes.
    """
    groups, position = list(groups), [*key, "leaf", "start"]
    first = F.min(F.struct(*position, "label")).alias("__first")
    values = spans.groupBy(*groups, "text").agg(first)
    # position columns get names of their own: a key may also be a scope column
    at = [f"__at{i}" for i in range(len(position))]
    typed = values.select(
        *groups,
        "text",
        F.col("__first.label").alias("label"),
        expr(type_of("__first.label")).alias("type"),
        *[F.col(f"__first.{c}").alias(a) for c, a in zip(position, at)],
    )
    options = {"generic": generic}
    if mode == "pseudo":
        typed = number_within(typed, [*groups, "type"], [*at, "text"])
        options["number"] = "n"
    elif mode == "hash":
        typed = with_pads(typed, hash_key)
        options["pads"] = PADS
    token = let("text", lambda t: let("type", lambda y: token_of(mode, t, y, **options)))
    return typed.withColumn("token", expr(token)).select(*groups, "text", "label", "type", "token")
