"""Rewriting documents: the five modes, placeholders, reversal."""

from __future__ import annotations

import logging
import os
import secrets
from collections.abc import Mapping, Sequence
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import placeholder_of
from ..functions.offsets import NO_SPANS
from ..functions.rules import Rules
from ..functions.spans import apply_replacements
from ..functions.sql import col, expr, let, struct, transform, when
from ..functions.text import normalize_text
from ..functions.tokens import (
    GENERIC_TOKEN,
    check_mode,
    hmac_pads,
    joined_parts,
    label_counts,
    replace_values,
    replacement_parts,
    restore,
    table_as_map,
    token_spans,
    value_table,
)
from .detect import choose_spans
from .durable import hold
from .numbering import join_on

PADS, TABLE, PARTS = "__pads", "__table", "__parts"
HASH_KEY_VARIABLE = "ANON_HASH_KEY"


@cache
def _session_key() -> bytes:
    given = os.environ.get(HASH_KEY_VARIABLE)
    if given:
        return given.encode("utf-8")
    logging.getLogger(__name__).warning(
        "%s is not set: hash tokens use a random key and will differ in the next session", HASH_KEY_VARIABLE
    )
    return secrets.token_bytes(32)


def with_pads(df: DataFrame, key: bytes | str | None) -> DataFrame:
    """Add the padded HMAC keys as a column.

    They come from a one-row table by scalar subquery, so that the key is not a literal of
    the plan and does not show in ``explain`` or the UI.
    """
    secret = _session_key() if key is None else key.encode("utf-8") if isinstance(key, str) else key
    ipad, opad = hmac_pads(secret)
    row = df.sparkSession.createDataFrame([((bytearray(ipad), bytearray(opad)),)], "p struct<ipad:binary,opad:binary>")
    return df.withColumn(PADS, row.select("p").scalar())


def anonymize_docs(
    docs: DataFrame,
    mode: str = "pseudo",
    *,
    text: str = "text",
    key: Sequence[str] = ("doc_id",),
    rules: Rules | Mapping | str | None = None,
    engine: str | None = "auto",
    external: DataFrame | None = None,
    normalize: bool = True,
    hash_key: bytes | str | None = None,
    generic: str = GENERIC_TOKEN,
    always: DataFrame | None = None,
) -> DataFrame:
    """Documents with scanned, spans, engine, mode, output, map, reversible, summary, incomplete.

    ``incomplete`` lists the custom patterns that took too long on the text; their findings are missing.

    The scope is the document: a value has one token within it. ``scanned`` is the text the
    span offsets refer to (normalized by default). No shuffle unless external spans
    or ``always``, a table of always-hide terms, join in.
    """
    check_mode(mode, allow_off=True)
    scanned = docs.withColumn("scanned", expr(normalize_text(col(text)) if normalize else col(text)))
    if mode == "off":
        return scanned.withColumns(
            {
                "spans": expr(NO_SPANS),
                "incomplete": expr("cast(array() as array<string>)"),
                "engine": F.lit("lite"),
                "mode": F.lit(mode),
                "output": F.col(text),
                "map": expr("cast(map() as map<string,string>)"),
                "reversible": F.lit(False),
                "summary": expr("cast(map() as map<string,int>)"),
            }
        )
    found = choose_spans(scanned, engine=engine, external=external, key=key, text="scanned", rules=rules, incomplete="incomplete", always=always)
    options = {"generic": generic}
    if mode == "hash":
        found = with_pads(found, hash_key)
        options["pads"] = col(PADS)
    tabled = hold(found, **{TABLE: value_table("spans", mode, **options)})
    mapping = table_as_map(col(TABLE)) if mode == "pseudo" else "cast(map() as map<string,string>)"
    return tabled.withColumns(
        {
            "mode": F.lit(mode),
            "output": expr(replace_values("scanned", "spans", col(TABLE))),
            "map": expr(mapping),
            "reversible": F.lit(mode == "pseudo"),
            "summary": expr(label_counts("spans")),
        }
    ).drop(TABLE, PADS)


def rewrite_found(
    found: DataFrame,
    modes: Sequence[str],
    *,
    text: str = "scanned",
    spans: str = "spans",
    hash_key: bytes | str | None = None,
    generic: str = GENERIC_TOKEN,
) -> DataFrame:
    """Documents whose spans are known, in several modes at once: a column ``output_<mode>`` for each.

    Neither detection nor what the modes share (values, types, numbers, the text between spans) is repeated.
    """
    for mode in modes:
        check_mode(mode)
    options = {"generic": generic}
    if "hash" in modes:
        found = with_pads(found, hash_key)
        options["pads"] = col(PADS)
    parted = hold(found, **{PARTS: replacement_parts(col(text), col(spans), list(dict.fromkeys(modes)), **options)})
    outputs = {f"output_{mode}": expr(joined_parts(col(text), col(spans), PARTS, mode)) for mode in modes}
    return parted.withColumns(outputs).drop(PARTS, PADS)


def redact_placeholder(docs: DataFrame, *, text: str = "text", **choice) -> DataFrame:
    """Every span replaced by the placeholder of its label; the text is not normalized."""
    found = choose_spans(docs, text=text, **choice)
    marked = transform(
        "spans",
        lambda s: struct(
            label=f"{s}.label",
            start=f"{s}.start",
            end=f"{s}.end",
            text=f"{s}.text",
            placeholder=placeholder_of(f"{s}.label"),
        ),
    )
    output = apply_replacements(col(text), "spans", lambda s, i: placeholder_of(f"{s}.label"))
    return found.withColumns(
        {"output": expr(output), "detected_spans": expr(marked), "summary": expr(label_counts("spans"))}
    ).drop("spans")


def deanonymize_rows(df: DataFrame, *, text: str = "output", mapping: str = "map", into: str = "restored") -> DataFrame:
    """Put originals back from a map column of the same row."""
    restored = let(
        col(text),
        lambda t: when(f"coalesce(size({col(mapping)}), 0) = 0", t, restore(t, col(mapping))),
    )
    return df.withColumn(into, expr(restored))


def deanonymize(
    df: DataFrame,
    mapping: DataFrame,
    *,
    key: Sequence[str],
    scope: Sequence[str] = (),
    text: str | Sequence[str] = "output",
    into: str = "restored",
) -> DataFrame:
    """Put originals back from a map table (scope, token, original).

    One text column is restored into a new one, a list of columns in place. Only rows that hold a
    token mark are moved: each asks once per distinct token, the pairs meet the map, and the answers
    come back as one small map per row. Rows whose key is null or repeated are told apart by their
    texts. ``mapping`` should be a stored table: whether it is empty is looked at right away.
    """
    if mapping.isEmpty():
        raise ValueError("the reversal map is empty")
    scopes = list(scope)
    columns = {text: into} if isinstance(text, str) else {c: c for c in text}
    mark = "__row"
    carried = list(dict.fromkeys([*key, *scopes]))
    texts = f"array({', '.join(map(col, columns))})"
    holds = " or ".join(f"contains({col(c)}, '«')" for c in columns)
    marked = df.withColumn(mark, expr(f"named_struct('a', xxhash64({texts}), 'b', xxhash64('b', {texts}))"))
    some, others = marked.where(f"coalesce({holds}, false)"), marked.where(f"not coalesce({holds}, false)")
    each = [let(col(c), lambda t: transform(token_spans(t), lambda s: f"{s}.text")) for c in columns]
    present = ", ".join(f"coalesce({tokens}, cast(array() as array<string>))" for tokens in each)
    asked = some.select(*carried, mark, F.explode(expr(f"array_distinct(concat({present}))")).alias("token")).distinct()
    answers = (
        join_on(asked, mapping.select(*scopes, "token", "original"), ["token"], scopes=scopes)
        .groupBy(*carried, mark)
        .agg(F.map_from_entries(F.collect_list(F.struct("token", "original"))).alias("__map"))
    )
    found = join_on(some, answers, [mark], "left", scopes=carried)
    joined = found.unionByName(others.withColumn("__map", F.lit(None).cast("map<string,string>"))).drop(mark)
    for source, target in columns.items():
        joined = deanonymize_rows(joined, text=source, mapping="__map", into=target)
    return joined.drop("__map")
