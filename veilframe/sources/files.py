"""Anonymizing whole files: the format is kept, one value has one token per file."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.python_side import file_from_leaves, file_leaves
from ..functions.rules import Rules
from ..functions.sql import expr, transform_indexed
from ..functions.tokens import (
    GENERIC_TOKEN,
    check_mode,
    label_counts,
    replace_values,
    table_as_map,
    value_table,
)
from ..operators.anonymize import PADS, with_pads
from ..operators.detect import check_engine, with_external_leaves, with_leaf_spans
from ..operators.durable import hold
from .formats import TEXT_FORMATS, admit, detect_format

LEAVES, FOUND, TABLE, OUT, TEXT = "__leaves", "__found", "__values", "__out", "__text"


@dataclass(frozen=True)
class Files:
    """Rewritten files (path, format, engine, mode, content, map, reversible, summary) and
    the files not taken (path, reason)."""

    accepted: DataFrame
    rejected: DataFrame


def anonymize_files(
    files: DataFrame,
    mode: str = "pseudo",
    *,
    rules: Rules | Mapping | str | None = None,
    max_chars: int | None = None,
    hash_key: bytes | str | None = None,
    generic: str = GENERIC_TOKEN,
    engine: str | None = "auto",
    external: DataFrame | None = None,
) -> Files:
    """Rewrite files given as (path, content BINARY).

    ``external`` has another detector's findings by ``path`` and ``leaf`` (the number of the text in the
    file, from 0), see ``with_external_leaves``; ``engine`` chooses as in ``choose_spans``.

    Text formats are one text; CSV cells (the header too) and JSON string values are texts of
    their own. A file is one row, so there is no shuffle. CSV and JSON are taken
    apart and put together in Python, text files do not leave the JVM.
    """
    check_mode(mode)
    parsed = Rules.parse(rules)
    used = check_engine(engine, external)
    checked = (
        admit(files.select("path", "content"), "content", max_chars=max_chars)
        .withColumn("format", expr(detect_format("substring_index(path, '/', -1)")))
        .withColumn(TEXT, expr("if(reason is null, cast(content as string), null)"))
        .drop("content")
    )
    plain = F.col("format").isin(*TEXT_FORMATS)
    texts = checked.where(plain).withColumn(LEAVES, expr(f"if({TEXT} is null, null, array({TEXT}))"))
    trees = checked.where(~plain).withColumn(LEAVES, file_leaves("format", TEXT))
    trees = trees.withColumn("reason", expr(f"coalesce(reason, if({TEXT} is not null and {LEAVES} is null, format, null))"))

    def rewrite(part: DataFrame) -> DataFrame:
        return _rewritten(part.where("reason is null"), mode, parsed, hash_key, generic, external if used == "ml" else None)

    whole = rewrite(texts).withColumn("content", expr(f"{OUT}[0]"))
    rebuilt = rewrite(trees).withColumn("content", file_from_leaves("format", TEXT, OUT))
    columns = ["path", "format", "engine", "mode", "content", "map", "reversible", "summary"]
    accepted = whole.select(*columns).unionByName(rebuilt.select(*columns))
    refused = texts.select("path", "reason").unionByName(trees.select("path", "reason")).where("reason is not null")
    return Files(accepted, refused)


def _rewritten(
    df: DataFrame, mode: str, rules: Rules, hash_key: bytes | str | None, generic: str, external: DataFrame | None
) -> DataFrame:
    given = None
    if external is not None:
        given = "__external"
        df = with_external_leaves(df, external, ["path"], LEAVES, given)
    found = with_leaf_spans(df, LEAVES, FOUND, rules=rules, skip_blank=True, found=given)
    options = {"generic": generic}
    if mode == "hash":
        found = with_pads(found, hash_key)
        options["pads"] = PADS
    tabled = hold(found, **{TABLE: value_table(f"flatten({FOUND})", mode, **options)})
    out = transform_indexed(LEAVES, lambda t, i: replace_values(t, f"get({FOUND}, {i})", TABLE))
    mapping = table_as_map(TABLE) if mode == "pseudo" else "cast(map() as map<string,string>)"
    return hold(tabled, **{OUT: out}).withColumns(
        {
            "engine": F.lit("lite" if external is None else "ml"),
            "mode": F.lit(mode),
            "map": expr(mapping),
            "reversible": F.lit(mode == "pseudo"),
            "summary": expr(label_counts(f"flatten({FOUND})")),
        }
    )

