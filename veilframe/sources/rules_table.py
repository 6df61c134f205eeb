"""Rules kept in tables or typed by users."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.python_side import fold_values
from ..functions.rules import Rules
from ..functions.sql import col, expr, keep, transform, when
from ..functions.text import is_ascii, strip


def load_rules(df: DataFrame, *, always: str = "always", never: str = "never", patterns: str = "patterns") -> DataFrame:
    """Parse rule entries as typed: comma lists, and patterns as a JSON list or object.

    Blank entries are dropped; patterns that are not valid JSON, and items without a string
    ``regex``, count as none.
    """

    def listed(column: str) -> str:
        parts = transform(f"split(coalesce({col(column)}, ''), ',', -1)", strip)
        return keep(parts, lambda p: f"{p} <> ''")

    parsed = f"try_parse_json({col(patterns)})"
    items = (
        f"coalesce(try_variant_get({parsed}, '$.patterns', 'array<variant>'), "
        f"try_variant_get({parsed}, '$', 'array<variant>'), cast(array() as array<variant>))"
    )
    text = "schema_of_variant(try_variant_get({0}, '$.regex', 'variant')) = 'STRING'"
    kept = keep(items, lambda v: text.format(v))
    shaped = transform(
        kept,
        lambda v: "named_struct('regex', try_variant_get({0}, '$.regex', 'string'), "
        "'placeholder', coalesce(try_variant_get({0}, '$.placeholder', 'string'), "
        "try_variant_get({0}, '$.label', 'string')))".format(v),
    )
    return df.withColumns({always: expr(listed(always)), never: expr(listed(never)), patterns: expr(shaped)})


def rules_of(always: DataFrame | None = None, never: DataFrame | None = None, patterns: DataFrame | None = None) -> Rules:
    """``Rules`` from tables ``term`` / ``term`` / ``regex, placeholder[, ord]``.

    Rules are typed by people and belong to the plan, so these small tables are the one thing
    read to the driver. A never list too long for that stays a table: ``drop_exempt_spans``.
    """

    def terms(df: DataFrame | None) -> list[str]:
        return [] if df is None else [r.term for r in df.select("term").orderBy("term").toLocalIterator()]

    listed = []
    if patterns is not None:
        order = ["ord"] if "ord" in patterns.columns else ["regex"]
        listed = [r.asDict() for r in patterns.orderBy(*order).toLocalIterator()]
    return Rules.parse({"always": terms(always), "never": terms(never), "patterns": listed})


def fold_column(text: str):
    """``fold_key`` of a string column; only texts that are not ASCII go through Python."""
    native = f"lower({strip(col(text))})"
    foreign = fold_values(expr(when(is_ascii(col(text)), "null", col(text))))
    return F.coalesce(foreign, expr(native))


def drop_exempt_spans(spans: DataFrame, never: DataFrame) -> DataFrame:
    """Spans whose folded text is not in the table ``never(term)``: an anti join on the key."""
    listed = never.where(F.length(F.trim("term")) > 0).select(fold_column("term").alias("__key")).distinct()
    keyed = spans.withColumn("__key", fold_column("text"))
    return keyed.join(listed, "__key", "left_anti").drop("__key")



_STATUS = "regex string, accepted boolean, timed boolean, reason string"


def _judged(rules: Rules | Mapping | str | None) -> list[tuple[str, bool, bool, str]]:
    parsed = Rules.parse(rules)
    return [(p.regex, not p.reason, not p.reason and p.plain is None, p.reason) for p in (*parsed.patterns, *parsed.refused)]


def rules_status(spark: SparkSession, rules: Rules | Mapping | str | DataFrame | None) -> DataFrame:
    """One row (regex, accepted, timed, reason) per custom pattern: what is used, what is not and why.

    A table of patterns (column ``regex``) is judged where it lies; a list typed by a person on the driver.
    """
    if not isinstance(rules, DataFrame):
        return spark.createDataFrame(_judged(rules), _STATUS)

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [row for x in frame["regex"] for row in _judged({"patterns": [{"regex": x}]})]
            yield pd.DataFrame(rows, columns=["regex", "accepted", "timed", "reason"])

    return rules.select("regex").mapInPandas(judge, _STATUS)
