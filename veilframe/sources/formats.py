"""File formats and admission checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import Sql, array, col, expr, let, lit, when

# The formats told apart by extension, the rest being text.
TEXT_FORMATS = ("txt", "md", "log", "srt", "html", "htm")
FORMATS = (*TEXT_FORMATS, "csv", "json")


def detect_format(filename: Sql) -> Sql:
    """Format by the last extension, ``txt`` where it is missing or unknown."""
    extension = when(f"contains({filename}, '.')", f"lower(substring_index({filename}, '.', -1))", "''")
    return let(extension, lambda x: when(f"array_contains({array(map(lit, FORMATS))}, {x})", x, "'txt'"))


def admit(df: DataFrame, text: str = "text", *, max_chars: int | None = None, into: str = "reason") -> DataFrame:
    """Add why a row is not admitted, null where it is.

    ``text`` may be binary (checked for UTF-8) or a string. There is no size limit unless
    ``max_chars`` sets one. Neither drops rows: split on
    the reason with ``admitted`` and ``rejected``.
    """
    binary = dict(df.dtypes)[text] == "binary"
    decoded = f"try_validate_utf8(cast({col(text)} as string))" if binary else col(text)
    size = "" if max_chars is None else f"when length({decoded}) > {int(max_chars)} then 'size'"
    reason = f"case when {col(text)} is null then null when {decoded} is null then 'encoding' {size} end"
    return df.withColumn(into, expr(reason))


def admitted(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.where(F.col(reason).isNull()).drop(reason)


def rejected(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.where(F.col(reason).isNotNull())
