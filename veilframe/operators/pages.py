"""Redacting page text: every occurrence of every value found on the page is blacked out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.offsets import literal_pieces, marker_free, spans_of_pieces
from ..functions.spans import apply_replacements, merge_overlaps, span_texts
from ..functions.sql import Sql, col, expr, keep, let, transform
from ..functions.text import is_blank
from .detect import choose_spans
from .durable import hold

BLOCK = "█"


def redact_pages(
    pages: DataFrame,
    *,
    text: str = "text",
    rules=None,
    into: str = "redacted",
    engine: str | None = "auto",
    external: DataFrame | None = None,
    key: Sequence[str] = ("page_id",),
) -> DataFrame:
    """Add the redacted text, the number of redactions and the engine used (see ``choose_spans``).

    Values are the distinct non-blank span texts of the page; each occurrence of each value
    counts, also where two values overlap, and what any of them covers is blocked out.
    """
    found = choose_spans(pages, engine=engine, external=external, key=key, text=text, rules=rules, into="__spans")
    values = f"array_distinct({keep(span_texts('__spans'), lambda t: f'not ({is_blank(t)})')})"

    def hits(t: Sql) -> Sql:
        each = transform(
            values,
            lambda v: let(literal_pieces(t, marker_free(v)), lambda p: spans_of_pieces(p, "'HIT'")),
        )
        return f"flatten({each})"

    located = hold(found, __hits=let(marker_free(col(text)), hits))
    merged = located.withColumn("__areas", expr(merge_overlaps("__hits")))
    blocked = apply_replacements(col(text), "__areas", lambda a, i: f"repeat('{BLOCK}', {a}.end - {a}.start)")
    return merged.withColumns({into: expr(blocked), "redactions": expr("size(__hits)")}).drop(
        "__spans", "__hits", "__areas"
    )

