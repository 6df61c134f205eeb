"""Documents to spans: detection with rules, external spans, span tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detectors import PRIORITY
from ..functions.labels import label_of_placeholder
from ..functions.offsets import NO_SPANS, cut, span
from ..functions.pii import finalized, raw_pii
from ..functions.python_side import fold_texts, timed_matches
from ..functions.rules import CUSTOM_PRIORITY, PATTERN_SECONDS, Rules, ruled_spans, timed_out
from ..functions.spans import finalize_spans, span_texts
from ..functions.sql import Sql, col, expr, keep, let, transform, transform_indexed, when
from ..functions.text import is_blank
from .durable import hold
from .numbering import join_on
from .terms import with_term_candidates

RAW, BASE, SLOW, FOLDED, RULED = HELPERS = ("__raw", "__base", "__slow", "__folded", "__ruled")
GIVEN, TERMS = "__given_leaves", "__terms"


def with_leaf_spans(
    df: DataFrame,
    leaves: Sql,
    into: str,
    *,
    rules: Rules | None = None,
    skip_blank: bool = False,
    found: Sql | None = None,
    incomplete: str | None = None,
    seconds: float = PATTERN_SECONDS,
    terms: Sql | None = None,
) -> DataFrame:
    """Add ``into``: the spans of each text in the array expression ``leaves``. No shuffle.

    A pattern that takes more than ``seconds`` on a text ends the job, unless ``incomplete`` names a
    column for the patterns of each row that did; the row then lacks their findings.

    ``found`` are finalized spans from elsewhere, in the same shape; without them the
    built-in detectors run. Only rules that need Python add a step outside the projection.
    ``terms`` is an array of always-hide terms of the row, beside those of the rules.
    """
    rules = rules or Rules()

    def guard(text: Sql, spans: Sql) -> Sql:
        test = f"{text} is null" + (f" or {is_blank(text)}" if skip_blank else "")
        return when(test, NO_SPANS, spans)

    def close(raw: Sql, priority: Mapping[str, int]) -> Sql:
        return transform_indexed(
            leaves, lambda t, i: let(f"get({raw}, {i})", lambda found: finalized(t, found, priority))
        )

    ruling = bool(rules) or terms is not None
    base = BASE if ruling else into
    if found:
        df = df.withColumn(base, expr(found))
    else:
        df = df.withColumn(RAW, expr(transform(leaves, lambda t: guard(t, raw_pii(t)))))
        df = hold(df, **{base: close(RAW, PRIORITY)})
    if incomplete and not (rules and rules.slow_patterns):
        df = df.withColumn(incomplete, expr("cast(array() as array<string>)"))
    if not ruling:
        return df.drop(*HELPERS)
    if rules.slow_patterns:
        timed = timed_matches(rules.slow_patterns, seconds, incomplete is not None)
        df = df.withColumn(SLOW, timed(expr(leaves)))
        if incomplete:
            df = df.withColumn(incomplete, expr(timed_out(SLOW, rules)))
    if rules.folds_in_python:
        df = df.withColumn(FOLDED, fold_texts(expr(transform(BASE, span_texts))))

    def ruled(text: Sql, i: Sql) -> Sql:
        slow = f"get({SLOW}, {i})" if rules.slow_patterns else None
        folded = f"get({FOLDED}, {i})" if rules.folds_in_python else None
        return guard(text, let(f"get({BASE}, {i})", lambda s: ruled_spans(text, s, rules, slow, folded, terms)))

    df = df.withColumn(RULED, expr(transform_indexed(leaves, ruled)))
    return hold(df, **{into: close(RULED, CUSTOM_PRIORITY)}).drop(*HELPERS)


def with_spans(
    df: DataFrame,
    text: str = "text",
    into: str = "spans",
    *,
    rules: Rules | Mapping | str | None = None,
    found: str | None = None,
    incomplete: str | None = None,
    seconds: float = PATTERN_SECONDS,
    always: DataFrame | None = None,
) -> DataFrame:
    """Add the array of disjoint spans of a text column. No shuffle, unless ``always``, a table of terms, joins in.

    ``incomplete`` names a column for the custom patterns that passed their time limit on the row.
    """
    parsed = Rules.parse(rules)
    if always is not None:
        df = with_term_candidates(df, always, text, TERMS)
        given = f"array(coalesce({col(found)}, {NO_SPANS}))" if found else None
        options = {"found": given, "incomplete": incomplete, "seconds": seconds, "terms": TERMS}
        df = with_leaf_spans(df, f"array({col(text)})", "__leaf_spans", rules=parsed, **options)
        return df.withColumn(into, expr("__leaf_spans[0]")).drop("__leaf_spans", TERMS)
    if incomplete and not parsed:
        df = df.withColumn(incomplete, expr("cast(array() as array<string>)"))
    if not parsed and found:
        return df.withColumn(into, expr(f"coalesce({col(found)}, {NO_SPANS})"))
    if not parsed:
        raw = df.withColumn(RAW, expr(raw_pii(col(text))))
        return hold(raw, **{into: finalized(col(text), RAW)}).drop(RAW)
    wrapped = "__leaf_spans"
    given = f"array(coalesce({col(found)}, {NO_SPANS}))" if found else None
    df = with_leaf_spans(df, f"array({col(text)})", wrapped, rules=parsed, found=given, incomplete=incomplete, seconds=seconds)
    return df.withColumn(into, expr(f"{wrapped}[0]")).drop(wrapped)


def explode_spans(df: DataFrame, key: Sequence[str], spans: str = "spans") -> DataFrame:
    """One row per span of a span column: the key, label, start, end, text."""
    return df.select(*key, F.inline(spans)).select(*key, "label", "start", "end", "text")


def ingest_external_spans(
    docs: DataFrame,
    external: DataFrame,
    key: Sequence[str] = ("doc_id",),
    text: str = "text",
    into: str = "spans",
) -> DataFrame:
    """Documents with the spans another detector found for them.

    ``external`` has the key and start, end, text, placeholder, label (and ``ord`` where the
    order matters). Labels come from the placeholder, else the given label, else ``PII``;
    a missing text is cut from the document. Finalized without priorities.
    """
    keys = list(key)
    grouped = external.groupBy(*keys).agg(_collected(external).alias(RAW))

    def close(t: Sql) -> Sql:
        return when(f"{t} is null or {RAW} is null", NO_SPANS, external_spans(t, RAW))

    return hold(docs.join(grouped, keys, "left"), **{into: let(col(text), close)}).drop(RAW)


def _collected(external: DataFrame, *more: str):
    order = ["ord"] if "ord" in external.columns else []
    return F.sort_array(F.collect_list(F.struct(*order, "start", "end", "text", "placeholder", "label", *more)))


def external_spans(text: Sql, given: Sql) -> Sql:
    """Finalized spans of ``text`` from another detector's findings, see ``ingest_external_spans``."""

    def labelled(s: Sql) -> Sql:
        label = f"coalesce({label_of_placeholder(f'{s}.placeholder')}, upper({s}.label), 'PII')"
        start, end = f"int({s}.start)", f"int({s}.end)"
        return span(label, start, end, f"coalesce({s}.text, {cut(text, start, end)})")

    return let(transform(given, labelled), lambda s: finalize_spans(text, s, {}))


def with_external_leaves(df: DataFrame, external: DataFrame, key: Sequence[str], leaves: Sql, into: str) -> DataFrame:
    """Add ``into``, the findings of another detector for each text of ``leaves``, for ``with_leaf_spans(found=)``.

    ``external`` has the key, ``leaf`` (which text of the row, from 0), and the columns of
    ``ingest_external_spans``. Keys are compared with null equal to null.
    """
    grouped = external.groupBy(*key).agg(_collected(external, "leaf").alias(GIVEN))

    def close(t: Sql, i: Sql) -> Sql:
        own = keep(GIVEN, lambda g: f"{g}.leaf = {i}")
        return when(f"{t} is null or {GIVEN} is null", NO_SPANS, external_spans(t, own))

    return hold(join_on(df, grouped, [], "left", scopes=list(key)), **{into: transform_indexed(leaves, close)}).drop(GIVEN)


def check_engine(engine: str | None, external: DataFrame | None) -> str:
    """``ml`` or ``lite``: what an engine name comes to, given external findings or none."""
    name = engine or "auto"
    if name == "ml" and external is None:
        raise ValueError("engine 'ml' needs a table of external spans")
    return "ml" if external is not None and name in ("ml", "auto") else "lite"


def choose_spans(
    docs: DataFrame,
    *,
    engine: str | None = "auto",
    external: DataFrame | None = None,
    key: Sequence[str] = ("doc_id",),
    text: str = "text",
    rules: Rules | Mapping | str | None = None,
    into: str = "spans",
    incomplete: str | None = None,
    always: DataFrame | None = None,
) -> DataFrame:
    """Add spans from the chosen engine and the name of the engine used.

    ``always(term)`` is a table of always-hide terms, of any length, beside those of the rules.

    ``ml`` means the external spans and fails without them; ``auto`` takes them where given
    and else the built-in detectors, as any other name does.
    """
    if check_engine(engine, external) == "ml":
        given = "__given"
        found = ingest_external_spans(docs, external, key, text, given)
        return with_spans(found, text, into, rules=rules, found=given, incomplete=incomplete, always=always).drop(given).withColumn("engine", F.lit("ml"))
    return with_spans(docs, text, into, rules=rules, incomplete=incomplete, always=always).withColumn("engine", F.lit("lite"))


def detect_docs(
    docs: DataFrame,
    key: Sequence[str] = ("doc_id",),
    text: str = "text",
    *,
    rules: Rules | Mapping | str | None = None,
    engine: str | None = "auto",
    external: DataFrame | None = None,
    always: DataFrame | None = None,
) -> DataFrame:
    """The spans table: one row per span with key, label, start, end, text, engine."""
    lean = docs.select(*key, text)
    if external is None and always is None and engine != "ml" and not Rules.parse(rules):
        # explode the expression itself: on a column, the optimizer would add a filter that
        # evaluates the detectors a second time
        raw = lean.withColumn(RAW, expr(raw_pii(col(text))))
        return raw.select(*key, F.inline(expr(finalized(col(text), RAW)))).withColumn("engine", F.lit("lite"))
    chosen = choose_spans(lean, engine=engine, external=external, key=key, text=text, rules=rules, always=always)
    return explode_spans(chosen, [*key, "engine"]).select(*key, "label", "start", "end", "text", "engine")

