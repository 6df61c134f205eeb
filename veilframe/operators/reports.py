"""Reports and checks over anonymization results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import apply_replacements
from ..functions.sql import Sql, col, expr, keep, let, lit, when
from ..functions.tokens import TOKEN_PATTERN, restore

# HTML escapes, the ampersand first.
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def html_escape(text: Sql) -> Sql:
    for char, entity in HTML_ESCAPES:
        text = f"replace({text}, {lit(char)}, {lit(entity)})"
    return text


def highlight_docs(df: DataFrame, *, text: str = "scanned", spans: str = "spans", into: str = "html") -> DataFrame:
    """The text as HTML with every span marked."""

    def mark(s: Sql, i: Sql) -> Sql:
        title = html_escape(f"{s}.label")
        return f"concat('<mark class=\"pii\" title=\"', {title}, '\">', {html_escape(f'{s}.text')}, '</mark>')"

    body = let(
        apply_replacements(col(text), col(spans), mark, html_escape), lambda h: when(f"{h} = ''", "'&nbsp;'", h)
    )
    return df.withColumn(into, expr(body))


def summary_by_label(spans: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Occurrences per label of a spans table, optionally per file or other column."""
    return spans.groupBy(*by, "label").agg(F.count("*").alias("n"))


def summary_rollup(docs: DataFrame, file: str, *, spans: str = "spans") -> DataFrame:
    """Occurrences per (file, label), per file and in all; a file without any counts 0.

    ``level`` is 0 for (file, label) rows, 1 for files, 3 for the grand total.
    """
    rows = docs.select(file, F.explode_outer(F.transform(spans, lambda s: s["label"])).alias("label"))
    rolled = rows.rollup(file, "label").agg(
        F.count("label").alias("n"), F.grouping_id(file, "label").cast("int").alias("level")
    )
    # the label group of the null placeholder row says nothing a file row does not
    return rolled.where((F.col("level") > 0) | F.col("label").isNotNull())


def leak_check(result: DataFrame, key: Sequence[str], *, spans: str = "spans", output: str = "output") -> DataFrame:
    """Every detected original that is still in the output: must be empty."""
    left = keep(col(spans), lambda s: f"instr({col(output)}, {s}.text) > 0")
    return result.select(*key, F.inline(expr(left))).select(*key, "label", "text")


def leak_counts(result: DataFrame, outputs: Mapping[str, str], *, spans: str = "spans") -> DataFrame:
    """``mode``, ``checked`` and ``leaks``: how many spans there are, and how many texts of theirs are still in the
    output of each mode. ``outputs`` maps modes to columns of one table, which is read once."""
    left = {m: keep(col(spans), lambda s, c=c: f"contains({col(c)}, {s}.text)") for m, c in outputs.items()}
    sums = [F.coalesce(F.sum(expr(f"cast(size({a}) as bigint)")), F.lit(0)).alias(f"n{i}") for i, a in enumerate(left.values())]
    total = F.coalesce(F.sum(F.size(spans).cast("long")), F.lit(0)).alias("checked")
    counted = result.agg(total, *sums)
    rows = F.array(*[F.struct(F.lit(m).alias("mode"), "checked", F.col(f"n{i}").alias("leaks")) for i, m in enumerate(outputs)])
    return counted.select(F.inline(rows))


def leak_check_tables(spans: DataFrame, outputs: DataFrame, key: Sequence[str], *, output: str = "output") -> DataFrame:
    """``leak_check`` where spans and outputs are stored apart."""
    distinct = spans.select(*key, "label", "text").distinct()
    joined = distinct.join(outputs.select(*key, output), list(key))
    return joined.where(F.instr(output, F.col("text")) > 0).select(*key, "label", "text")


def holds_tokens(docs: DataFrame, key: Sequence[str], *, text: str = "text") -> DataFrame:
    """Rows whose input already has the shape of a token; reversing those is not safe."""
    return docs.where(F.col(text).rlike(TOKEN_PATTERN)).select(*key)


def roundtrip_check(
    result: DataFrame, key: Sequence[str], *, text: str = "scanned", output: str = "output", mapping: str = "map"
) -> DataFrame:
    """Rows whose reversal is not the text that went in: must be empty."""
    back = let(col(output), lambda t: restore(t, col(mapping)))
    checked = result.select(*key, F.col(text).alias("expected"), expr(back).alias("restored"))
    return checked.where(~F.col("expected").eqNullSafe(F.col("restored")))


def consistency_check(tokens: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Values with several tokens and tokens with several values, per scope: must be empty.

    ``tokens`` has the scope, original and token of every use.
    """
    pairs = tokens.select(*scope, "original", "token").distinct()
    many_tokens = pairs.groupBy(*scope, F.col("original").alias("subject")).agg(F.count("*").alias("n"))
    many_values = pairs.groupBy(*scope, F.col("token").alias("subject")).agg(F.count("*").alias("n"))
    kinds = many_tokens.withColumn("kind", F.lit("original")).unionByName(many_values.withColumn("kind", F.lit("token")))
    return kinds.where(F.col("n") > 1)


def used_tokens(result: DataFrame, key: Sequence[str], *, mapping: str = "map") -> DataFrame:
    """The (key, token, original) rows of a map column."""
    return result.select(*key, F.explode(mapping).alias("token", "original"))

