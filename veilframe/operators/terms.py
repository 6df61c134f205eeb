"""Always-hide terms that are too many for a plan: a table that meets the texts by a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.offsets import MARK
from ..functions.sql import Sql, col, expr, let, lit, transform, transform_indexed, when
from ..functions.text import is_ascii, strip
from .durable import SENT, durable, hold, sent_or_shuffled

GRAM = 6
SALTS = 64
TEXT_MARK, TERM = "__text_mark", "__term"
# The characters beyond ASCII that match an ASCII letter when case is ignored, and that letter.
_CASELESS = ("İıſK", "iisk")


def _caseless(text: Sql) -> Sql:
    """``text`` with one character for each of its own, equal wherever two texts match without regard to case."""
    wide = f"regexp_replace(translate({text}, {lit(_CASELESS[0])}, {lit(_CASELESS[1])}), r'[^\\x00-\\x7f]', '\u0080')"
    return f"lower({when(is_ascii(text), text, wide)})"


def _grams(text: Sql, length: int) -> Sql:
    """The different runs of ``length`` characters of a text. Cutting substrings would count characters anew for each."""

    def run(chars: Sql) -> Sql:
        each = transform_indexed(chars, lambda c, i: f"concat({', '.join([c, *(f'get({chars}, {i} + {k})' for k in range(1, length))])})")
        return f"array_distinct(slice({each}, 1, greatest(size({chars}) - {length - 1}, 0)))"

    return let(f"if({text} = '', cast(array() as array<string>), split({text}, ''))", run)


def term_anchors(terms: DataFrame, length: int = GRAM) -> DataFrame:
    """``gram``, ``size`` and the term: of each term's runs of ``length`` characters the one that fewest terms share.

    Terms are stripped, blank and null ones dropped, repeated ones taken once. A shorter term is its own anchor.
    Those with the control characters 1 or 2, which detection uses as marks, are an error.
    """
    bad = f"({TERM} like '%{MARK}%' or {TERM} like '%\x02%')"
    own = terms.select(expr(strip(f"cast({col('term')} as string)")).alias(TERM)).where(f"{TERM} <> ''").distinct()
    own = own.select(expr(when(bad, "raise_error('a term holds a control character that marks matches')", TERM)).alias(TERM))
    folded = hold(durable(own), __folded=_caseless(TERM))  # written once, as its runs are both counted and ranked
    whole = f"length(__folded) < {length}"
    runs = folded.select(TERM, F.explode(expr(when(whole, "array(__folded)", _grams("__folded", length)))).alias("gram"))
    # both sides grow with the terms: packed strings that look small would still fill the driver
    shared = runs.groupBy("gram").agg(F.count("*").alias("n")).hint("merge")
    first = Window.partitionBy(TERM).orderBy("n", "gram")
    ranked = runs.join(shared, "gram").withColumn("at", F.row_number().over(first))
    return ranked.where("at = 1").select("gram", F.length("gram").alias("size"), TERM)


def _text_mark(docs: DataFrame, text: str) -> Sql:
    """128 bits of the text, and one of ``SALTS`` numbers by the row's other columns: equal texts in many rows do not meet in one task."""
    others = [col(f.name) for f in docs.schema.fields if f.name != text and not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    salt = f"pmod(xxhash64({', '.join(others)}), {SALTS})" if others else "0L"
    return f"named_struct('a', xxhash64({col(text)}), 'b', xxhash64('b', {col(text)}), 'salt', {salt})"


def with_term_candidates(docs: DataFrame, terms: DataFrame, text: str, into: str, *, sent: int = SENT) -> DataFrame:
    """Add ``into``: the terms of the table ``terms(term)`` whose anchor stands in the text, which are all that can match.

    Each text looks for its different runs of characters among the anchors; what is found joins the text. Runs are
    compared by digests, as detection looks at the candidates again. Tables of ``sent`` measured bytes at most go to
    all tasks, so texts do not move; larger ones are shuffled, and no join is left to send them through the driver. Nothing is read to the driver but those sizes and the
    lengths of anchors, ``GRAM`` at most. Findings belong to 128 bits of the text, so null and repeated keys are no
    matter. A row holds its own candidates, no more.
    """
    empty = "cast(array() as array<string>)"
    anchors = durable(term_anchors(terms))
    sizes = sorted(r["size"] for r in anchors.select("size").distinct().collect())
    if not sizes:
        return docs.withColumn(into, expr(empty))
    marked = docs.withColumn(TEXT_MARK, expr(_text_mark(docs, text)))
    folded = hold(marked.where(F.col(col(text)).isNotNull()).select(TEXT_MARK, col(text)), __folded=_caseless(col(text)))
    grams = let("__folded", lambda t: f"concat({', '.join(transform(_grams(t, n), lambda g: f'xxhash64({g})') for n in sizes)})")
    each = folded.select(TEXT_MARK, F.explode(expr(grams)).alias("gram"))
    known = sent_or_shuffled(anchors.select(F.xxhash64("gram").alias("gram"), TERM), f"octet_length({TERM})", limit=sent)
    hits = each.join(known, "gram").groupBy(TEXT_MARK).agg(F.sort_array(F.collect_set(TERM)).alias(into))
    hits = sent_or_shuffled(durable(hits), f"aggregate({col(into)}, 0L, (n, t) -> n + 32 + octet_length(t))", limit=sent)
    joined = marked.join(hits, TEXT_MARK, "left").drop(TEXT_MARK)
    return joined.withColumn(into, expr(f"coalesce({col(into)}, {empty})"))
