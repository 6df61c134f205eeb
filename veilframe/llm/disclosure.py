"""Personal data, and the terms that give it away.

Spans of four kinds are found with patterns and checks. Beyond them, a term can reveal a value that
is itself hidden, because it hardly ever stands anywhere else. How much it reveals in a text is estimated
from all other texts of the corpus: the text itself and its copies are left out of every count, since a
term that was only looked at because it stands there always stands there. With ``df`` the number of the other
documents and ``D`` all of them,

    information of entity e     IC(e)     = -log2(df(e) / D)
    what term t says about e    PMI(t, e) = log2(df(t, e) * D / (df(t) * df(e)))
    disclosure                  PMI / IC, 1 if t stands only beside e

A term of a document that holds e is removed at a disclosure of ``REMOVE`` and generalised from
``GENERALISE`` on. A pair that no other text holds has no estimate and reveals nothing, nor does an entity
that all others hold. There is no least number of texts beyond that.

All of it is built from Spark's functions. A disclosure of G asks for df(t) <= df(e) * D^(1 - G), because no
entity has more information than log2(D); terms that are too frequent for any entity or for the one beside
them are therefore left out before pairs are formed, and no result depends on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.offsets import marked_pieces, marker_free, spans_of_pieces
from ..functions.sql import let
from ..operators.durable import hold
from .common import durable, texts_of

GENERALISE = 0.9
REMOVE = 0.999

# Each run of characters is read once: a match can only begin where a run begins or the last match ended,
# and possessive repeats do not give back what cannot help. The matches are those of the plain patterns.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
TERM = r"\p{L}{3,}+"

_SPAN = "struct<label:string,start:int,end:int,text:string>"
_NONE = f"cast(array() as array<{_SPAN}>)"


def _matches(text: str, kind: str, pattern: str, possible: str, right: str) -> str:
    """Spans of a pattern where the cheap test ``possible`` holds, less those that fail the check ``right``."""
    found = let(marked_pieces(text, pattern), lambda pieces: let(f"'{kind}'", lambda label: spans_of_pieces(pieces, label)))
    return f"if({possible}, filter({found}, x -> {right}), {_NONE})"


def base_spans(text: str) -> str:
    """SQL of the array of base spans of the string expression ``text`` (bound, not null), by start, then kind."""
    digits = "length(regexp_replace(x.text, '[^0-9]', ''))"
    kinds = (
        _matches(text, "email", EMAIL, f"contains({text}, '@')", "true"),
        _matches(
            text, "ip", IP, rf"{text} rlike r'[0-9]\.[0-9]'",
            # a part of many digits is over 255 whatever they are, unless they are leading zeros
            r"forall(split(x.text, r'\.'), p -> regexp_replace(p, '^0+', '') rlike '^([0-9]?[0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$')",
        ),
        _matches(
            text, "card", CARD, rf"{text} rlike r'[0-9](?:[\x20-]?+[0-9]){{11}}'",
            f"{digits} between 12 and 19 and luhn_check(regexp_replace(x.text, '[^0-9]', ''))",
        ),
        _matches(text, "phone", PHONE, f"contains({text}, '+')", f"{digits} between 9 and 15"),
    )
    order = "case {0}.label when 'email' then 0 when 'ip' then 1 when 'card' then 2 else 3 end"
    key = lambda v: f"struct({v}.start, {order.format(v)})"
    return (
        f"array_sort(concat({', '.join(kinds)}), (a, b) -> case when {key('a')} < {key('b')} then -1"
        f" when {key('a')} > {key('b')} then 1 else 0 end)"
    )


def term_spans(text: str) -> str:
    """SQL of the array of terms (whole runs of letters, three and more) outside of e-mail addresses."""
    found = let(marked_pieces(text, rf"{EMAIL}|(?<!\p{{L}}){TERM}"), lambda p: let("'term'", lambda label: spans_of_pieces(p, label)))
    return f"filter({found}, x -> not contains(x.text, '@'))"


def _prepared(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` (never null), ``th`` (a key of the text) and ``base`` (its spans)."""
    rows = texts_of(docs).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("th", F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")))
    return hold(rows, base=let(marker_free("text"), base_spans))


def revealing_spans(docs: DataFrame) -> DataFrame:
    """``th`` of texts that hold revealing terms, and ``terms``, the array of their spans (kind, start, end)."""
    rows = _prepared(docs)
    private = rows.filter("size(base) > 0")
    values = F.explode(F.expr("array_distinct(transform(base, x -> concat(x.label, ':', lower(x.text))))")).alias("entity")
    held = private.select("th", values).groupBy("th", "entity").agg(F.count("*").alias("copies"))
    held = durable(held)
    often = held.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("copies").alias("df_e"))
    often = often.filter("texts > 1").select("entity", "df_e")
    exposed = durable(held.join(often, "entity"))

    one = private.select("th", "text").groupBy("th").agg(F.first("text").alias("text"))
    one = one.join(exposed.select("th").distinct(), "th", "left_semi")
    terms = hold(one, found=let(marker_free("text"), term_spans))
    terms = terms.select("th", F.explode("found").alias("x"))
    terms = durable(terms.select("th", F.lower("x.text").alias("term"), "x.start", "x.end"))

    # added up in each task first, so what is shuffled is each task's vocabulary
    known = rows.select(F.explode(F.expr(f"array_distinct(transform(regexp_extract_all(text, r'{TERM}', 0), x -> lower(x)))")).alias("term"))
    counts = known.groupBy("term").agg(F.count("*").alias("df_t"))
    total = F.broadcast(rows.agg(F.count("*").alias("d")))  # one row, as the next
    most = F.broadcast(exposed.agg(F.max("df_e").alias("most_e")))
    slack = F.pow("d", F.lit(1 - GENERALISE)) * (1 + 1e-9)  # rounding must not leave out what the estimate lets in
    rare = counts.crossJoin(total).crossJoin(most).filter(F.col("df_t") <= F.col("most_e") * slack).select("term", "df_t", "d")
    rare = terms.select("th", "term").distinct().join(rare, "term")
    beside = durable(rare.join(exposed, "th").filter(F.col("df_t") <= F.col("df_e") * slack))

    pairs = beside.groupBy("entity", "term").agg(
        F.count("*").alias("texts"), F.sum("copies").alias("df_et"), F.first("df_t").alias("of"), F.first("d").alias("all")
    )
    slack = F.pow("all", F.lit(1 - GENERALISE)) * (1 + 1e-9)
    pairs = pairs.filter((F.col("texts") > 1) & (F.col("of") <= F.col("df_et") * slack)).select("entity", "term", "df_et")
    others = {c: F.col(c) - F.col("copies") for c in ("df_et", "df_t", "df_e", "d")}
    share = others["df_et"] / others["df_t"]
    information = -F.log2(others["df_e"] / others["d"])
    scored = beside.join(pairs, ["entity", "term"])
    scored = scored.withColumn("disclosure", F.when(information > 0, (information + F.log2(share)) / information))
    telling = scored.filter(F.col("disclosure") >= GENERALISE).groupBy("th", "term").agg(F.max("disclosure").alias("disclosure"))
    shown = terms.join(telling, ["th", "term"])
    kind = F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise")
    return shown.groupBy("th").agg(F.sort_array(F.collect_list(F.struct("start", "end", kind.alias("kind")))).alias("terms"))


def find_private(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` (label, start, end, text) and ``terms`` (start, end, kind) of every row.

    Offsets are code points. Null texts count as empty; rows that share an id are each judged by their text.
    """
    rows = _prepared(docs).select("doc_id", "th", "base")
    return rows.join(revealing_spans(docs), "th", "left").select("doc_id", "base", "terms")


_PUT = "concat('[', upper({0}), ']')"


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced by its kind, and telling terms removed or replaced by [TERM].

    Where spans overlap, the first one counts and the others begin where it ends.
    """
    names = docs.columns
    rows = docs.withColumn("__text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = rows.withColumn("__th", F.struct(F.xxhash64("__text").alias("a"), F.xxhash64(F.lit(1), "__text").alias("b")))
    rows = hold(rows, __base=let(marker_free("__text"), base_spans))
    found = revealing_spans(docs).select(F.col("th").alias("__th"), F.col("terms").alias("__terms"))
    rows = rows.join(found, "__th", "left")
    spans = (
        "array_sort(concat(transform(__base, x -> struct(x.start as s, x.end as e, " + _PUT.format("x.label") + " as put)), "
        "transform(coalesce(__terms, cast(array() as array<struct<start:int,end:int,kind:string>>)), "
        "x -> struct(x.start as s, x.end as e, if(x.kind = 'remove', '', '[TERM]') as put))))"
    )
    # runs of overlapping spans: each span shows its own sign, and text between the furthest end so far and its start
    cut = let(
        spans,
        lambda a: let(
            f"aggregate({a}, struct(cast(0 as int) as at, cast(array() as array<string>) as parts), "
            f"(acc, x) -> struct(greatest(acc.at, x.e) as at, if(x.s < acc.at, acc.parts, "
            f"concat(acc.parts, array(substring(__text, acc.at + 1, x.s - acc.at), x.put))) as parts))",
            lambda done: f"concat(array_join({done}.parts, ''), substring(__text, {done}.at + 1))",
        ),
    )
    changed = hold(rows, __new=f"if(size(__base) = 0 and __terms is null, __text, {cut})")
    return changed.select(*[F.col("__new").alias("text") if n == "text" else F.col(f"`{n}`") for n in names])
