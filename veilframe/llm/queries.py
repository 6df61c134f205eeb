"""The dealt operators over the given tables, one query each.

``QUERIES`` maps a name to ``(spark, sf_dir) -> DataFrame``; ``ORACLES`` holds DuckDB SQL where SQL
can say the whole result on whole tables in acceptable time.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytepairs import BytePairs, decode_ids, encode_texts, read_ranks
from .collision import nearest
from .common import documents, fold_of
from .dialogues import damage, repair
from .disclosure import KINDS, find_private
from .importance import resample
from .langid import fit_languages, identify_languages
from .packing import pack_documents
from .ppm import score_documents
from .repetition import quality_rules
from .sentencepieces import verify_pieces
from .simhash import fingerprint_hex, near_copies
from .substring import remove_repeats
from .toxicity import fit_toxicity, score_toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# Every window of 20 words, numbered among its equals by place; all but the first of them go.
ORACLES["op4_substring"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS k
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""


def crc32_sql(text: str) -> str:
    """DuckDB has no crc32: a table of 256 values (``crc_table``, a list ``t``) applied byte by byte."""
    bits = f"hex(encode({text}))"
    each = f"list_transform(range(length({bits}) // 2), lambda i: CAST('0x' || substr({bits}, 2 * i + 1, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce({each}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295))"


CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS v FROM (SELECT unnest(range(256)) AS n)))"""


def _edit(state: str, price: str, letter: str, piece: str = "''") -> str:
    return f"{{'c': {state}.c + {price}, 'a': {state}.a || '{letter}', 'r': {state}.r || {piece}}}"


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


def _word_counts(table: str) -> str:
    """Bucket counts of a table; the checksum is taken once for each word."""
    return f"""SELECT b, CAST(sum(n) AS DOUBLE) AS n FROM (SELECT {crc32_sql("w")} % 10000 AS b, n FROM
        (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM {table}) GROUP BY w), crc_table) GROUP BY b"""


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLES["op11_resample"] = f"""
WITH {CRC_TABLE}, d AS (SELECT doc_id, row_number() OVER () AS k, {_WORDS} AS words FROM documents), m AS (SELECT {_WORDS} AS words FROM benchmark),
s AS ({_word_counts("d")}), t AS ({_word_counts("m")}),
gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)
    / ((s.n + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (b)),
word AS (SELECT w, g FROM (SELECT w, {crc32_sql("w")} % 10000 AS b FROM (SELECT DISTINCT unnest(words) AS w FROM d), crc_table) JOIN gain USING (b)),
weights AS (SELECT k, CAST(sum(g) AS BIGINT) AS weight FROM (SELECT k, unnest(words) AS w FROM d) JOIN word USING (w) GROUP BY k),
scored AS (SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
    (CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
    FROM d LEFT JOIN weights USING (k)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS n,
    (SELECT count(*) FROM d WHERE len(words) >= 20) * 10 // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND n <= drawn THEN n END AS rank FROM ranked"""


# One row after the other, with the best cost, string and text for each state of the grammar (b: start, s, u, a).
_NEVER = "{'c': 1000000, 'a': '', 'r': ''}"


def _inserted(rows: str) -> str:
    """``rows`` with u1 and a1: the best after turns that may be inserted here."""
    user = _least("u", *(_edit(x, "5", "I", "chr(10) || 'user:'") for x in "bsa"))
    assistant = _least("a", _edit("u1", "5", "I", "chr(10) || 'assistant:'"))
    return f"SELECT *, {assistant} AS a1 FROM (SELECT *, {user} AS u1 FROM {rows})"


_OPEN = _least("b", "s", "a1")
_MAY = "CASE WHEN f IN ('b', 'd') THEN 1000000 ELSE {0} + CASE WHEN f = 't' THEN 5 ELSE 0 END END"
_KEEP = "CASE WHEN i = '{0}' THEN " + _MAY.format(0) + " ELSE 1000000 END"
_OWN = "chr(10) || role || ':' || text"
ORACLES["op13_dialogues"] = f"""
WITH RECURSIVE {CRC_TABLE},
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations, crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM keyed),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM damaged),
turns AS (SELECT conv_id, n, turn, role, text, substr(role, 1, 1) AS i,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS i0,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
         WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd'
         WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE ' ' END AS f FROM numbered),
ways AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, {{'c': 0, 'a': '', 'r': ''}} AS b, {_NEVER} AS s, {_NEVER} AS u, {_NEVER} AS a FROM conversations
    UNION ALL
    SELECT conv_id, n, {_edit("b", "2", "D")}, {_least(_edit("s", "2", "D"), _edit("b", _KEEP.format("s"), "K", _OWN))},
        {_least(_edit("u1", "2", "D"), _edit("o", _KEEP.format("u"), "K", _OWN), _edit("o", _MAY.format(1), "R", "chr(10) || 'user:' || text"))},
        {_least(_edit("a1", "2", "D"), _edit("u1", _KEEP.format("a"), "K", _OWN), _edit("u1", _MAY.format(1), "R", "chr(10) || 'assistant:' || text"))}
    FROM (SELECT *, {_OPEN} AS o FROM ({_inserted(
        "(SELECT w.conv_id, t.n, w.b, w.s, w.u, w.a, t.role, t.text, t.i, t.f FROM ways w JOIN turns t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.n = w.n + 1)")}))),
best AS (SELECT conv_id, {_least("b", "a1")} AS w FROM ({_inserted(
    "(SELECT * FROM ways QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1)")})),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank,
    count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated, count(*) FILTER (n > 1 AND i0 || i NOT IN ('su', 'ua', 'au')) AS illegal
    FROM turns GROUP BY conv_id)
SELECT best.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(w.c AS BIGINT) AS cost, w.a AS audit, sha256(substr(w.r, 2)) AS repaired_sha256
FROM best LEFT JOIN counted ON best.conv_id IS NOT DISTINCT FROM counted.conv_id"""


def held_out(parts: int, fold: int):
    return F.coalesce(fold_of(parts) == fold, F.lit(False)).alias("held_out")


@query
def op1_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit_toxicity(docs, documents(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    predicted = (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", held_out(5, 0), F.col("toxicity").alias("score"), predicted)


@query
def op2_repetition(spark, sf_dir):
    return quality_rules(documents(spark, sf_dir)).drop("repeats")


@query
def op3_sentencepieces(spark, sf_dir):
    return verify_pieces(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op4_substring(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op5_private(spark, sf_dir):
    found = find_private(documents(spark, sf_dir))
    sign = "transform({0}, x -> concat(x.{1}, ':', x.start, ':', x.end))"
    base = sign.format("base", "label")
    # base spans come before the others where both start at the same place
    every = (
        "array_sort(concat(transform(base, (x, i) -> struct(x.start as s, i as o, concat(x.label, ':', x.start, ':', x.end) as t)), "
        "coalesce(transform(terms, x -> struct(x.start as s, 2147483647 as o, concat(x.kind, ':', x.start, ':', x.end) as t)), array())))"
    )
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(base, x -> x.label = '{k}')) as long)").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.expr(base), ","), 256).alias("base_sha256"),
        F.array_join(F.expr(f"transform({every}, x -> x.t)"), ",").alias("spans"),
    )


@query
def op6_neighbours(spark, sf_dir):
    return nearest(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query
def op7_simhash(spark, sf_dir):
    return near_copies(documents(spark, sf_dir)).select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op8_packing(spark, sf_dir):
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op9_ppm(spark, sf_dir):
    return score_documents(documents(spark, sf_dir))


@query
def op10_language(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = fit_languages(docs, fold_of(4) != 2)
    return identify_languages(docs, model).select("doc_id", held_out(4, 2), "lang_pred", "score")


@query
def op11_resample(spark, sf_dir):
    drawn = resample(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op12_bytepairs(spark, sf_dir):
    codec = BytePairs(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    both = decode_ids(encode_texts(documents(spark, sf_dir), codec), codec)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op13_dialogues(spark, sf_dir):
    return repair(damage(documents(spark, sf_dir, "conversations")))
