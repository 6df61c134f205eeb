"""One query per operator over the given tables, each with its DuckDB twin where SQL can say it.

``QUERIES`` maps a name to ``(spark, sf_dir) -> DataFrame`` and ``ORACLES`` a name to SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.detectors import PRIORITY, detect_label
from ..functions.labels import placeholder_of, type_of
from ..functions.offsets import span
from ..functions.pii import raw_pii
from ..functions.spans import apply_replacements, finalize_spans, propagate_spans
from ..functions.sql import expr
from ..functions.text import normalize_text
from ..functions.tokens import hmac_pads
from ..functions.validators import cuit_ok, luhn_ok, phone_ok
from ..operators.anonymize import anonymize_docs, deanonymize, deanonymize_rows, redact_placeholder, rewrite_found
from ..operators.detect import choose_spans, detect_docs, explode_spans, ingest_external_spans
from ..operators.durable import durable, shared_folder
from ..operators.pages import redact_pages
from ..operators.reports import (
    consistency_check,
    highlight_docs,
    holds_tokens,
    leak_counts,
    roundtrip_check,
    summary_by_label,
    summary_rollup,
    used_tokens,
)
from ..operators.span_tables import resolve_span_table
from ..operators.tables import anonymize_nested, anonymize_table, pseudonymize_table
from ..sources.files import anonymize_files
from ..sources.formats import admit, detect_format
from ..sources.readers import read_checked_docs, read_csv_table, read_json_docs, read_text_docs, spread
from ..sources.rules_table import drop_exempt_spans, load_rules, rules_status
from ..sources.sinks import write_files, write_result
from ..streaming.stream import anonymize_stream, pseudonymize_batches
from . import oracle as o
from .inputs import CELLS_SQL, EXTERNAL_SQL, SPANS_SQL, TEXTS_SQL, derive, partitions, table, texts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEY = ["tbl", "id"]
HASH_KEY = b"a key for tests only"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def _span_rows(df: DataFrame, *key: str) -> DataFrame:
    """Spans under column names that need no quoting in SQL."""
    return df.select(
        *key,
        "label",
        F.col("start").cast("long").alias("start_pos"),
        F.col("end").cast("long").alias("end_pos"),
        F.col("text").alias("value"),
    )


_ROWS = "label, CAST(s AS BIGINT) AS start_pos, CAST(e AS BIGINT) AS end_pos, x AS value"
_SRC = f"src AS (SELECT tbl, id, grp, text AS t FROM ({TEXTS_SQL}))"
_NORM = f"SELECT tbl, id, grp, {o.normalized('text')} AS t FROM ({TEXTS_SQL})"

# ------------------------------------------------------------------ detectors


def _detector(name: str, label: str) -> None:
    @query(name, f"WITH {_SRC}, raw AS ({o.raw('src', label)}) SELECT tbl, id, {_ROWS} FROM raw")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = texts(spark, sf_dir).select(*KEY, F.inline(expr(detect_label("text", label))))
        return _span_rows(found, *KEY)


for _name, _label in (
    ("detect_email", "EMAIL"),
    ("detect_url", "URL"),
    ("detect_ipv4", "IPV4"),
    ("detect_secret", "SECRET"),
    ("detect_card", "CREDIT_CARD"),
    ("detect_phone", "PHONE"),
    ("detect_cuit", "AR_CUIT"),
    ("detect_cbu", "AR_CBU"),
    ("detect_dni", "AR_DNI"),
):
    _detector(_name, _label)


@query("detect_docs", f"WITH {o.spans(f'SELECT tbl, id, grp, text AS t FROM ({TEXTS_SQL})')} SELECT tbl, id, {_ROWS} FROM spans")
def _detect_docs(spark, sf_dir):
    return _span_rows(detect_docs(texts(spark, sf_dir), KEY), *KEY)


@query("raw_spans", f"WITH {_SRC}, raw AS ({o.raw('src')}) SELECT tbl, id, {_ROWS} FROM raw")
def _raw_spans(spark, sf_dir):
    return _span_rows(texts(spark, sf_dir).select(*KEY, F.inline(expr(raw_pii("text")))), *KEY)


# ------------------------------------------------------------------ validators, text, labels

_NUMBERS = """select o_orderkey as id, case when o_orderkey % 4 = 0 then cast(o_orderkey * 7919 as string)
    else concat('4', lpad(cast(o_orderkey * 104729 as string), cast(13 + o_orderkey % 4 as int), '51')) end as card,
    concat('2', cast(o_orderkey % 10 as string), '-', lpad(cast(o_orderkey * 7919 % 100000000 as string), 8, '0'), '-',
    cast(o_custkey % 10 as string)) as cuit, concat('+', cast(o_custkey as string), ' ', cast(o_orderkey as string)) as phone
    from orders"""


@query("luhn_ok", f"SELECT id, card, {o.luhn('card')} AS ok FROM ({_NUMBERS})")
def _luhn(spark, sf_dir):
    return derive(spark, sf_dir, _NUMBERS, "id").select("id", "card", expr(luhn_ok("card")).alias("ok"))


@query("cuit_ok", f"SELECT id, cuit, {o.cuit('cuit')} AS ok FROM ({_NUMBERS})")
def _cuit(spark, sf_dir):
    return derive(spark, sf_dir, _NUMBERS, "id").select("id", "cuit", expr(cuit_ok("cuit")).alias("ok"))


@query("phone_ok", f"SELECT id, phone, {o.phone('phone')} AS ok FROM ({_NUMBERS})")
def _phone(spark, sf_dir):
    return derive(spark, sf_dir, _NUMBERS, "id").select("id", "phone", expr(phone_ok("phone")).alias("ok"))


_BROKEN = f"select tbl, id, replace(text, 'e ', concat('- ', chr(10), '  ')) as text from ({TEXTS_SQL}) b"


@query("normalize_text", f"SELECT tbl, id, {o.normalized('text')} AS normal FROM ({_BROKEN})")
def _normalize(spark, sf_dir):
    broken = derive(spark, sf_dir, _BROKEN, "id")
    return broken.select(*KEY, expr(normalize_text("text")).alias("normal"))


_LABELS = """select case o_orderkey % 18 when 0 then 'EMAIL' when 1 then 'PHONE' when 2 then 'PERSON' when 3 then 'ADDRESS'
    when 4 then 'AR_DNI' when 5 then 'AR_CUIT' when 6 then 'AR_CBU' when 7 then 'CREDIT_CARD' when 8 then 'ACCOUNT'
    when 9 then 'URL' when 10 then 'DATE' when 11 then 'SECRET' when 12 then 'IPV4' when 13 then 'CUSTOM'
    when 14 then cast(o_orderkey as string) else o_orderpriority end as label from orders"""


@query("type_of", f"SELECT label, {o.type_of('label')} AS type, count(*) AS n FROM ({_LABELS}) GROUP BY ALL")
def _type_of(spark, sf_dir):
    labels = derive(spark, sf_dir, _LABELS).groupBy("label").agg(F.count("*").alias("n"))
    return labels.select("label", expr(type_of("label")).alias("type"), "n")


@query(
    "placeholder_of",
    f"SELECT label, {o.placeholder_of('label')} AS placeholder, count(*) AS n FROM ({_LABELS}) GROUP BY ALL",
)
def _placeholder_of(spark, sf_dir):
    labels = derive(spark, sf_dir, _LABELS).groupBy("label").agg(F.count("*").alias("n"))
    return labels.select("label", expr(placeholder_of("label")).alias("placeholder"), "n")


_NAMES = """select o_orderkey as id, concat('f', cast(o_orderkey as string), case o_orderkey % 9 when 0 then '.txt'
    when 1 then '.CSV' when 2 then '.json' when 3 then '.tar.gz' when 4 then '' when 5 then '.html' when 6 then '.Md'
    when 7 then '.' else '.csv.log' end) as name from orders"""


@query(
    "detect_format",
    f"""SELECT id, name, CASE WHEN list_contains(['txt', 'md', 'log', 'srt', 'html', 'htm', 'csv', 'json'], ext)
        THEN ext ELSE 'txt' END AS format FROM (SELECT *, lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS ext FROM ({_NAMES}))""",
)
def _detect_format(spark, sf_dir):
    return derive(spark, sf_dir, _NAMES).select("id", "name", expr(detect_format("name")).alias("format"))


# ------------------------------------------------------------------ span algebra


@query(
    "resolve_overlaps",
    f"""WITH cand AS (SELECT *, CAST(start AS BIGINT) AS s, CAST(finish AS BIGINT) AS e FROM ({SPANS_SQL})),
    sorted AS (SELECT doc_id, list({{'label': label, 's': s, 'e': e}} ORDER BY e - s DESC, {o.weight('label', o.PRIORITY)} DESC, s, ord, label) AS l
        FROM cand WHERE e > s GROUP BY doc_id),
    kept AS (SELECT doc_id, unnest(list_reduce(l, lambda a, y: CASE WHEN len(list_filter(a, lambda z: z.s < y.e AND z.e > y.s)) > 0
        THEN a ELSE list_append(a, y) END, [])) AS k FROM sorted)
    SELECT doc_id, k.label AS label, k.s AS start_pos, k.e AS end_pos, CAST(NULL AS VARCHAR) AS value FROM kept""",
)
def _resolve(spark, sf_dir):
    spans = derive(spark, sf_dir, SPANS_SQL).withColumnRenamed("finish", "end").withColumn("text", F.lit(None).cast("string"))
    return _span_rows(resolve_span_table(spans, ["doc_id"], PRIORITY), "doc_id")


_GIVEN = """select 'documents' as tbl, doc_id as id, source as grp, text as t from documents"""
_FIRST_WORD = f"""given AS ({_GIVEN}), found AS (SELECT tbl, id, 'PERSON' AS label, CAST(0 AS BIGINT) AS s,
    CAST(length(split_part(t, ' ', 1)) AS BIGINT) AS e, split_part(t, ' ', 1) AS x, 0 AS ord FROM given)"""


def _first_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), partitions(spark), "doc_id")
    word = "split_part(text, ' ', 1)"
    return docs.withColumn("found", expr(f"array({span(chr(39) + 'PERSON' + chr(39), '0', f'length({word})', word)})"))


@query(
    "propagate_spans",
    f"""WITH {_FIRST_WORD},{o.finalize('given', 'found', {}, '')} SELECT id AS doc_id, label, s AS start_pos, e AS end_pos, x AS value FROM found
    UNION ALL SELECT id, label, s, s + length(x), x FROM more WHERE (id) IN (SELECT id FROM occ WHERE len(p) > 2)""",
)
def _propagate(spark, sf_dir):
    spans = _first_word(spark, sf_dir).select("doc_id", F.inline(expr(propagate_spans("text", "found"))))
    return _span_rows(spans, "doc_id")


@query(
    "finalize_spans",
    f"WITH {_FIRST_WORD},{o.finalize('given', 'found', {}, '')} SELECT id AS doc_id, {_ROWS} FROM spans",
)
def _finalize(spark, sf_dir):
    spans = _first_word(spark, sf_dir).select("doc_id", F.inline(expr(finalize_spans("text", "found", {}))))
    return _span_rows(spans, "doc_id")


@query(
    "apply_replacements",
    f"WITH {_FIRST_WORD} SELECT id AS doc_id, '[' || label || ']' || substring(t, e + 1) AS output FROM found JOIN given USING (tbl, id)",
)
def _apply(spark, sf_dir):
    output = apply_replacements("text", "found", lambda s, i: f"concat('[', {s}.label, ']')")
    return _first_word(spark, sf_dir).select("doc_id", expr(output).alias("output"))


# ------------------------------------------------------------------ modes

_SPANS = f"WITH {o.spans(_NORM)}"
# the first label a text has in its row decides, in every mode
_LABELLED = """labelled AS (SELECT *, first_value(label) OVER (PARTITION BY tbl, id, x ORDER BY s) AS first_label,
    min(s) OVER (PARTITION BY tbl, id, x) AS first_s FROM spans)"""
_TYPE = o.type_of("first_label")
_NUMBERED = f"""numbered AS (SELECT *, '«' || y || '_' || dense_rank() OVER (PARTITION BY tbl, id, y ORDER BY first_s) || '»' AS token
    FROM (SELECT *, {_TYPE} AS y FROM labelled))"""


def _mode_sql(token: str) -> str:
    return f"{_SPANS}, {_LABELLED}, typed AS (SELECT *, {_TYPE} AS y FROM labelled) {o.replaced('typed', 'src', token)}"


def _anonymized(spark: SparkSession, sf_dir: str, mode: str, **options) -> DataFrame:
    return anonymize_docs(texts(spark, sf_dir), mode, key=KEY, **options)


@query("anonymize_typed", _mode_sql("'[' || y || ']'"))
def _typed(spark, sf_dir):
    return _anonymized(spark, sf_dir, "typed").select(*KEY, "output")


@query("anonymize_anon", _mode_sql("'<<ANOM_DATA>>'"))
def _anon(spark, sf_dir):
    return _anonymized(spark, sf_dir, "anon").select(*KEY, "output")


@query("anonymize_mask", _mode_sql(o.mask("x", "y")))
def _mask(spark, sf_dir):
    return _anonymized(spark, sf_dir, "mask").select(*KEY, "output")


@query("anonymize_hash", _mode_sql(o.hashed("x", "y", hmac_pads(HASH_KEY))))
def _hash(spark, sf_dir):
    return _anonymized(spark, sf_dir, "hash", hash_key=HASH_KEY).select(*KEY, "output")


@query("anonymize_off", f"SELECT tbl, id, text AS output FROM ({TEXTS_SQL})")
def _off(spark, sf_dir):
    return _anonymized(spark, sf_dir, "off").select(*KEY, "output")


@query("anonymize_pseudo", f"{_SPANS}, {_LABELLED}, {_NUMBERED} {o.replaced('numbered', 'src', 'token')}")
def _pseudo(spark, sf_dir):
    return _anonymized(spark, sf_dir, "pseudo").select(*KEY, "output")


@query("reversal_map", f"{_SPANS}, {_LABELLED}, {_NUMBERED} SELECT DISTINCT tbl, id, token, x AS original FROM numbered")
def _reversal_map(spark, sf_dir):
    return used_tokens(_anonymized(spark, sf_dir, "pseudo"), KEY)


# pseudonymized texts, the tokens in them, and the texts with the originals back in place
_RESTORED = f"""{_SPANS}, {_LABELLED}, {_NUMBERED}, hidden AS (SELECT tbl, id, output AS t FROM ({o.replaced('numbered', 'src', 'token')})),
    seen AS ({o.matches('hidden', 'TOKEN', 't', '', '«[A-Z]+_[0-9A-Za-z]+»', 0)}),
    known AS (SELECT DISTINCT tbl, id, token AS x, x AS original FROM numbered),
    answered AS (SELECT seen.*, coalesce(original, x) AS original FROM seen LEFT JOIN known USING (tbl, id, x)),
    back AS ({o.replaced('answered', 'hidden', 'original', output='restored')})"""


@query("deanonymize_rows", f"{_RESTORED} SELECT tbl, id, restored FROM back")
def _deanonymize_rows(spark, sf_dir):
    return deanonymize_rows(_anonymized(spark, sf_dir, "pseudo")).select(*KEY, "restored")


@query(
    "redact_placeholder",
    f"""WITH {o.spans(f'SELECT tbl, id, grp, text AS t FROM ({TEXTS_SQL})')}
    {o.replaced('spans', 'src', o.placeholder_of('label'))}""",
)
def _redact_placeholder(spark, sf_dir):
    return redact_placeholder(texts(spark, sf_dir), key=KEY).select(*KEY, "output")


# ------------------------------------------------------------------ tables and scopes

_CELL_SRC = f"""SELECT 'contact' AS tbl, id, grp, 0 AS leaf, contact AS t FROM ({CELLS_SQL})
    UNION ALL SELECT 'memo', id, grp, 1, memo FROM ({CELLS_SQL})"""


def _scoped_sql(scope: str, result: str) -> str:
    """CTEs that number the values of each scope, then ``result`` over src and tokened."""
    over = f"PARTITION BY {scope}, " if scope else "PARTITION BY "
    return f"""WITH {o.spans(_CELL_SRC)},
    placed AS (SELECT s.*, d.grp, d.leaf FROM spans s JOIN src d USING (tbl, id)),
    labelled AS (SELECT *, first_value(label) OVER ({over} x ORDER BY id, leaf, s) AS first_label,
        min((id, leaf, s)) OVER ({over} x) AS pos0 FROM placed),
    typed AS (SELECT *, {_TYPE} AS y FROM labelled),
    tokened AS (SELECT *, '«' || y || '_' || dense_rank() OVER ({over} y ORDER BY pos0) || '»' AS token FROM typed),
    done AS ({o.replaced('tokened', 'src', 'token')}) {result}"""


_BOTH = """SELECT c.id, c.output AS contact, m.output AS memo FROM done c JOIN done m ON c.id = m.id AND c.tbl = 'contact' AND m.tbl = 'memo'"""
_CELLS = ["contact", "memo"]


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, CELLS_SQL, "id")


@query("pseudonymize_table", _scoped_sql("", _BOTH))
def _pseudonymize_table(spark, sf_dir):
    done = pseudonymize_table(_cells(spark, sf_dir), columns=_CELLS, order_by=["id"])
    return done.data.select("id", *_CELLS)


@query("pseudonymize_groups", _scoped_sql("grp", _BOTH))
def _pseudonymize_groups(spark, sf_dir):
    done = pseudonymize_table(_cells(spark, sf_dir), columns=_CELLS, order_by=["id"], scope=["grp"])
    return done.data.select("id", *_CELLS)


@query("table_map", _scoped_sql("", "SELECT DISTINCT token, x AS original FROM tokened"))
def _table_map(spark, sf_dir):
    return pseudonymize_table(_cells(spark, sf_dir), columns=_CELLS, order_by=["id"]).mapping


@query("deanonymize", f"SELECT id, contact, memo FROM ({CELLS_SQL})")
def _deanonymize(spark, sf_dir):
    done = pseudonymize_table(_cells(spark, sf_dir), columns=_CELLS, order_by=["id"])
    stored = durable(done.data.select("id", *_CELLS))  # as the table a later job would read
    return deanonymize(stored, done.mapping, key=["id"], text=_CELLS)


@query("anonymize_table", f"""WITH {o.spans(_CELL_SRC)}, done AS ({o.replaced('spans', 'src', o.mask('x', o.type_of('label')))}) {_BOTH}""")
def _anonymize_table(spark, sf_dir):
    done = anonymize_table(_cells(spark, sf_dir), "mask", columns=_CELLS, scope="row", order_by=["id"])
    return done.data.select("id", *_CELLS)


_MASKED_CELLS = ORACLES["anonymize_table"]


def _with_odd_key(df: DataFrame) -> DataFrame:
    """A key ``k`` that is null in a third of the rows and repeated in the others."""
    return df.withColumn("k", expr("if(id % 3 = 0, null, id div 4)"))


@query("mask_nullable", _MASKED_CELLS)
def _mask_nullable(spark, sf_dir):
    done = anonymize_table(_with_odd_key(_cells(spark, sf_dir)), "mask", columns=_CELLS, order_by=["k"])
    return done.data.select("id", *_CELLS)


@query("pseudonymize_nullable", f"SELECT id, contact, memo FROM ({CELLS_SQL})")
def _pseudonymize_nullable(spark, sf_dir):
    """There and back again; the numbers of rows with equal keys are not SQL's to tell."""
    done = pseudonymize_table(_with_odd_key(_cells(spark, sf_dir)), columns=_CELLS, order_by=["k"])
    hidden = durable(done.data.select("id", "k", *_CELLS))
    return deanonymize(hidden, done.mapping, key=["k"], text=_CELLS).select("id", *_CELLS)


@query("write_table", _scoped_sql("", _BOTH))
def _write_table(spark, sf_dir):
    folder = shared_folder(spark, "written")
    done = pseudonymize_table(_cells(spark, sf_dir), columns=_CELLS, order_by=["id"])
    write_result(done, f"{folder}/data", f"{folder}/map", f"{folder}/summary")
    return spark.read.parquet(f"{folder}/data").select("id", *_CELLS)


@query("write_rows", f"SELECT * FROM ({_MASKED_CELLS})")
def _write_rows(spark, sf_dir):
    """Row scope: data, map and summary are taken from one detection."""
    folder = shared_folder(spark, "written")
    done = anonymize_table(_cells(spark, sf_dir).select("id", *_CELLS), "mask", columns=_CELLS, scope="row", order_by=["id"])
    write_result(done, f"{folder}/data", f"{folder}/map", f"{folder}/summary")
    return spark.read.parquet(f"{folder}/data")


@query("csv_table", _MASKED_CELLS)
def _csv_table(spark, sf_dir):
    folder = shared_folder(spark, "csv")
    _cells(spark, sf_dir).select("id", *_CELLS).write.option("escape", '"').csv(folder)
    rows = read_csv_table(spark, folder, 3).rows
    done = anonymize_table(rows, "mask", columns=["c1", "c2"], scope=["path"], order_by=["path", "row"]).data
    return done.select(F.col("c0").cast("long").alias("id"), F.coalesce("c1", F.lit("")).alias("contact"), F.coalesce("c2", F.lit("")).alias("memo"))


@query("json_docs", f"SELECT * FROM ({_MASKED_CELLS}) WHERE id % 7 <> 0")
def _json_docs(spark, sf_dir):
    """Every seventh line has a key that the schema does not name, and is rejected."""
    folder = shared_folder(spark, "json")
    lines = _cells(spark, sf_dir).select("id", *_CELLS, expr("if(id % 7 = 0, id, null)").alias("more"))
    lines.select(F.to_json(F.struct("*")).alias("value")).write.text(folder)
    rows = read_json_docs(spark, folder, "id bigint, contact string, memo string").rows
    done = anonymize_table(rows, "mask", columns=["value"], scope="row").data
    return done.select("value.id", "value.contact", "value.memo")


#: Files that one task writes: a file costs the file system some milliseconds, whatever its size.
_FILES_A_TASK = 500


def _write_each(rows: DataFrame, folder: str) -> None:
    """One text file for each ``id``, under ``id=...``; rows of one id share a task and so a file.

    A small table arrives in one task, which would write all files, so the rows are dealt by their number.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // _FILES_A_TASK))
    rows.repartition(tasks, "id").write.partitionBy("id").text(folder)


_SUPPLIERS = "select s_suppkey as id, concat('mail s', cast(s_suppkey as varchar(20)), '@x.example.com', chr(10), 'fin') as text from supplier"


@query("text_docs", "SELECT CAST(id AS BIGINT) AS id, replace(text, 's' || id || '@x.example.com', '[EMAIL]') || chr(10) AS output FROM (" + _SUPPLIERS + ")")
def _text_docs(spark, sf_dir):
    """One file per supplier, of two lines."""
    folder = shared_folder(spark, "text")
    suppliers = spark.sql(_SUPPLIERS.replace("from supplier", "from {supplier}"), supplier=table(spark, sf_dir, "supplier"))
    _write_each(suppliers, folder)
    docs = read_text_docs(spark, f"{folder}/*/*.txt")
    done = anonymize_docs(docs, "typed", key=["path"], normalize=False)
    return done.select(F.regexp_extract("path", r"id=(\d+)/", 1).cast("long").alias("id"), "output")


@query(
    "text_docs_checked",
    f"""SELECT CAST(id AS BIGINT) AS id, CASE WHEN id % 5 <> 0 THEN replace(text, 's' || id || '@x.example.com', '[EMAIL]') || chr(10) END AS output,
    CASE WHEN id % 5 = 0 THEN 'encoding' END AS reason FROM ({_SUPPLIERS})""",
)
def _text_docs_checked(spark, sf_dir):
    """One file per supplier; every fifth has a byte that is no UTF-8, and is rejected."""
    folder = shared_folder(spark, "text")
    suppliers = spark.sql(_SUPPLIERS.replace("from supplier", "from {supplier}"), supplier=table(spark, sf_dir, "supplier"))
    broken = F.when(F.col("id") % 5 == 0, F.concat("text", F.unhex(F.lit("FF")).cast("string"))).otherwise(F.col("text"))
    _write_each(suppliers.withColumn("text", broken), folder)
    read = read_checked_docs(spark, f"{folder}/*/*.txt")
    done = anonymize_docs(read.rows, "typed", key=["path"], normalize=False).select("path", "output", F.lit(None).cast("string").alias("reason"))
    every = done.unionByName(read.rejected.select("path", F.lit(None).cast("string").alias("output"), "reason"))
    return every.select(F.regexp_extract("path", r"id=(\d+)/", 1).cast("long").alias("id"), "output", "reason")


_STATUS_SQL = """select s_suppkey as k, case s_suppkey % 4 when 0 then concat('([', cast(s_suppkey as varchar(20)))
    when 1 then concat('key-', cast(s_suppkey as varchar(20))) when 2 then concat('(x|', cast(s_suppkey as varchar(20)), ')')
    else concat(repeat('b', 250), cast(s_suppkey as varchar(20))) end as regex from supplier"""


@query(
    "rules_status",
    f"""SELECT regex, k % 4 <> 0 AS accepted, k % 4 = 2 AS timed, CASE WHEN k % 4 = 0 THEN 'not a regex' ELSE '' END AS reason
    FROM ({_STATUS_SQL})""",
)
def _rules_status(spark, sf_dir):
    rows = spark.sql(_STATUS_SQL.replace("from supplier", "from {supplier}"), supplier=table(spark, sf_dir, "supplier"))
    return rules_status(spark, rows).withColumn("reason", expr("split_part(reason, ':', 1)"))


_NESTED_SQL = f"""WITH {o.spans(_CELL_SRC)},
    labelled AS (SELECT s.*, first_value(label) OVER (PARTITION BY id, x ORDER BY leaf, s) AS first_label,
        min((leaf, s)) OVER (PARTITION BY id, x) AS pos0 FROM spans s JOIN (SELECT tbl, id, leaf FROM src) USING (tbl, id)),
    typed AS (SELECT *, {_TYPE} AS y FROM labelled),
    tokened AS (SELECT *, '«' || y || '_' || dense_rank() OVER (PARTITION BY id, y ORDER BY pos0) || '»' AS token FROM typed),
    done AS ({o.replaced('tokened', 'src', 'token')}),
    pair AS ({_BOTH})
    SELECT id, contact AS mail, memo AS note, contact AS again, CAST(id + 1 AS BIGINT) AS item FROM pair"""


@query("anonymize_nested", _NESTED_SQL)
def _anonymize_nested(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    nested = cells.select(
        "id",
        expr(
            "named_struct('user', named_struct('email', contact, 'age', 7), 'items', array(id, id + 1),"
            " 'notes', array(memo, cast(null as string)), 'extra', map(contact, contact))"
        ).alias("doc"),
    )
    done = anonymize_nested(nested, ["doc"], scope="row", order_by=["id"]).data
    return done.select(
        "id",
        F.col("doc.user.email").alias("mail"),
        F.col("doc.notes")[0].alias("note"),
        F.map_values("doc.extra")[0].alias("again"),
        F.col("doc.items")[1].alias("item"),
    )


# ------------------------------------------------------------------ rules

_NEVER = ["user1@mail.example.com", "USER2@MAIL.EXAMPLE.COM", " 10.1.3.2 ", "12.34"]
_ALWAYS = ["Sin Datos", "llamar"]
_PATTERNS = [{"regex": r"cuenta 3{10,}", "placeholder": "Legajo"}, {"regex": r"1[0-9]{2,3}\.2"}, {"regex": "([a-z"}]
_RULES = {"always": _ALWAYS, "never": _NEVER, "patterns": _PATTERNS}
_TEXT_CELLS = f"SELECT 'memo' AS tbl, id, grp, memo AS t FROM ({CELLS_SQL})"
_FOLDED = ", ".join(f"'{n.strip().lower()}'" for n in _NEVER)


def _memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select(F.lit("memo").alias("tbl"), "id", F.col("memo").alias("text"))


def _match_sql(label: str, pattern: str, order: int) -> str:
    return o.matches("src", label, "t", "", pattern, order)


_CUSTOM = "\nUNION ALL ".join(
    f"SELECT * FROM ({part})"
    for part in (
        _match_sql("CUSTOM", "(?i)Sin Datos", 0),
        _match_sql("CUSTOM", "(?i)llamar", 1),
        _match_sql("LEGAJO", r"cuenta 3{10,}", 2),
        _match_sql("CUSTOM", r"1[0-9]{2,3}\.2", 3),
    )
)


@query(
    "rules_never",
    f"WITH {o.spans(_TEXT_CELLS)} SELECT tbl, id, {_ROWS} FROM spans WHERE lower(trim(x)) NOT IN ({_FOLDED})",
)
def _rules_never(spark, sf_dir):
    spans = detect_docs(_memo(spark, sf_dir), KEY)
    never = spark.createDataFrame([(n,) for n in _NEVER], "term string")
    return _span_rows(drop_exempt_spans(spans, never), *KEY)


def _rules_sql(never: str, custom: str) -> str:
    kept = f"SELECT tbl, id, label, s, e, x, -1 AS ord FROM spans WHERE {never} UNION ALL SELECT * FROM ({custom})"
    final = o.finalize("src", "ruled", o.CUSTOM_PRIORITY, "r_")
    return f"WITH {o.spans(_TEXT_CELLS)}, ruled AS ({kept}),{final} SELECT tbl, id, {_ROWS} FROM r_spans"


_ONLY_TERMS = " UNION ALL ".join(
    f"SELECT * FROM ({p})" for p in (_match_sql("CUSTOM", "(?i)Sin Datos", 0), _match_sql("CUSTOM", "(?i)llamar", 1))
)


@query("rules_always", _rules_sql("true", _ONLY_TERMS))
def _rules_always(spark, sf_dir):
    return _span_rows(detect_docs(_memo(spark, sf_dir), KEY, rules={"always": _ALWAYS}), *KEY)


# every customer's name is a term; a memo names the customer of its order, in other cases, and some other text
_NAMES_SQL = """select o_orderkey as id, case when o_orderkey % 4 = 0 then 'sin datos' when o_orderkey % 4 = 1 then concat('de ', upper(c_name), ' a ', lower(c_name), '.')
    when o_orderkey % 4 = 2 then concat('x', c_name, 'y user', cast(c_custkey as string), '@mail.example.com') else concat(substr(c_name, 1, 17), ' ', cast(c_custkey as string)) end as memo
    from orders join customer on o_custkey = c_custkey"""
_NAMES_CTE = f"""src AS (SELECT 'memo' AS tbl, id, 'x' AS grp, memo AS t FROM ({_NAMES_SQL})), wanted AS (SELECT DISTINCT lower(c_name) AS w FROM customer),
    cut AS (SELECT tbl, id, t, unnest(range(0, length(t) - 17)) AS s FROM src)"""


@query(
    "rules_always_table",
    f"""WITH {_NAMES_CTE}, {o.spans("SELECT * FROM src", "b_")},
    ruled AS (SELECT tbl, id, label, s, e, x, -1 AS ord FROM b_spans UNION ALL
        SELECT tbl, id, 'CUSTOM', CAST(s AS BIGINT), CAST(s + 18 AS BIGINT), substring(t, s + 1, 18), 0 FROM cut JOIN wanted ON lower(substring(t, s + 1, 18)) = w),
    {o.finalize('src', 'ruled', o.CUSTOM_PRIORITY, 'r_')} SELECT tbl, id, {_ROWS} FROM r_spans""",
)
def _rules_always_table(spark, sf_dir):
    """All customer names as terms: a table, of which nothing is read to the driver."""
    sql = _NAMES_SQL.replace("from orders join customer", "from {orders} join {customer}")
    memos = spark.sql(sql, orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer").hint("merge"))
    docs = spread(memos, partitions(spark), "id").select(F.lit("memo").alias("tbl"), "id", F.col("memo").alias("text"))
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("term"))
    return _span_rows(detect_docs(docs, KEY, always=names), *KEY)


_ONLY_PATTERNS = " UNION ALL ".join(
    f"SELECT * FROM ({p})" for p in (_match_sql("LEGAJO", r"cuenta 3{10,}", 0), _match_sql("CUSTOM", r"1[0-9]{2,3}\.2", 1))
)


@query("rules_patterns", _rules_sql("true", _ONLY_PATTERNS))
def _rules_patterns(spark, sf_dir):
    return _span_rows(detect_docs(_memo(spark, sf_dir), KEY, rules={"patterns": _PATTERNS}), *KEY)


@query("apply_rules", _rules_sql(f"lower(trim(x)) NOT IN ({_FOLDED})", _CUSTOM))
def _apply_rules(spark, sf_dir):
    return _span_rows(detect_docs(_memo(spark, sf_dir), KEY, rules=_RULES), *KEY)


# patterns outside the plain subset run in Python with a time limit
_TIMED = [{"regex": r"(?:user|cuenta) ?\d+\b", "placeholder": "Cuenta"}, {"regex": "(a|a)+$"}]


@query("rules_patterns_timed", _rules_sql("true", _match_sql("CUENTA", r"(?:user|cuenta) ?\d+\b", 0)))
def _rules_timed(spark, sf_dir):
    return _span_rows(detect_docs(_memo(spark, sf_dir), KEY, rules={"patterns": _TIMED}), *KEY)


_ENTRIES = """select o_orderkey as id, concat(' a', cast(o_custkey as string), ' , ,b,', o_orderpriority) as always,
    case when o_orderkey % 3 = 0 then '' else concat('x,', cast(o_orderkey as string), ',') end as never,
    case o_orderkey % 4 when 0 then concat('[{"regex": "r', cast(o_custkey as string), '", "placeholder": "ID"}, {"regex": 5}, {"a": 1}]')
        when 1 then concat('{"patterns": [{"regex": "q', cast(o_custkey as string), '"}]}') when 2 then 'no json' else '' end as patterns
    from orders"""


@query(
    "load_rules",
    f"""SELECT id, array_to_string(list_filter(list_transform(string_split(always, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS always,
    array_to_string(list_filter(list_transform(string_split(never, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS never,
    CASE id % 4 WHEN 0 THEN regexp_extract(patterns, '"(r\\d+)"', 1) || '=ID' WHEN 1 THEN regexp_extract(patterns, '"(q\\d+)"', 1) || '=' ELSE '' END AS patterns
    FROM ({_ENTRIES})""",
)
def _load_rules(spark, sf_dir):
    loaded = load_rules(derive(spark, sf_dir, _ENTRIES))
    shown = F.transform("patterns", lambda p: F.concat(p["regex"], F.lit("="), F.coalesce(p["placeholder"], F.lit(""))))
    return loaded.select(
        "id",
        F.array_join("always", "|").alias("always"),
        F.array_join("never", "|").alias("never"),
        F.array_join(shown, "|").alias("patterns"),
    )


# ------------------------------------------------------------------ external spans


def _external(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), partitions(spark), "doc_id")
    return docs, derive(spark, sf_dir, EXTERNAL_SQL).withColumnRenamed("finish", "end")


_EXTERNAL_CTE = f"""given AS ({_GIVEN}), found AS (SELECT 'documents' AS tbl, doc_id AS id, {o.label_of('placeholder', 'label')} AS label,
    CAST(start AS BIGINT) AS s, CAST(finish AS BIGINT) AS e, coalesce(m.text, substring(t, start + 1, finish - start)) AS x, 0 AS ord
    FROM ({EXTERNAL_SQL}) m JOIN given ON doc_id = id),{o.finalize('given', 'found', {}, '')}"""


@query("ingest_external_spans", f"WITH {_EXTERNAL_CTE} SELECT id AS doc_id, {_ROWS} FROM spans")
def _ingest(spark, sf_dir):
    docs, external = _external(spark, sf_dir)
    return _span_rows(explode_spans(ingest_external_spans(docs, external), ["doc_id"]), "doc_id")


@query(
    "choose_spans",
    f"""WITH {_EXTERNAL_CTE}, {o.spans(_GIVEN, 'b_')} SELECT 'ml' AS engine, id AS doc_id, {_ROWS} FROM spans
    UNION ALL SELECT 'lite', id, {_ROWS} FROM b_spans""",
)
def _choose(spark, sf_dir):
    docs, external = _external(spark, sf_dir)
    both = [
        explode_spans(choose_spans(docs, engine=name, external=external), ["engine", "doc_id"]) for name in ("ml", "lite")
    ]
    return _span_rows(both[0].unionByName(both[1]), "engine", "doc_id")


# ------------------------------------------------------------------ pages, reports, checks


def _redacted_sql(ctes: str, src: str) -> str:
    return f"""WITH {ctes},
    hit AS (SELECT tbl, id, string_split(t, x) AS p, x FROM (SELECT DISTINCT tbl, id, x FROM spans WHERE trim(x) <> '') JOIN {src} USING (tbl, id)),
    pos AS (SELECT tbl, id, CAST(list_sum(list_transform(p[1:j], lambda y: length(y))) + (j - 1) * length(x) AS BIGINT) AS s, length(x) AS n
        FROM (SELECT *, unnest(range(1, len(p))) AS j FROM hit)),
    reach AS (SELECT *, max(s + n) OVER (PARTITION BY tbl, id ORDER BY s, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM pos),
    isle AS (SELECT *, sum(CASE WHEN before IS NULL OR s >= before THEN 1 ELSE 0 END) OVER (PARTITION BY tbl, id ORDER BY s, n) AS i FROM reach),
    area AS (SELECT tbl, id, min(s) AS s, max(s + n) AS e FROM isle GROUP BY tbl, id, i),
    total AS (SELECT tbl, id, count(*) AS redactions FROM pos GROUP BY tbl, id)
    SELECT r.tbl, r.id, r.output AS redacted, CAST(coalesce(redactions, 0) AS BIGINT) AS redactions
    FROM ({o.replaced('area', src, "repeat('█', CAST(e - s AS BIGINT))")}) r LEFT JOIN total USING (tbl, id)"""


@query("redact_pages", _redacted_sql(o.spans(f"SELECT tbl, id, grp, text AS t FROM ({TEXTS_SQL})"), "src"))
def _redact_pages(spark, sf_dir):
    redacted = redact_pages(texts(spark, sf_dir))
    return redacted.select(*KEY, "redacted", F.col("redactions").cast("long").alias("redactions"))


@query("pages_external", f"SELECT id AS doc_id, redacted, redactions FROM ({_redacted_sql(_EXTERNAL_CTE, 'given')})")
def _pages_external(spark, sf_dir):
    docs, external = _external(spark, sf_dir)
    redacted = redact_pages(docs, external=external, engine="ml", key=["doc_id"])
    return redacted.select("doc_id", "redacted", F.col("redactions").cast("long").alias("redactions"))


@query(
    "files_external",
    f"WITH {_EXTERNAL_CTE} SELECT id AS doc_id, 'ml' AS engine, output AS content FROM ({o.replaced('spans', 'given', o.mask('x', o.type_of('label')))})",
)
def _files_external(spark, sf_dir):
    docs, external = _external(spark, sf_dir)
    path = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    files = docs.select(path.alias("path"), F.encode("text", "utf-8").alias("content"))
    given = external.withColumn("path", path).withColumn("leaf", F.lit(0))
    done = anonymize_files(files, "mask", external=given).accepted
    return done.select(F.split_part("path", F.lit("."), F.lit(1)).cast("long").alias("doc_id"), "engine", "content")


@query(
    "write_files",
    f"""WITH {o.spans(_GIVEN)} SELECT d.id AS doc_id, d.output AS content, CAST(coalesce(n, 0) AS BIGINT) AS findings
    FROM ({o.replaced('spans', 'src', o.mask('x', o.type_of('label')))}) d LEFT JOIN (SELECT id, count(*) AS n FROM spans GROUP BY id) USING (id)""",
)
def _write_files(spark, sf_dir):
    """Contents, map, counts and files not taken, each in a place of its own."""
    docs, _ = _external(spark, sf_dir)
    files = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "utf-8").alias("content"))
    folder = shared_folder(spark, "files")
    where = [f"{folder}/{name}" for name in ("data", "map", "summary", "rejected")]
    write_files(anonymize_files(files, "mask"), *where)
    counts = spark.read.parquet(where[2]).groupBy("path").agg(F.sum("n").cast("long").alias("findings"))
    done = spark.read.parquet(where[0]).join(counts, "path", "left")
    number = F.split_part("path", F.lit("."), F.lit(1)).cast("long").alias("doc_id")
    return done.select(number, "content", F.coalesce("findings", F.lit(0).cast("long")).alias("findings"))


@query(
    "table_external",
    f"WITH {_EXTERNAL_CTE} SELECT id AS doc_id, output AS text FROM ({o.replaced('spans', 'given', o.mask('x', o.type_of('label')))})",
)
def _table_external(spark, sf_dir):
    docs, external = _external(spark, sf_dir)
    given = external.withColumn("column", F.lit("text"))
    return anonymize_table(docs, "mask", columns=["text"], order_by=["doc_id"], external=given).data.select("doc_id", "text")


def _escape(text: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        text = f"replace({text}, '{char}', '{entity}')"
    return text


@query(
    "highlight_docs",
    f"""{_SPANS} {o.replaced('spans', 'src', "'<mark class=" + '"pii" title="' + "' || label || '" + '">' + "' || " + _escape('x') + " || '</mark>'", gap=_escape('{}'), output='html')}""",
)
def _highlight(spark, sf_dir):
    return highlight_docs(_anonymized(spark, sf_dir, "typed")).select(*KEY, "html")


@query("summary_by_label", f"{_SPANS} SELECT tbl, label, count(*) AS n FROM spans GROUP BY tbl, label")
def _summary(spark, sf_dir):
    docs = texts(spark, sf_dir).withColumn("text", expr(normalize_text("text")))
    return summary_by_label(detect_docs(docs, KEY), ["tbl"])


@query(
    "summary_rollup",
    f"""{_SPANS}, every AS (SELECT d.grp AS file, s.label FROM src d LEFT JOIN spans s USING (tbl, id))
    SELECT file, label, count(label) AS n, CAST(CASE WHEN grouping(file) = 1 THEN 3 ELSE grouping(label) END AS INT) AS level
    FROM every GROUP BY ROLLUP (file, label) HAVING grouping(label) = 1 OR label IS NOT NULL""",
)
def _rollup(spark, sf_dir):
    docs = _anonymized(spark, sf_dir, "typed").withColumnRenamed("grp", "file")
    return summary_rollup(docs, "file")


_MODE_TOKENS = {
    "typed": "'[' || y || ']'",
    "anon": "'<<ANOM_DATA>>'",
    "pseudo": "token",
    "mask": o.mask("x", "y"),
    "hash": o.hashed("x", "y", hmac_pads(HASH_KEY)),
}


def _leaks_sql(mode: str, token: str) -> str:
    return f"""SELECT '{mode}' AS mode, count(*) AS checked, count(*) FILTER (instr(output, x) > 0) AS leaks
        FROM ({o.replaced('numbered', 'src', token)}) JOIN spans USING (tbl, id)"""


@query(
    "leak_check",
    f"{_SPANS}, {_LABELLED}, {_NUMBERED} " + " UNION ALL ".join(_leaks_sql(m, t) for m, t in _MODE_TOKENS.items()),
)
def _leak_check(spark, sf_dir):
    scanned = texts(spark, sf_dir).withColumn("scanned", expr(normalize_text("text")))
    found = choose_spans(scanned, key=KEY, text="scanned")
    done = rewrite_found(found, list(_MODE_TOKENS), hash_key=HASH_KEY)
    return leak_counts(done, {mode: f"output_{mode}" for mode in _MODE_TOKENS})


@query(
    "roundtrip_check",
    f"{_RESTORED} SELECT count(*) AS changed FROM back JOIN src USING (tbl, id) WHERE restored IS DISTINCT FROM t",
)
def _roundtrip(spark, sf_dir):
    done = _anonymized(spark, sf_dir, "pseudo")
    return roundtrip_check(done, KEY).agg(F.count("*").alias("changed"))


@query(
    "consistency_check",
    _scoped_sql(
        "",
        """SELECT count(*) AS conflicts FROM (SELECT x FROM tokened GROUP BY x HAVING count(DISTINCT token) > 1
    UNION ALL SELECT token FROM tokened GROUP BY token HAVING count(DISTINCT x) > 1)""",
    ),
)
def _consistency(spark, sf_dir):
    done = pseudonymize_table(_cells(spark, sf_dir), columns=_CELLS, order_by=["id"])
    return consistency_check(done.mapping).agg(F.count("*").alias("conflicts"))


# a row-scope map restarts its numbers in every row: over the table its tokens do conflict
@query(
    "consistency_of_row_maps",
    f"""{_SPANS}, {_LABELLED}, {_NUMBERED}, pairs AS (SELECT DISTINCT token, x AS original FROM numbered)
    SELECT 'original' AS kind, original AS subject, count(*) AS n FROM pairs GROUP BY original HAVING count(*) > 1
    UNION ALL SELECT 'token', token, count(*) FROM pairs GROUP BY token HAVING count(*) > 1""",
)
def _row_maps(spark, sf_dir):
    return consistency_check(used_tokens(_anonymized(spark, sf_dir, "pseudo"), KEY)).select("kind", "subject", "n")


_TOKENED = f"select tbl, id, case when id % 5 = 0 then concat('«EMAIL_', cast(id as string), '» ', text) else text end as text from ({TEXTS_SQL}) x"


@query("holds_tokens", f"SELECT tbl, id FROM ({_TOKENED}) WHERE regexp_matches(text, '«[A-Z]+_[0-9A-Za-z]+»')")
def _holds_tokens(spark, sf_dir):
    return holds_tokens(derive(spark, sf_dir, _TOKENED), KEY)


# ------------------------------------------------------------------ sources

_MAX = 4000


@query("admit", f"SELECT tbl, id, CASE WHEN length(text) > {_MAX} THEN 'size' END AS reason FROM ({TEXTS_SQL})")
def _admit(spark, sf_dir):
    return admit(derive(spark, sf_dir, TEXTS_SQL), max_chars=_MAX).select(*KEY, "reason")


_BYTES = f"select tbl, id, case when id % 7 = 0 then unhex('FFFE0001') else encode(text{{enc}}) end as content from ({TEXTS_SQL}) x"


@query(
    "admit_bytes",
    f"SELECT tbl, id, CASE WHEN id % 7 = 0 THEN 'encoding' WHEN length(text) > {_MAX} THEN 'size' END AS reason FROM ({TEXTS_SQL})",
)
def _admit_bytes(spark, sf_dir):
    files = derive(spark, sf_dir, _BYTES.format(enc=", 'utf-8'"))
    return admit(files, "content", max_chars=_MAX).select(*KEY, "reason")


# one file per order, in a format that depends on the key
_FILES_SQL = f"""select id, concat('in/f', cast(id as string), case id % 4 when 0 then '.json' when 1 then '.CSV' else '.txt' end) as path,
    case id % 4 when 0 then concat('{{"user": {{"email": "', contact, '", "n": [1, null, 2.5]}}, "memo": ["', memo, '"]}}')
        when 1 then concat('nombre,email', chr(10), '"', memo, ', x",', contact, chr(10)) when 2 then concat(contact, ' ', memo)
        else ' ' end as content from ({CELLS_SQL}) c"""
_FILE_SRC = f"""SELECT 'a' AS tbl, id, 0 AS leaf, CASE WHEN id % 4 = 0 THEN contact WHEN id % 4 = 1 THEN memo || ', x'
        WHEN id % 4 = 2 THEN contact || ' ' || memo ELSE ' ' END AS t FROM ({CELLS_SQL})
    UNION ALL SELECT 'b', id, 1, CASE WHEN id % 4 = 0 THEN memo ELSE contact END FROM ({CELLS_SQL}) WHERE id % 4 < 2"""
_FILE_TEXT = """CASE c.id % 4 WHEN 0 THEN '{' || chr(10) || '  "user": {' || chr(10) || '    "email": "' || c.output || '",' || chr(10) || '    "n": [' || chr(10)
        || '      1,' || chr(10) || '      null,' || chr(10) || '      2.5' || chr(10) || '    ]' || chr(10) || '  },' || chr(10)
        || '  "memo": [' || chr(10) || '    "' || m.output || '"' || chr(10) || '  ]' || chr(10) || '}'
    WHEN 1 THEN 'nombre,email' || chr(10) || '"' || c.output || '",' || m.output || chr(10) ELSE c.output END"""
_FILES_ORACLE = f"""WITH {o.spans(_FILE_SRC)},
    labelled AS (SELECT s.*, first_value(label) OVER (PARTITION BY id, x ORDER BY leaf, s) AS first_label,
        min((leaf, s)) OVER (PARTITION BY id, x) AS pos0 FROM spans s JOIN (SELECT tbl, id, leaf FROM src) USING (tbl, id)),
    typed AS (SELECT *, {_TYPE} AS y FROM labelled),
    tokened AS (SELECT *, '«' || y || '_' || dense_rank() OVER (PARTITION BY id, y ORDER BY pos0) || '»' AS token FROM typed),
    done AS ({o.replaced('tokened', 'src', 'token')})
    SELECT c.id, CASE c.id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'csv' ELSE 'txt' END AS format, {_FILE_TEXT} AS content
    FROM done c LEFT JOIN done m ON c.id = m.id AND m.tbl = 'b' WHERE c.tbl = 'a'"""


@query("anonymize_files", _FILES_ORACLE)
def _anonymize_files(spark, sf_dir):
    files = derive(spark, sf_dir, _FILES_SQL, "id").select("path", F.encode("content", "utf-8").alias("content"))
    done = anonymize_files(files).accepted
    return done.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("id"), "format", "content")


# ------------------------------------------------------------------ streams

_DOCS = f"SELECT 'documents' AS tbl, doc_id AS id, source AS grp, {o.normalized('text')} AS t FROM documents"


def _document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "documents").schema
    # as a glob, since a stream takes no path of a single file; a folder of part files matches as well
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")


@query(
    "anonymize_stream",
    f"WITH {o.spans(_DOCS)} SELECT id AS doc_id, output FROM ({o.replaced('spans', 'src', o.mask('x', o.type_of('label')))})",
)
def _stream(spark, sf_dir):
    folder = shared_folder(spark, "stream")
    masked = anonymize_stream(_document_stream(spark, sf_dir), "mask").select("doc_id", "output")
    written = masked.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    written.start(f"{folder}/out", format="parquet", outputMode="append").awaitTermination()
    return spark.read.schema(masked.schema).parquet(f"{folder}/out")


@query(
    "pseudonymize_stream",
    f"""WITH {o.spans(_DOCS.replace(o.normalized('text'), 'text'))},
    labelled AS (SELECT *, first_value(label) OVER (PARTITION BY x ORDER BY id, s) AS first_label, min((id, s)) OVER (PARTITION BY x) AS pos0 FROM spans),
    typed AS (SELECT *, {_TYPE} AS y FROM labelled),
    tokened AS (SELECT *, '«' || y || '_' || dense_rank() OVER (PARTITION BY y ORDER BY pos0) || '»' AS token FROM typed)
    SELECT id AS doc_id, output FROM ({o.replaced('tokened', 'src', 'token')})""",
)
def _pseudo_stream(spark, sf_dir):
    folder = shared_folder(spark, "stream")

    def sink(done: DataFrame, batch_id: int) -> None:
        done.select("doc_id", "output").write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    batches = pseudonymize_batches(f"{folder}/tokens", sink, key=["doc_id"])
    stream = _document_stream(spark, sf_dir).select("doc_id", "text")
    written = stream.writeStream.foreachBatch(batches).option("checkpointLocation", f"{folder}/state")
    written.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc_id", "output")
