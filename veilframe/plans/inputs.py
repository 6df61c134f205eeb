"""Inputs of the driver queries.

The given tables hold few identifiers of the Argentine kinds and few secrets, so a text with
all kinds is derived from every order. The derivations are written once, in SQL that Spark and
DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import spread

# digits that vary with the key: d9 nine of them, c16 sixteen, all functions of o_orderkey
_DIGITS = """
    lpad(cast(o_orderkey * 7919 % 1000000000 as string), 9, '0') as d9,
    concat(lpad(cast(o_orderkey * 104729 % 100000000 as string), 8, '4'),
           lpad(cast(o_orderkey * 1299709 % 100000000 as string), 8, '0')) as c16,
    cast(o_custkey as string) as cust, o_orderkey as k
"""

_TEXT = """
    case when k % 7 = 0 then concat('pedido ', d9)
         when k % 7 = 1 then concat('Mail user', cust, '@mail', substr(d9, 1, 1), '.example.com y user', cust, '@mail',
              substr(d9, 1, 1), '.example.com; ver https://shop.example.com/u/', cust, '?o=', d9, '. IP 10.', cust, '.',
              substr(d9, 1, 2), '.7 o 192.168.', substr(d9, 2, 2), '.', substr(d9, 4, 2))
         when k % 7 = 2 then concat('CUIT 20-', substr(d9, 1, 8), '-', substr(d9, 9, 1), ' o 27', substr(c16, 1, 8),
              substr(c16, 9, 1), ', CBU ', lpad(c16, 22, '7'), ' fin ', c16, d9)
         when k % 7 = 3 then concat('DNI ', substr(d9, 1, 2), '.', substr(d9, 3, 3), '.', substr(d9, 6, 3),
              ' documento: ', substr(d9, 2, 8), ' d.n.i. ', substr(c16, 1, 7), ' total $', substr(d9, 1, 3), '.00')
         when k % 7 = 4 then concat('tarjeta ', substr(c16, 1, 4), ' ', substr(c16, 5, 4), ' ', substr(c16, 9, 4), ' ',
              substr(c16, 13, 4), ' y ', c16, ' o ', substr(c16, 1, 4), '-', substr(c16, 5, 4), '-', substr(c16, 9, 4),
              '-', substr(c16, 13, 4), ' - ', substr(c16, 1, 4))
         when k % 7 = 5 then concat('tel +54 11 ', substr(c16, 1, 4), '-', substr(c16, 5, 4), ' (0', substr(d9, 1, 2),
              ') ', substr(c16, 9, 4), ' ', substr(c16, 13, 4), ', int. 12-34, ', substr(d9, 1, 4), '-',
              substr(d9, 5, 4), ' y ', substr(d9, 1, 4), '-', substr(d9, 5, 4), '.')
         else concat('clave sk-', c16, 'abc AKIA', c16, ' token ghp_', c16, d9, ' xoxb-', d9, '-', substr(c16, 1, 5),
              ' mail user', cust, '@mail.example.com tel 011 ', substr(c16, 1, 4), '-', substr(c16, 5, 4)) end
"""

RECORDS_SQL = f"""select o_orderkey as id, o_orderpriority as grp, {_TEXT} as text
    from (select *, {_DIGITS} from orders) o"""

# the same customer writes in several orders, so values repeat over the table
CELLS_SQL = f"""select o_orderkey as id, o_orderpriority as grp,
    concat('user', cust, '@mail.example.com') as contact,
    case when k % 5 = 0 then '' when k % 5 = 1 then concat('cuenta ', lpad(cust, 22, '3'))
         when k % 5 = 2 then concat('llamar 011 4', lpad(cust, 3, '0'), '-', substr(d9, 1, 4), ' o user', cust, '@mail.example.com')
         when k % 5 = 3 then concat('IP 10.1.', cust, '.2 DNI 1', lpad(cust, 7, '0')) else 'sin datos' end as memo
    from (select *, {_DIGITS} from orders) o"""

# every text the queries look at, with the table it is from
TEXTS_SQL = f"""select 'documents' as tbl, doc_id as id, source as grp, text from documents
    union all select 'pages', page_id, 'web', html from pages
    union all select 'orders', id, grp, text from ({RECORDS_SQL}) r"""

# a detector's findings: the first word of every document is taken for a name
EXTERNAL_SQL = """select doc_id, cast(0 as int) as start, cast(length(split_part(text, ' ', 1)) as int) as finish,
    case when doc_id % 3 = 0 then split_part(text, ' ', 1) end as text,
    case when doc_id % 4 = 0 then '<PRIVATE_ADDRESS>' when doc_id % 4 = 1 then '<PRIVATE_PERSON>' else '<UNKNOWN>' end as placeholder,
    case when doc_id % 4 = 2 then 'org' end as label from documents"""

# overlapping spans over imaginary texts, with ties of every kind
SPANS_SQL = """select l_orderkey as doc_id, cast((l_partkey * 31 + l_linenumber * 7) % 40 as int) as start,
    cast((l_partkey * 31 + l_linenumber * 7) % 40 + (l_suppkey + l_linenumber) % 12 as int) as finish,
    case (l_partkey + l_linenumber) % 5 when 0 then 'EMAIL' when 1 then 'PHONE' when 2 then 'AR_DNI' when 3 then 'OTHER' else 'MORE' end as label,
    cast(l_linenumber as int) as ord from lineitem"""

TABLES = ("documents", "pages", "conversations", "customer", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int | None:
    """Partitions that the user asks for with ``spark.veilframe.inputPartitions``; unset, inputs stay as read."""
    asked = spark.conf.get("spark.veilframe.inputPartitions", None)
    return int(asked) if asked else None


def derive(spark: SparkSession, sf_dir: str, sql: str, *key: str) -> DataFrame:
    """Run one of the derivations over the tables it names."""
    named = [t for t in TABLES if f"from {t}" in sql]
    query = sql.replace("{", "{{").replace("}", "}}")
    frames = {}
    for name in named:
        query = query.replace(f"from {name}", f"from {{{name}}}")
        frames[name] = table(spark, sf_dir, name)
    df = spark.sql(query, **frames)
    return spread(df, partitions(spark), *key) if key else df


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, TEXTS_SQL, "id")
