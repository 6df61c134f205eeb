"""Detection: hand-written cases, parity with plain Python, guards, plan shape."""

import random
import time
import re

import plain
import pytest
from pyspark.sql import functions as F

from veilframe.functions import spans as spans_module
from veilframe.functions.detectors import DETECTORS, PRIORITY, raw_spans
from veilframe.functions.pii import detect_pii, raw_pii
from veilframe.functions.spans import finalize_spans, merge_overlaps, resolve_overlaps
from veilframe.functions.sql import expr
from veilframe.functions.text import PY_SPACE, normalize_text
from veilframe.functions.validators import cuit_ok, luhn_ok
from veilframe.operators.detect import detect_docs, explode_spans, ingest_external_spans, with_spans
from veilframe.operators.span_tables import resolve_span_table

FIVE = (
    "Contacto: juan.perez@acme.com, CUIT 20-12345678-6, CBU 0170099220000067797370, "
    "tarjeta 4111 1111 1111 1111, tel +54 11 4123-4567."
)


def rows_of(spark, values, columns):
    return spark.createDataFrame(values, columns)


def spans_of(spark, texts, sql=None):
    df = rows_of(spark, list(enumerate(texts)), "id int, text string")
    out = df.select("id", expr(sql or detect_pii("text")).alias("s")).collect()
    return {r.id: [tuple(s) for s in r.s] for r in out}


@pytest.mark.parametrize(
    "text,expected",
    [
        ("escribime a juan.perez@acme.com.ar dale", [("EMAIL", "juan.perez@acme.com.ar")]),
        ("CUIT 20-12345678-6 listo", [("AR_CUIT", "20-12345678-6")]),
        ("CBU 0170099220000067797370 para transferir", [("AR_CBU", "0170099220000067797370")]),
        ("mi DNI es 12.345.678", [("AR_DNI", "12.345.678")]),
        ("documento 30123456", [("AR_DNI", "30123456")]),
        ("tarjeta 4111 1111 1111 1111", [("CREDIT_CARD", "4111 1111 1111 1111")]),
        ("", []),
        ("nada", []),
        (
            FIVE,
            [
                ("EMAIL", "juan.perez@acme.com"),
                ("AR_CUIT", "20-12345678-6"),
                ("AR_CBU", "0170099220000067797370"),
                ("CREDIT_CARD", "4111 1111 1111 1111"),
                ("PHONE", "+54 11 4123-4567"),
            ],
        ),
    ],
)
def test_examples(spark, text, expected):
    found = spans_of(spark, [text])[0]
    assert [(s[0], s[3]) for s in found] == expected
    assert all(text[s[1] : s[2]] == s[3] for s in found)


def test_check_digits(spark):
    found = spans_of(spark, ["nro 20-12345678-0", "nro 4111 1111 1111 1112"])
    assert "AR_CUIT" not in [s[0] for s in found[0]]
    assert "CREDIT_CARD" not in [s[0] for s in found[1]]


def test_card_takes_a_trailing_separator_and_does_not_retry(spark):
    found = spans_of(spark, ["4111 1111 1111 1111 x", "41111111111111112"])
    assert found[0] == [("CREDIT_CARD", 0, 20, "4111 1111 1111 1111 ")]
    assert "CREDIT_CARD" not in [s[0] for s in found[1]]


def test_null_text_has_no_spans(spark):
    df = rows_of(spark, [(1, None)], "doc_id int, text string")
    assert with_spans(df).first().spans == []
    assert detect_docs(df).count() == 0


PIECES = (
    ["juan@acme.com", "a.b+c@x-y.org", "@", "www.x.org/a?b=(1)", "HTTPS://Ex.com/ñ'x", "http://", "10.0.0.255", "300.1.1.1"]
    + ["sk-" + "a1B2" * 5, "AKIA" + "A1" * 8, "ghp_" + "x9" * 11, "xoxb-12345-abcde-", "4111 1111 1111 1111", "4111-1111"]
    + ["20-12345678-6", "20123456786", "27 12345678 0", "0" * 22, "1" * 23, "12.345.678", "1.234.567", "DNI n° 12345678"]
    + ["d.n.i. 1.234.567", "D.N.I:7654321", "documento", "+54 11 4123-4567", "(011) 4123 4567", "4123-4567", "12-34", "2024-01-15"]
    + ["ñ", "é", "_", "x", "²", "½", "٣٤", "١٢٣-٤٥٦٧", "😀", "́", "\u0001", "\u0002", "\x1c", "\xa0", "ı", "ſ", "K", "DNİ", "dnı", "𝐀", "𝟙𝟚", "𐐨"]
    + [" ", " ", " ", "\n", "\t", "-", ".", ",", ":", "(", ")", "°", "º", "5", "77", "123", "4567"]
)


def random_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def test_parity_with_python_on_random_texts(spark):
    texts = random_texts(7, 3000)
    raw = spans_of(spark, texts, raw_pii("text"))
    final = spans_of(spark, texts)
    for i, text in enumerate(texts):
        assert raw[i] == plain.raw(text), text
        assert final[i] == plain.detect(text), text


def test_parity_with_python_on_documents(spark, documents):
    rows = documents.select("text", expr(detect_pii("text")).alias("s")).collect()
    assert rows
    for row in rows:
        assert [tuple(s) for s in row.s] == plain.detect(row.text)


def test_guards_never_change_a_result(spark):
    texts = random_texts(8, 2000)
    assert spans_of(spark, texts, raw_spans("text")) == spans_of(spark, texts, raw_spans("text", guarded=False))


def test_each_pattern_is_in_the_plan_once(spark):
    df = rows_of(spark, [(1, FIVE)], "doc_id int, text string")
    for result in (with_spans(df), with_spans(df).where("size(spans) > 0").select("spans"), detect_docs(df)):
        plan = result._jdf.queryExecution().optimizedPlan().toString()
        # one set for 0-9, one for other digits, and three in the validators
        assert plan.count("regexp_replace") == 2 * len(DETECTORS) + 3
        assert "Exchange" not in result._jdf.queryExecution().executedPlan().toString()


def test_only_needed_columns_are_read(spark, documents):
    plan = detect_docs(documents)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_many_spans_in_one_text(spark):
    text = " ".join(f"user{i % 700}@mail{i}.example.com 10.0.{i % 250}.{i % 200}" for i in range(3000))
    assert spans_of(spark, [text])[0] == plain.detect(text)


def test_resolve_matches_the_plain_greedy(spark):
    rng = random.Random(3)
    cases = []
    for _ in range(400):
        spans = []
        for _ in range(rng.randint(0, 14)):
            start = rng.randint(0, 30)
            spans.append((rng.choice(["EMAIL", "PHONE", "X", "Y"]), start, start + rng.randint(0, 9), "t"))
        cases.append((len(cases), spans))
    df = rows_of(spark, cases, "id int, s array<struct<label:string,start:int,end:int,text:string>>")
    for row in df.select("id", expr(resolve_overlaps("s", PRIORITY)).alias("r")).collect():
        assert [tuple(s) for s in row.r] == plain.resolve(cases[row.id][1], PRIORITY)


def test_span_table_over_stretches(spark, monkeypatch):
    """Documents longer than a stretch, islands across its borders, copies, one hot document."""
    monkeypatch.setattr("veilframe.operators.span_tables.STRETCH", 16)
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        start = rng.randint(0, 400)
        length = rng.choice([0, 3, 5, 9, 14, 60])
        rows.append((rng.choice([0, 0, 1, 2, 3]), i, rng.choice(["EMAIL", "PHONE", "X"]), start, start + length, "t"))
    df = rows_of(spark, rows + rows[:50], "doc int, ord int, label string, start int, end int, text string")
    found = resolve_span_table(df, ["doc"], PRIORITY).collect()
    for doc in range(4):
        spans = [r[2:] for r in rows if r[0] == doc]
        want = plain.resolve(spans, PRIORITY)
        assert sorted(tuple(r)[1:] for r in found if r.doc == doc) == sorted(want)


def test_longest_wins_before_priority(spark):
    spans = [("CUSTOM", 0, 4, "aaaa"), ("EMAIL", 2, 9, "aabbbbb")]
    df = rows_of(spark, [(spans,)], "s array<struct<label:string,start:int,end:int,text:string>>")
    kept = df.select(expr(resolve_overlaps("s", {**PRIORITY, "CUSTOM": 100})).alias("r")).first().r
    assert [s.label for s in kept] == ["EMAIL"]


def test_propagation(spark):
    df = rows_of(
        spark,
        [("Juan y Juan", [("PERSON", 0, 4, "Juan")]), ("Ana y Ana", [("PERSON", 0, 3, "Ana")]), ("aaaaa aaaa", [("A", 0, 4, "aaaa")])],
        "text string, s array<struct<label:string,start:int,end:int,text:string>>",
    )
    out = [[tuple(x)[1:3] for x in r.f] for r in df.select(expr(finalize_spans("text", "s", {})).alias("f")).collect()]
    assert out == [[(0, 4), (7, 11)], [(0, 3)], [(0, 4), (6, 10)]]


def test_external_spans(spark):
    docs = rows_of(spark, [(1, "Juan y Juan"), (2, "sin nada"), (3, None)], "doc_id int, text string")
    external = rows_of(
        spark,
        [(1, 0, 4, None, "<PRIVATE_PERSON>", None), (2, 0, 3, "sin", "<WHAT>", "org"), (2, 4, 8, None, None, None)],
        "doc_id int, start int, end int, text string, placeholder string, label string",
    )
    found = explode_spans(ingest_external_spans(docs, external), ["doc_id"]).orderBy("doc_id", "start").collect()
    assert [tuple(r) for r in found] == [
        (1, "PERSON", 0, 4, "Juan"),
        (1, "PERSON", 7, 11, "Juan"),
        (2, "ORG", 0, 3, "sin"),
        (2, "PII", 4, 8, "nada"),
    ]
    with pytest.raises(ValueError):
        detect_docs(docs, engine="ml")
    assert {r.engine for r in detect_docs(docs, engine="auto", external=external).collect()} == {"ml"}
    assert detect_docs(docs, engine="whatever", external=external).count() == 0


def test_normalize(spark):
    df = rows_of(spark, [("CUIT 20-\n12345678-6",), ("a - \t\n\t b",), (None,), ("a-b\nc",)], "text string")
    out = [r.n for r in df.select(expr(normalize_text("text")).alias("n")).collect()]
    assert out == ["CUIT 20-12345678-6", "a -b", None, "a-b\nc"]


def test_validators(spark):
    rng = random.Random(5)
    cards = ["".join(rng.choice("0123456789 -") for _ in range(rng.randint(10, 24))) for _ in range(800)]
    cuits = [f"{rng.choice([20, 23, 27, 30])}-{rng.randint(0, 10**8 - 1):08d}-{rng.randint(0, 9)}" for _ in range(800)]
    df = rows_of(spark, list(zip(cards, cuits)), "card string, cuit string")
    for row in df.select("*", expr(luhn_ok("card")).alias("a"), expr(cuit_ok("cuit")).alias("b")).collect():
        assert (row.a, row.b) == (plain.luhn(row.card), plain.cuit(row.cuit))


def test_merge_overlaps(spark):
    spans = [("A", 5, 9, ""), ("B", 0, 3, ""), ("C", 8, 12, ""), ("D", 2, 3, ""), ("E", 12, 13, "")]
    df = rows_of(spark, [(spans,)], "s array<struct<label:string,start:int,end:int,text:string>>")
    merged = df.select(expr(merge_overlaps("s")).alias("m")).first().m
    assert [tuple(x) for x in merged] == [(0, 3), (5, 12), (12, 13)]


def test_space_class():
    assert all(c.isspace() for c in PY_SPACE)
    assert PY_SPACE == "".join(c for c in map(chr, range(0x110000)) if c.isspace())
    assert re.fullmatch(r"\s+", PY_SPACE)


def test_inputs_are_dealt_out_only_where_asked(spark, documents):
    from veilframe.sources.readers import spread

    assert spread(documents, None) is documents
    assert spread(documents, 3, "doc_id").rdd.getNumPartitions() == 3


def test_long_runs_of_mail_characters(spark):
    texts = ["a." * 100_000 + "@", "a." * 100_000 + "@ x@y.com", "é" + "a." * 300 + "b@c.org", "x@" + "a." * 50_000, "b" * 300 + "@d.net"]
    start = time.time()
    rows = detect_docs(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert sorted((r.doc_id, r.text[-7:]) for r in rows if r.label == "EMAIL") == [(1, "x@y.com"), (2, "b@c.org"), (4, "b@d.net")]
    assert time.time() - start < 60


def _texts_of_many_spans():
    rng = random.Random(3)
    for letters, gaps in [("ab", [" ", "x é ", "\U0001f600"]), ("abcdefgh é", [" "])] * 4:
        text, found = "", []
        for i in range(rng.choice([70, 150])):
            value = "".join(rng.choice(letters) for _ in range(rng.choice([3, 4, 5, 8, 9, 16, 33, 40])))
            text += rng.choice(gaps)
            stated = value if rng.random() < 0.95 else "ab a"  # some are not the slice they claim
            found.append((f"L{i % 3}", len(text), len(text) + len(value), stated))
            text += value
        yield text, found


def test_repeats_of_many_spans_equal_a_search_per_span(spark, monkeypatch):
    schema = "text string, found array<struct<label:string,start:int,end:int,text:string>>"
    docs = spark.createDataFrame(list(_texts_of_many_spans()), schema).coalesce(1)
    ways = []
    for many in (spans_module.MANY, 1 << 30):
        monkeypatch.setattr(spans_module, "MANY", many)
        ways.append([r[0] for r in docs.select(expr(spans_module.propagate_spans("text", "found"))).collect()])
    assert ways[0] == ways[1]


def test_many_different_addresses_are_not_searched_one_by_one(spark):
    schema = "text string, found array<struct<label:string,start:int,end:int,text:string>>"
    text, found = "", []
    for i in range(17_000):
        value = f"user{i:05d}@mail.example"
        found.append(("EMAIL", len(text) + 5, len(text) + 5 + len(value), value))
        text += f"text {value} "
    docs = spark.createDataFrame([(text, found)], schema).cache()
    docs.count()
    began = time.monotonic()
    assert docs.select(F.size(expr(spans_module.propagate_spans("text", "found")))).first()[0] == len(found)
    assert time.monotonic() - began < 20
