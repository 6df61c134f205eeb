"""Replacement modes, reversal, scopes, reports."""

import random
import re

import plain
import pytest
from pyspark.sql import functions as F
from test_detect import FIVE, random_texts

from veilframe.functions.labels import placeholder_of, type_of
from veilframe.functions.sql import expr, let
from veilframe.functions.tokens import MODES, mask_value
from veilframe.operators.anonymize import anonymize_docs, deanonymize, deanonymize_rows, redact_placeholder, rewrite_found
from veilframe.operators.numbering import number_within
from veilframe.operators.pages import redact_pages
from veilframe.operators.reports import (
    consistency_check,
    highlight_docs,
    holds_tokens,
    leak_check,
    leak_counts,
    leak_check_tables,
    roundtrip_check,
    summary_rollup,
    used_tokens,
)
from veilframe.operators.detect import choose_spans, detect_docs, ingest_external_spans
from veilframe.operators.tables import anonymize_nested, anonymize_table, pseudonymize_table

KEY = b"secret"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def output(spark, mode, *texts, **options):
    done = anonymize_docs(docs(spark, *texts), mode, **options)
    return [r.output for r in done.orderBy("doc_id").collect()]


def test_pseudo_is_stable_and_reversible(spark):
    text = "mail juan@acme.com y otra vez juan@acme.com, ademas ana@x.com"
    done = anonymize_docs(docs(spark, text), "pseudo")
    row = deanonymize_rows(done).first()
    assert row.output == "mail «EMAIL_1» y otra vez «EMAIL_1», ademas «EMAIL_2»"
    assert row.map == {"«EMAIL_1»": "juan@acme.com", "«EMAIL_2»": "ana@x.com"}
    assert row.restored == text and row.reversible and row.summary == {"EMAIL": 3}


@pytest.mark.parametrize(
    "mode,expected",
    [
        ("typed", "contacto [EMAIL]"),
        ("anon", "contacto <<ANOM_DATA>>"),
        ("mask", "contacto j•••@acme.com"),
        ("pseudo", "contacto «EMAIL_1»"),
        ("off", "contacto juan@acme.com"),
        ("hash", f"contacto «EMAIL_{plain.hmac_token(KEY, 'juan@acme.com')}»"),
    ],
)
def test_modes(spark, mode, expected):
    assert output(spark, mode, "contacto juan@acme.com", hash_key=KEY) == [expected]


def test_own_generic_token_and_unknown_mode(spark):
    assert output(spark, "anon", "x juan@acme.com", generic="***") == ["x ***"]
    with pytest.raises(ValueError):
        anonymize_docs(docs(spark, "x"), "nope")


def test_hash_links_case_variants_and_hides_its_key(spark):
    done = anonymize_docs(docs(spark, "Ana@X.com y ana@x.com"), "hash", hash_key="k" * 100)
    first, second = done.first().output.split(" y ")
    assert first == second == f"«EMAIL_{plain.hmac_token(b'k' * 100, 'ana@x.com')}»"
    assert "kkkk" not in done._jdf.queryExecution().toString()
    assert done.first().map == {}


def test_mask_keeps_the_last_characters_of_numbers(spark):
    assert output(spark, "mask", "tarjeta 4111 1111 1111 1111", "CUIT 20-12345678-6") == [
        "tarjeta •••• •••• •••• 1111",
        "CUIT ••-••••••78-6",
    ]


@pytest.mark.parametrize(
    "text,typ,expected",
    [
        ("Juan  Perez", "PERSONA", "J••• P••••"),
        ("J", "PERSONA", "J•"),
        ("@acme.com", "EMAIL", "••••@acme.com"),
        ("7", "ID", "•"),
        ("12", "TEL", "•2"),
        ("calle 123456", "DOMICILIO", "••••• ••3456"),
        (" \t ", "DATO", " \t "),
        ("http://x", "URL", "•••"),
    ],
)
def test_mask_value(spark, text, typ, expected):
    df = spark.createDataFrame([(text, typ)], "t string, y string")
    assert df.select(expr(mask_value("t", "y"))).first()[0] == expected


def test_type_and_placeholder(spark):
    df = spark.createDataFrame([("EMAIL",), ("legajo 7",), ("123",), ("ñ",)], "l string")
    rows = df.select(expr(type_of("l")), expr(placeholder_of("l"))).collect()
    assert [tuple(r) for r in rows] == [
        ("EMAIL", "<PRIVATE_EMAIL>"),
        ("LEGAJO", "<REDACTED>"),
        ("DATO", "<REDACTED>"),
        ("DATO", "<REDACTED>"),
    ]


def test_first_label_decides_the_token(spark):
    external = spark.createDataFrame(
        [(0, 0, 4, "Rosa", "<PRIVATE_PERSON>", None), (0, 7, 11, "Rosa", "<PRIVATE_ADDRESS>", None)],
        "doc_id int, start int, end int, text string, placeholder string, label string",
    )
    done = anonymize_docs(docs(spark, "Rosa y Rosa"), "pseudo", external=external)
    assert done.first().output == "«PERSONA_1» y «PERSONA_1»"


def test_placeholders(spark):
    row = redact_placeholder(docs(spark, "mail juan@acme.com")).first()
    assert row.output == "mail <PRIVATE_EMAIL>"
    assert row.detected_spans[0].placeholder == "<PRIVATE_EMAIL>" and row.summary == {"EMAIL": 1}


@pytest.mark.parametrize("mode", MODES)
def test_nothing_detected_survives(spark, mode):
    done = anonymize_docs(docs(spark, FIVE), mode, hash_key=KEY)
    assert leak_check(done, ["doc_id"]).count() == 0
    row = done.first()
    for value in ("juan.perez@acme.com", "20-12345678-6", "0170099220000067797370", "4111 1111 1111 1111", "4123-4567"):
        assert value not in row.output


def test_leaks_are_reported(spark):
    done = anonymize_docs(docs(spark, "x juan@acme.com"), "off").withColumn(
        "spans", anonymize_docs(docs(spark, "x juan@acme.com"), "typed").select("spans").scalar()
    )
    assert [tuple(r) for r in leak_check(done, ["doc_id"]).collect()] == [(0, "EMAIL", "juan@acme.com")]
    spans = detect_docs(docs(spark, "x juan@acme.com"))
    assert leak_check_tables(spans, done.select("doc_id", "output"), ["doc_id"]).count() == 1


def test_random_texts_round_trip(spark):
    texts = random_texts(11, 400)
    done = anonymize_docs(docs(spark, *texts), "pseudo", normalize=False)
    assert roundtrip_check(done, ["doc_id"]).count() == 0
    for row in done.collect():
        spans = plain.detect(row.text)
        assert [tuple(s) for s in row.spans] == spans
        assert set(row.map.values()) == {s[3] for s in spans}


def test_token_shaped_input_is_reported(spark):
    given = docs(spark, "hola «EMAIL_1» y juan@acme.com", "nada")
    assert [r.doc_id for r in holds_tokens(given, ["doc_id"]).collect()] == [0]
    assert roundtrip_check(anonymize_docs(given, "pseudo"), ["doc_id"]).count() == 1


def test_deanonymize_by_map(spark):
    given = spark.createDataFrame([(1, "«EMAIL_12» y «EMAIL_1» «X_9»"), (2, "nada"), (3, None)], "id int, output string")
    mapping = spark.createDataFrame([("«EMAIL_1»", "a@b.com"), ("«EMAIL_12»", "c@d.com")], "token string, original string")
    back = {r.id: r.restored for r in deanonymize(given, mapping, key=["id"]).collect()}
    assert back == {1: "c@d.com y a@b.com «X_9»", 2: "nada", 3: None}
    with pytest.raises(ValueError):
        deanonymize(given, mapping.limit(0), key=["id"])


def table(spark):
    rows = [(0, "f", "nombre", "email"), (1, "f", "Juan Perez", "juan@acme.com"), (2, "g", "Ana", "ana@x.com"), (3, "g", None, "juan@acme.com, 4123-4567")]
    return spark.createDataFrame(rows, "id int, file string, c0 string, c1 string")


@pytest.mark.parametrize(
    "scope,expected",
    [
        ("table", ["email", "«EMAIL_1»", "«EMAIL_2»", "«EMAIL_1», «TEL_1»"]),
        (["file"], ["email", "«EMAIL_1»", "«EMAIL_1»", "«EMAIL_2», «TEL_1»"]),
        ("row", ["email", "«EMAIL_1»", "«EMAIL_1»", "«EMAIL_1», «TEL_1»"]),
    ],
)
def test_scopes(spark, scope, expected):
    done = anonymize_table(table(spark), "pseudo", columns=["c0", "c1"], scope=scope, order_by=["id"])
    data = done.data.orderBy("id").collect()
    assert [r.c1 for r in data] == expected
    assert [r.c0 for r in data] == ["nombre", "Juan Perez", "Ana", None]
    assert sum(r.n for r in done.summary.where("label = 'EMAIL'").collect()) == 3
    keys = ["file"] if isinstance(scope, list) else ["id"] if scope == "row" else []
    assert consistency_check(done.mapping, keys).count() == 0


def test_scope_needs_a_key(spark):
    with pytest.raises(ValueError):
        anonymize_table(table(spark), "pseudo")
    with pytest.raises(ValueError):
        anonymize_table(table(spark), "pseudo", scope="file", order_by=["id"])


def test_table_numbers_against_a_plain_count(spark):
    """One hot value in a third of the rows, numbers in order of first appearance."""
    rng = random.Random(2)
    rows = [(i, f"u{0 if i % 3 == 0 else rng.randint(1, 300)}@x.com 10.0.0.{rng.randint(1, 99)}") for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, t string").repartition(7)
    done = pseudonymize_table(df, columns=["t"], order_by=["id"])
    tokens, counts, want = {}, {}, []
    for _, text in rows:
        out = []
        for value, kind in zip(text.split(" "), ("EMAIL", "IP")):
            if value not in tokens:
                counts[kind] = counts.get(kind, 0) + 1
                tokens[value] = f"«{kind}_{counts[kind]}»"
            out.append(tokens[value])
        want.append(" ".join(out))
    assert [r.t for r in done.data.orderBy("id").collect()] == want
    assert {r.original: r.token for r in done.mapping.collect()} == tokens


@pytest.mark.parametrize("mode", ["typed", "anon", "mask", "hash"])
def test_other_modes_at_table_scope(spark, mode):
    whole = anonymize_table(table(spark), mode, columns=["c1"], order_by=["id"], hash_key=KEY)
    per_row = anonymize_table(table(spark), mode, columns=["c1"], scope="row", order_by=["id"], hash_key=KEY)
    assert whole.data.orderBy("id").collect() == per_row.data.orderBy("id").collect()
    assert whole.mapping.count() == 0 and per_row.mapping.count() == 0


def test_nested_values(spark):
    schema = "id int, doc struct<user:struct<email:string>,items:array<int>,notes:array<string>,extra:map<string,string>,deep:array<struct<m:string>>>"
    rows = [(1, (("a@b.com",), [1, 2, 3], ["x@y.com", None, ""], {"k@k.com": "a@b.com"}, [("v@v.com",), None])), (2, None)]
    df = spark.createDataFrame(rows, schema)
    for scope in ("row", "table"):
        got = {r.id: r.doc for r in anonymize_nested(df, ["doc"], scope=scope, order_by=["id"]).data.collect()}
        assert got[1].user.email == "«EMAIL_1»" and got[1]["items"] == [1, 2, 3]
        assert got[1].notes == ["«EMAIL_2»", None, ""] and got[1].extra == {"k@k.com": "«EMAIL_1»"}
        assert got[1].deep[0].m == "«EMAIL_3»" and got[1].deep[1] is None
        assert got[2] is None


def test_number_within_large_group(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 5003).alias("o"))
    got = number_within(df, ["g"], ["o"]).collect()
    for g in (0, 1):
        rows = sorted((r.o, r.n) for r in got if r.g == g)
        assert [n for _, n in rows] == list(range(1, len(rows) + 1))


def test_pages(spark):
    page = "Contacto juan@acme.com y CUIT 20-12345678-6, juan@acme.com"
    row = redact_pages(docs(spark, page)).first()
    assert row.redactions == 3
    assert row.redacted == f"Contacto {'█' * 13} y CUIT {'█' * 13}, {'█' * 13}"


def test_highlight(spark):
    done = highlight_docs(anonymize_docs(docs(spark, "<b> & a@b.com", ""), "typed"))
    assert [r.html for r in done.orderBy("doc_id").collect()] == [
        '&lt;b&gt; &amp; <mark class="pii" title="EMAIL">a@b.com</mark>',
        "&nbsp;",
    ]


def test_rollup_has_files_without_findings(spark):
    done = anonymize_docs(docs(spark, "a@b.com c@d.com", "nada"), "typed")
    rows = {(r.doc_id, r.label, r.level): r.n for r in summary_rollup(done, "doc_id").collect()}
    assert rows == {(0, "EMAIL", 0): 2, (0, None, 1): 2, (1, None, 1): 0, (None, None, 3): 2}


def test_conflicting_tokens_are_reported(spark):
    done = anonymize_docs(docs(spark, "a@b.com", "c@d.com"), "pseudo")
    conflicts = consistency_check(used_tokens(done, ["doc_id"])).collect()
    assert [(r.kind, r.subject, r.n) for r in conflicts] == [("token", "«EMAIL_1»", 2)]


def test_filters_on_results_do_not_repeat_the_detectors(spark):
    done = anonymize_docs(docs(spark, FIVE), "pseudo").where("output <> text and size(spans) > 1 and size(map) > 0")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("KIA[0-9A-Z]") == 2


ODD_KEYS = [(None, "c@d.com y a@b.com"), (1, "a@b.com"), (1, "10.0.0.1 y c@d.com"), (1, "a@b.com"), (None, "nada"), (2, "e@f.com")]


def _hidden(texts):
    return not any(v in t for t in texts for v in ("a@b.com", "c@d.com", "e@f.com", "10.0.0.1"))


@pytest.mark.parametrize("mode", ["pseudo", "mask", "anon", "typed"])
def test_null_and_repeated_keys_hide_everything(spark, mode):
    df = spark.createDataFrame(ODD_KEYS, "id int, t string")
    done = pseudonymize_table(df, columns=["t"], order_by=["id"]) if mode == "pseudo" else anonymize_table(df, mode, columns=["t"], order_by=["id"])
    texts = [r.t for r in done.data.collect()]
    assert len(texts) == len(ODD_KEYS) and _hidden(texts) and "nada" in texts
    if mode == "pseudo":
        back = deanonymize(done.data, done.mapping, key=["id"], text=["t"])
        assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, ODD_KEYS))


def test_null_and_repeated_keys_in_a_stream(spark, tmp_path):
    from veilframe.streaming.stream import pseudonymize_batches

    out = []
    run = pseudonymize_batches(str(tmp_path / "tokens"), lambda df, _: out.extend(df.collect()), key=["id"], text="t")
    run(spark.createDataFrame(ODD_KEYS, "id int, t string"), 0)
    assert len(out) == len(ODD_KEYS) and _hidden([r.output for r in out])


def test_tokens_per_row_need_a_key(spark):
    with pytest.raises(ValueError, match="order_by"):
        anonymize_table(spark.createDataFrame([("a@b.com",)], "t string"), "pseudo", scope="row")


def test_column_names_with_dots(spark):
    df = spark.createDataFrame([(1, "a@b.com")], "id int, `m.x` string")
    assert pseudonymize_table(df, order_by=["id"]).data.first()["m.x"] == "«EMAIL_1»"
    assert anonymize_docs(df, "typed", text="m.x", key=["id"]).first().output == "[EMAIL]"


def test_external_text_longer_than_its_slice(spark):
    docs = spark.createDataFrame([(1, "Juan Perez vive con Ana")], "doc_id int, text string")
    given = "doc_id int, start int, end int, text string, placeholder string, label string"
    spans = spark.createDataFrame([(1, 0, 4, "Juan Perez", "<PRIVATE_PERSON>", None)], given)
    found = ingest_external_spans(docs, spans).first().spans
    assert [(s.start, s.end) for s in found] == [(0, 10)]


def test_rows_without_findings_cross_no_exchange(spark):
    rows = [(i, f"mail a{i}@x.com", "plain") for i in range(20)] + [(100 + i, "nothing here", None) for i in range(50)]
    done = pseudonymize_table(spark.createDataFrame(rows, "id long, note string, memo string"), order_by=["id"])
    plan = done.data._jdf.queryExecution().optimizedPlan()
    clean, touched = (plan.children().apply(i).toString() for i in range(2))
    assert plan.nodeName() == "Union" and "Relation" in clean
    assert not re.search("Join|Aggregate|Window|Repartition|regexp", clean) and "Join" in touched
    assert done.data.count() == 70
    kept = {r.id: r.note for r in done.data.where("id >= 100").collect()}
    assert len(kept) == 50 and set(kept.values()) == {"nothing here"}


def test_modes_of_one_detection(spark):
    docs = spark.createDataFrame([(1, "a@x.com y b@y.org"), (2, None), (3, "nada")], "doc_id long, text string")
    found = choose_spans(docs, text="text")
    done = rewrite_found(found, ["mask", "typed", "hash"], text="text", hash_key="k")
    for mode in ("mask", "typed", "hash"):
        alone = anonymize_docs(docs, mode, normalize=False, hash_key="k")
        assert {(r.doc_id, r[f"output_{mode}"]) for r in done.collect()} == {(r.doc_id, r.output) for r in alone.collect()}
    leaky = done.withColumn("output_typed", F.col("text"))
    counts = leak_counts(leaky, {m: f"output_{m}" for m in ("mask", "typed")}).collect()
    assert sorted(map(tuple, counts)) == [("mask", 2, 0), ("typed", 2, 2)]
    assert leak_counts(done.limit(0), {"mask": "output_mask"}).collect()[0] == ("mask", 0, 0)


def test_modes_share_values_and_gaps(spark):
    texts = ["a@x.com, b@y.org 10.1.2.3 a@x.com", "ñ 4111 1111 1111 1111 y +54 11 4123-4567 d@z.net", "https://a.b/c", None, "", "nada"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    done = rewrite_found(choose_spans(df, text="text"), MODES, text="text", hash_key="k")
    # one step for the spans and one for all modes
    assert done._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 2
    rows = {r.doc_id: r for r in done.collect()}
    assert rows[0].output_pseudo == "«EMAIL_1», «EMAIL_2» «IP_1» «EMAIL_1»"
    for mode in MODES:
        alone = anonymize_docs(df, mode, normalize=False, hash_key="k").collect()
        assert [rows[r.doc_id][f"output_{mode}"] for r in alone] == [r.output for r in alone]


@pytest.mark.parametrize("scope", ["row", "table", ["g"]])
@pytest.mark.parametrize("mode", ["pseudo", "mask", "anon"])
def test_findings_of_another_detector_for_a_table(spark, scope, mode):
    rows = [(1, "g", "Ana Paz", "fue Ana Paz a@b.com"), (2, "h", "Eva", None), (2, "h", "Eva", "con Ana Paz"), (None, "g", "", "Eva x")]
    df = spark.createDataFrame(rows, "id int, g string, name string, note string")
    found = [(1, "name", 0, 7), (1, "note", 4, 11), (2, "name", 0, 3), (2, "note", 4, 11), (None, "note", 0, 3), (9, "note", 0, 3), (1, "other", 0, 3)]
    external = spark.createDataFrame([(*f, None, None, "person") for f in found], "id int, column string, start int, end int, text string, placeholder string, label string")
    done = anonymize_table(df, mode, columns=["name", "note"], order_by=["id"], scope=scope, external=external)
    assert done.data.columns == df.columns
    got = sorted(done.data.collect(), key=repr)
    assert len(got) == 4 and not any(v in (r.name or "") + (r.note or "") for r in got for v in ("Ana", "Paz", "Eva"))
    assert sum("a@b.com" in (r.note or "") for r in got) == 1  # the other detector did not name it
    if (scope, mode) == ("table", "pseudo"):
        assert {r.name for r in got if r.id == 2} == {next(r.note for r in got if r.id is None).split()[0]}
    assert anonymize_table(df, mode, columns=["note"], order_by=["id"], scope=scope, external=external, engine="lite").data.where("note like '%a@b%'").count() == 0


def test_findings_of_another_detector_in_nested_values(spark):
    df = spark.createDataFrame([(1, ("x", ["uno", "Ana Paz"]))], "id int, v struct<a:string,b:array<string>>")
    external = spark.createDataFrame([(1, 2, 0, 7, None, None, "person")], "id int, leaf int, start int, end int, text string, placeholder string, label string")
    done = anonymize_nested(df, ["v"], "typed", order_by=["id"], external=external).data.first().v
    assert (done.a, done.b[0]) == ("x", "uno") and "Ana" not in done.b[1]
    with pytest.raises(ValueError, match="leaf"):
        anonymize_nested(df, ["v"], "typed", order_by=["id"], external=external.drop("leaf"))
    with pytest.raises(ValueError, match="order_by"):
        anonymize_table(df, "typed", columns=["v"], scope="row", external=external)
    with pytest.raises(ValueError, match="external"):
        anonymize_table(df, "typed", columns=["v"], order_by=["id"], engine="ml")


@pytest.mark.parametrize("mode", ["typed", "mask", "hash"])
def test_only_values_of_several_types_meet_beyond_the_row(spark, mode):
    """Text and type make a token, so rows are moved only where a value is found under several types; the first decides."""
    rows = [(1, "a", "Ana and b@x.com"), (2, "a", "Ana and Eva"), (3, None, "Eva"), (4, None, "Ana"), (5, "a", None), (6, "a", "c@y.com")]
    docs = spark.createDataFrame(rows, "id long, g string, t string")
    found = [(1, "t", 0, 3, "Ana", None, "PERSON"), (2, "t", 0, 3, "Ana", None, "EMAIL"), (2, "t", 8, 11, "Eva", None, "PHONE"), (3, "t", 0, 3, "Eva", None, "PERSON"), (4, "t", 0, 3, "Ana", None, "EMAIL")]
    external = spark.createDataFrame(found, "id long, column string, start int, end int, text string, placeholder string, label string")
    options = {"columns": ["t"], "order_by": ["id"], "external": external, "hash_key": b"k"}
    table, groups = (anonymize_table(docs, mode, scope=s, **options).data for s in ("table", ["g"]))
    whole, own = ({r.id: r.t for r in x.collect()} for x in (table, groups))
    assert whole[2].split(" and ")[0] == whole[1].split(" and ")[0] == whole[4] and whole[3] == whole[2].split(" and ")[1]
    assert own[2].split(" and ")[0] == own[1].split(" and ")[0] and whole[5] is None and whole[6] == "c@y.com"
    if mode != "mask":  # which is alike for both types
        assert own[4] != own[1].split(" and ")[0] and own[3] != own[2].split(" and ")[1]
    assert "hashpartitioning" not in table._jdf.queryExecution().executedPlan().toString()
