"""User rules."""

import random
import re
import time

import plain
import pytest
import regex
from test_detect import PIECES

from veilframe.functions.python_side import fold_key
from veilframe.functions.rules import Rules, native_fold, parse_list, parse_patterns, plain_pattern
from veilframe.functions.sql import expr
from veilframe.operators.anonymize import anonymize_docs
from veilframe.operators.tables import anonymize_table
from veilframe.operators.detect import detect_docs, with_spans
from veilframe.sources.rules_table import drop_exempt_spans, load_rules, rules_of, rules_status


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def found(spark, rules, *texts):
    rows = with_spans(docs(spark, *texts), rules=rules).orderBy("doc_id").collect()
    return [[(s.label, s.text) for s in r.spans] for r in rows]


def test_always_and_never(spark):
    rules = {"always": ["Proyecto Fenix"], "never": ["ana@x.com"]}
    spans = found(spark, rules, "Proyecto Fenix con juan@acme.com y ana@x.com")
    assert spans == [[("CUSTOM", "Proyecto Fenix"), ("EMAIL", "juan@acme.com")]]


def test_term_becomes_a_token(spark):
    done = anonymize_docs(docs(spark, "El proyecto FENIX arranca"), rules={"always": [" Fenix ", ""]})
    assert done.first().output == "El proyecto «DATO_1» arranca"


def test_no_rules_change_nothing(spark):
    text = "mail juan@acme.com"
    assert found(spark, {}, text) == found(spark, None, text) == found(spark, "", text) == [[("EMAIL", "juan@acme.com")]]


def test_pattern_with_placeholder(spark):
    rules = {"patterns": [{"regex": r"LEG-\d{4}", "placeholder": "ID"}]}
    assert anonymize_docs(docs(spark, "empleado LEG-1234 en el sistema"), rules=rules).first().output == "empleado «ID_1» en el sistema"


def test_bad_patterns_are_refused_with_a_reason(spark):
    rules = {"patterns": [{"regex": "([a-z"}, "x", {"regex": ""}, {"regex": "x*"}, {"regex": 5}, None]}
    assert found(spark, rules, "mail juan@acme.com") == [[("EMAIL", "juan@acme.com")]]
    status = {r.regex: (r.accepted, r.reason[:11]) for r in rules_status(spark, rules).collect()}
    assert status["([a-z"] == (False, "not a regex") and status["x*"] == (True, "")
    assert {status[k][1] for k in ("x", "None")} == {"no regex"}


def test_a_table_of_patterns_is_judged_where_it_lies(spark, monkeypatch):
    listed = ["([a-z", "x*", "", None, "(x|y)", "x*", "b" * 300]
    want = [tuple(r) for r in rules_status(spark, {"patterns": [{"regex": x} for x in listed]}).collect()]
    table = spark.createDataFrame([(x, 1) for x in listed], "regex string, ord int").repartition(3)
    monkeypatch.setattr("pyspark.sql.DataFrame.toLocalIterator", None)
    got = [tuple(r) for r in rules_status(spark, table).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_many_and_long_patterns_all_count(spark):
    rules = {"patterns": [{"regex": f"key{i:03d}z"} for i in range(70)] + [{"regex": "b" * 300}]}
    assert found(spark, rules, "key069z " + "b" * 300) == [[("CUSTOM", "key069z"), ("CUSTOM", "b" * 300)]]


def test_no_pattern_is_dropped_without_the_timed_engine(monkeypatch):
    monkeypatch.setattr("veilframe.functions.rules.timed_regex", None)
    assert len(Rules.parse({"patterns": [{"regex": r"LEG-\d{4}"}]}).patterns) == 1
    with pytest.raises(RuntimeError):
        Rules.parse({"patterns": [{"regex": "(a|b)"}]})


@pytest.mark.parametrize("regex", ["a?" * 30 + "a" * 30, "a{0,99}" * 6 + "b", "[a-z ]+@"])
def test_hostile_patterns_end_and_say_so(spark, regex):
    text = "a" * 200_000
    start = time.time()
    done = anonymize_docs(docs(spark, text, "x@y.com"), "mask", rules={"patterns": [{"regex": regex}]}).select("doc_id", "incomplete")
    rows = {r.doc_id: r.incomplete for r in done.collect()}
    assert rows[1] == [] and rows[0] in ([], [regex])
    assert time.time() - start < 30


def test_a_pattern_out_of_time_ends_a_job_that_cannot_say_so(spark):
    df = spark.createDataFrame([(1, "a" * 60 + "!")], "id int, text string")
    done = anonymize_table(df, "mask", columns=["text"], scope="row", order_by=["id"], rules={"patterns": [{"regex": "(a|a)+$"}]})
    with pytest.raises(Exception, match="took more than"):
        done.data.collect()


def test_costly_pattern_is_cut_off(spark):
    start = time.time()
    rules = {"patterns": [{"regex": "(a|a)+$"}, {"regex": "(?<=x)b+"}]}
    row = anonymize_docs(docs(spark, "a" * 60 + "! xbbb"), rules=rules).first()
    assert [(s.label, s.text) for s in row.spans] == [("CUSTOM", "bbb")] and row.incomplete == ["(a|a)+$"]
    assert time.time() - start < 20


def test_malformed_rules_raise():
    with pytest.raises(ValueError):
        Rules.parse("{no-json")


def test_placeholder_names(spark):
    rules = {"patterns": [{"regex": "AB1", "placeholder": "PHONE"}, {"regex": "AB2", "label": "Legajo 7"}, {"regex": "AB3", "placeholder": " "}]}
    assert found(spark, rules, "AB1 AB2 AB3") == [[("TEL", "AB1"), ("LEGAJO", "AB2"), ("CUSTOM", "AB3")]]


def test_always_beats_never_and_second_propagation_covers_exempt_text(spark):
    rules = {"always": ["acme"], "never": ["juan@acme.com", "acme"]}
    assert found(spark, rules, "juan@acme.com") == [[("CUSTOM", "acme")]]


def test_never_folds_unicode(spark):
    text = "ver http://a.b/straße?x http://a.b/É y http://a.b/K"
    ascii_rules = {"never": ["HTTP://A.B/STRASSE?x", "http://a.b/k"]}
    assert found(spark, ascii_rules, text) == [[("URL", "http://a.b/É")]]
    decomposed = {"never": ["http://a.b/É"]}
    assert [s[1] for s in found(spark, decomposed, text)[0]] == ["http://a.b/straße?x", "http://a.b/K"]


def test_native_fold_agrees_where_the_key_is_ascii(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice([*PIECES, "ß", "ﬁ", "ﬆ", "Ǆ", ";", "Å", "Å"]) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", expr(native_fold("t")).alias("f")).collect():
        key = fold_key(row.t)
        if key.isascii() or row.f.isascii():
            assert row.f == key, repr(row.t)


def test_terms_in_any_case_and_with_special_characters(spark):
    rules = {"always": ["C++ (x)", "ñandú", r"a\Eb", "it's", "tab\x01le"]}
    text = "c++ (X) ÑANDÚ A\\eB IT'S tab\x01LE"
    assert [s[1] for s in found(spark, rules, text)[0]] == ["c++ (X)", "ÑANDÚ", "A\\eB", "IT'S", "tab\x01LE"]


def test_many_terms_are_planned_once(spark):
    terms = [f"term{i:04d}" for i in range(5000)]
    start = time.time()
    df = with_spans(docs(spark, "a TERM0007 b term4999x", "é Term0001"), rules={"always": terms})
    df._jdf.queryExecution().executedPlan()
    assert time.time() - start < 20
    rows = df.orderBy("doc_id").collect()
    assert [[s.text for s in r.spans] for r in rows] == [["TERM0007", "term4999"], ["Term0001"]]


def test_rules_against_plain_python(spark):
    """Random rules over random texts; both the native and the timed patterns."""
    rng = random.Random(9)
    patterns = [r"\d{2,3}-\d+", r"[A-Za-z]+@", r"x ?\.y", r"(?:com|org)\b", r"\w{3}[0-9]?", r"(\d)\1"]
    for round_ in range(4):
        chosen = rng.sample(patterns, 3)
        rules = {
            "always": rng.sample(["acme", "4123", "x.o", "É", " dni"], 2),
            "never": rng.sample(["juan@acme.com", "10.0.0.255", "4123-4567", "É@x.com"], 2),
            "patterns": [{"regex": p, "placeholder": f"P{'ABC'[i]}"} for i, p in enumerate(chosen)],
        }
        texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 12))) for _ in range(300)]
        parsed = Rules.parse(rules)
        for row in with_spans(docs(spark, *texts), rules=rules).collect():
            never = set(parsed.never)
            spans = [s for s in plain.detect(row.text) if fold_key(s[3]) not in never]
            for term in parsed.always:
                spans += [("CUSTOM", *m.span(), m[0]) for m in re.finditer(re.escape(term), row.text, re.I)]
            for p in parsed.patterns:
                spans += [(p.name, *m.span(), m[0]) for m in regex.finditer(p.regex, row.text) if m[0]]
            want = plain.finalize(row.text, spans, {**plain.PRIORITY, "CUSTOM": 100})
            assert [tuple(s) for s in row.spans] == want, (row.text, rules)


@pytest.mark.parametrize("pattern", [r"LEG-\d{4}", "abc", r"[A-Z]{2}[0-9]+", "a{2,3}b?", "a{0,9}b"])
def test_plain_patterns(pattern):
    assert plain_pattern(pattern) is not None


@pytest.mark.parametrize("pattern", ["(a|a)+$", "a?a", "a?b?a", "[a-z]+@", r"\d+\d+", "a|b", r"(\d)\1", "a*?b", r"\bx", "^a", "a{3,1}", "[z-a]", ".", r"\w"])
def test_patterns_that_need_a_time_limit(pattern):
    assert plain_pattern(pattern) is None


def test_typed_entries():
    assert parse_list(" a, ,b ,") == ["a", "b"]
    assert parse_patterns('[{"regex": "a"}, {"regex": 1}, 5]') == [{"regex": "a"}]
    assert parse_patterns('{"patterns": [{"regex": "b"}]}') == [{"regex": "b"}]
    assert parse_patterns("nope") == parse_patterns("") == parse_patterns('{"patterns": 3}') == parse_patterns("7") == []


def test_rules_from_tables(spark):
    typed = spark.createDataFrame(
        [(" a, ,b", "", '[{"regex": "r", "placeholder": "ID"}, {"regex": 5}]'), (None, "x", "{bad")],
        "always string, never string, patterns string",
    )
    rows = load_rules(typed).collect()
    assert (rows[0].always, rows[0].never) == (["a", "b"], [])
    assert [tuple(p) for p in rows[0].patterns] == [("r", "ID")]
    assert (rows[1].always, rows[1].never, rows[1].patterns) == ([], ["x"], [])
    terms = spark.createDataFrame([("Fenix",)], "term string")
    patterns = spark.createDataFrame([(r"L\d", "ID")], "regex string, placeholder string")
    parsed = rules_of(always=terms, never=terms, patterns=patterns)
    assert parsed.always == ("Fenix",) and parsed.never == ("fenix",) and parsed.patterns[0].name == "ID"


def test_exempt_table(spark):
    spans = detect_docs(docs(spark, "a@b.com http://x/É c@d.com"))
    never = spark.createDataFrame([("A@B.COM",), ("HTTP://X/é",), (" ",)], "term string")
    assert [r.text for r in drop_exempt_spans(spans, never).collect()] == ["c@d.com"]


def _both_ways(spark, rows, listed, rules=None, **options):
    """Spans by a list of terms in the plan, and by a table of them."""
    from veilframe.operators import detect, terms as module

    table = spark.createDataFrame([(t,) for t in listed], "term string")
    typed = {**(rules or {}), "always": [t for t in listed if t is not None]}
    own = detect.with_term_candidates
    detect.with_term_candidates = lambda *a: module.with_term_candidates(*a, **options)
    try:
        joined = with_spans(rows, rules=rules, always=table).collect()
    finally:
        detect.with_term_candidates = own
    return [sorted((repr(r.doc_id), r.spans) for r in found) for found in (with_spans(rows, rules=typed).collect(), joined)]


@pytest.mark.parametrize("sent", [0, 64 << 20])
def test_a_table_of_terms_finds_what_a_list_finds(spark, sent):
    texts = ["Proyecto FENIX con juan@acme.com", "proyecto fenixproyecto fenix", "", None, "a", "x.Y*z (b\\Ed) \\E", "ſTRASSE straſſe Kelvin KELVIN ıstanbul İstanbul",
             "ñandú ÑANDÚ ÑANDÚ corre", "𝒜bc😀DEF 😀def", "tab\there", "\x01marks\x02 here", "aaaaaaaaaaaa", "juan@acme.com.ar juan@ACME.com", None, "a"]
    listed = ["proyecto fenix", "Proyecto", " juan@acme.com ", "", "  ", None, "a", "A", "x.y*Z", "b\\Ed", "\\E", "strasse", "straſſe", "kelvin", "istanbul",
              "ñandú corre", "ÑANDÚ", "😀DEF", "😀", "b\there", "aaaaaaa", "aaaaaaab", "proyecto fenix"]
    rows = spark.createDataFrame([(i if i % 4 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want, got = _both_ways(spark, rows, listed, {"never": ["juan@acme.com"], "patterns": [{"regex": r"fe[a-z]{1,3}"}]}, sent=sent)
    assert got == want and sum(len(spans or []) for _, spans in got) > 20
    want, got = _both_ways(spark, rows, ["", None], sent=sent)
    assert got == want
    want, got = _both_ways(spark, rows.limit(0), listed, sent=sent)
    assert got == want == []


def test_random_terms_as_a_table(spark):
    import random

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abAB ñÑ1") for _ in range(n))
    rows = spark.createDataFrame([(i, word(rng.randrange(60))) for i in range(60)], "doc_id long, text string")
    want, got = _both_ways(spark, rows, [word(rng.randrange(9)) for _ in range(80)])
    assert got == want and sum(len(spans) for _, spans in got) > 100


def test_a_hundred_thousand_terms(spark):
    terms = spark.range(100_000).selectExpr("concat('legajo número ', id) as term")
    rows = spark.createDataFrame([(1, "LEGAJO NÚMERO 99999, legajo número 5x"), (2, "nada")], "doc_id long, text string")
    done = {r.doc_id: r.output for r in anonymize_docs(rows, "typed", always=terms).collect()}
    assert done == {1: "[DATO], [DATO]x", 2: "nada"}


def test_terms_that_hold_a_mark_are_an_error(spark):
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException, match="control character"):
        with_spans(docs(spark, "x"), always=spark.createDataFrame([("a\x01b",)], "term string")).collect()


def test_texts_stay_where_they_are_beside_a_table_of_terms(spark):
    terms = spark.createDataFrame([("proyecto fenix",)], "term string")
    plan = with_spans(docs(spark, "proyecto fenix", "y"), always=terms)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Python" not in plan


def test_terms_beyond_the_limit_never_pass_through_the_driver(spark):
    """A table whose packed shuffle files look small was sent all the same."""
    from veilframe.operators.terms import with_term_candidates

    terms = spark.createDataFrame([(f"proyecto {i}",) for i in range(50)], "term string")
    rows = spark.createDataFrame([(i, f"de proyecto {i % 7} y") for i in range(40)], "doc_id long, text string")
    found = with_term_candidates(rows, terms, "text", "terms", sent=0)
    assert sorted((r.doc_id, "proyecto " + str(r.doc_id % 7) in r.terms) for r in found.collect()) == [(i, True) for i in range(40)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
