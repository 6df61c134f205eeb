import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilframe.llm import langid
from veilframe.llm.common import fold_of
from veilframe.llm.langid import fit_languages, identify_languages, ngrams, words_of

SYLLABLES = {"aa": ["ka", "mo", "ti"], "bb": ["sch", "ung", "ei"], "cc": ["zo", "qui", "é"]}


def rows_of(n=400):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(2, 40))]
        rows.append((i, " ".join(words), lang, "x"))
    return rows


def test_held_out_accuracy_and_odd_texts(spark):
    rows = rows_of()
    odd = [(900, None, "aa", ""), (901, "123 ...", "aa", ""), (902, "", "bb", ""), (903, "katikatikamo" * 500, None, ""), (None, "schungei", "bb", "")]
    docs = spark.createDataFrame([*rows, *odd, odd[3]], "doc_id long, text string, lang string, score string")
    model = fit_languages(docs, fold_of(4) != 2)
    got = identify_languages(docs, model).collect()
    known = {r.doc_id: r for r in got}
    right = sum(known[i].lang_pred == lang for i, _, lang, _ in rows)
    assert right >= 0.98 * len(rows) and len(got) == len(rows) + 6
    assert [known[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "aa", "bb"]
    assert all(0 <= r.score <= 1 for r in got)


def test_unseen_words_fall_back_to_characters(spark):
    docs = spark.createDataFrame(rows_of(), "doc_id long, text string, lang string, source string")
    model = fit_languages(docs, F.lit(True))
    new = spark.createDataFrame([(1, "momomomomomo"), (2, "UNGEISCHEIEIEI"), (3, "漢字")], "doc_id long, text string")
    assert "momomomomomo" not in model.words
    assert [r.lang_pred for r in identify_languages(new, model).orderBy("doc_id").collect()][:2] == ["aa", "bb"]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "ab", None)], "doc_id long, text string, lang string")
    model = fit_languages(docs, F.lit(True))
    assert identify_languages(docs, model).first().lang_pred == "und"
    assert identify_languages(docs.limit(0), model).count() == 0


def test_texts_of_number_signs_have_no_language(spark):
    rows = [(1, "house garden", "x"), (2, "maison jardin", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(docs, docs.text.isNotNull())
    odd = spark.createDataFrame([(1, "\u00bd \u00b2"), (2, "\u2167 3"), (3, "\u00bd house")], "doc_id long, text string")
    assert [r.lang_pred for r in identify_languages(odd, model).orderBy("doc_id").collect()] == ["und", "und", "x"]


def plain(rows, teaching):
    """The same rules over dictionaries: a judge of one text."""
    words, grams = {}, {}
    for _, text, lang, _ in teaching:
        words.setdefault(lang, Counter()).update(words_of(text))
    for lang, own in words.items():
        for n in range(1, 6):
            grams.setdefault(n, {})[lang] = Counter(g for w in own for g in ngrams(w, n))
    order = sorted(words, key=lambda x: (-sum(words[x].values()), x))

    def log(tables, key, lang):
        different = len(set().union(*tables.values()))
        return math.log((tables[lang][key] + 0.5) / (sum(tables[lang].values()) + 0.5 * different))

    def of_word(word, lang):
        if any(word in own for own in words.values()):
            return log(words, word, lang)
        for n in range(5, 0, -1):
            known = [g for g in ngrams(word, n) if any(g in own for own in grams[n].values())]
            if known:
                return sum(log(grams[n], g, lang) for g in known) / len(known)
        return 0.0

    def judge(text):
        found = words_of(text or "")
        if not found:
            return "und", 0.0
        totals = [sum(of_word(w, lang) for w in found) for lang in order]
        best = max(totals)
        return order[totals.index(best)], 1 / sum(math.exp(t - best) for t in totals)

    return [judge(text) for _, text, *_ in rows]


def odd_rows():
    texts = ["", None, "1 2", "xyzzy kazo", "kakaschka quimo zz", "漢字", "tieiqui " * 50, "momomomo ungzo", "momomomo ungzo"]
    return [(1000 + i, t, None, "") for i, t in enumerate(texts)]


@pytest.mark.parametrize(("capacity", "sent"), [(1, 0), (40, 1 << 27), (1 << 18, 0)])
def test_equals_the_plain_rules_whatever_is_broadcast(spark, monkeypatch, capacity, sent):
    monkeypatch.setattr(langid, "SENT_BYTES", sent)
    rows = rows_of(60)
    asked = [*rows, *odd_rows()]
    taught = spark.createDataFrame(rows[:30], "doc_id long, text string, lang string, source string")
    docs = spark.createDataFrame(asked, "doc_id long, text string, lang string, a string")
    model = fit_languages(taught, F.lit(True), capacity)
    assert len(model.words) <= capacity
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_languages(docs, model).collect()}
    assert len(got) == len(asked)
    for (i, *_), (lang, score) in zip(asked, plain(asked, rows[:30]), strict=True):
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-5)


def test_capacity_changes_no_bit(spark):
    docs = spark.createDataFrame([*rows_of(120), *odd_rows()], "doc_id long, text string, lang string, source string")
    done = []
    for capacity in (1, 1 << 18):
        model = fit_languages(docs, fold_of(4) != 2, capacity)
        done.append(sorted(map(tuple, identify_languages(docs, model).collect())))
    assert done[0] == done[1]
