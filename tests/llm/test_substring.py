import hashlib
import random
from collections import Counter

from veilframe.llm.substring import WINDOW, remove_repeats


def plain(rows):
    """Windows in the order of ids; rows that share an id and differ are kept out of the fixtures."""
    seen, out = {}, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = (text or "").encode().split()
        keep = [True] * len(w)
        for i in range(len(w) - WINDOW + 1):
            first = seen.setdefault(tuple(w[i : i + WINDOW]), (doc, i))
            if first != (doc, i):
                keep[i : i + WINDOW] = [False] * WINDOW
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        out.append((doc, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return Counter(out)


def rows_of(df):
    return Counter(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))


def fixture():
    rng = random.Random(11)
    fresh = iter(range(10**6))
    new = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    passages = [new(n) for n in (19, 20, 21, 35, 60, 200)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            words += new(rng.randrange(12)) + (p if rng.random() < 0.5 else p[a : a + rng.randrange(50)])
        rows.append((i * 3, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(500 + i, rows[i][1]) for i in range(5)]  # copies of whole texts
    rows += [(600, None), (601, ""), (602, " \n"), (603, "é " * 400), (604, " ".join(passages[3])), (None, " ".join(passages[4]))]
    return rows


def test_equals_plain_windows(spark):
    rows = fixture()
    docs = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, h int, n_words string")
    assert rows_of(remove_repeats(docs.repartition(5))) == plain(rows)


def test_flushing_and_partitions_do_not_show(spark, monkeypatch):
    from veilframe.llm import substring

    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(substring, "_FLUSH", 50)
    assert rows_of(remove_repeats(docs)) == plain(rows)


def test_repeated_rows_and_ids(spark):
    text = " ".join(map(str, range(30)))
    other = "z " + text
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (3, other), (3, "a b")], "doc_id long, text string")
    found = Counter((r.doc_id, r.n_words, r.n_removed) for r in remove_repeats(docs).collect())
    assert found == Counter([(1, 30, 0), (1, 30, 0), (2, 30, 30), (3, 31, 30), (3, 2, 0)])


def test_kept_text_and_carried_columns(spark):
    words = [str(i) for i in range(25)]
    rows = [(1, "a\n" + " ".join(words), "s1"), (2, "  b\n" + "\t".join(words) + "\nend", "s2")]
    done = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry=["source"])
    second = done.filter("doc_id = 2").first()
    assert (second.kept_text, second.source, [(f.start, f.length) for f in second.factors]) == ("  b\nend", "s2", [(1, 25)])


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
