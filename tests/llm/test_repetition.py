import random
from collections import Counter

from veilframe.llm.repetition import LEAST_REPEAT, LONGEST_REPEAT, MOST_COVERED, quality_rules


def plain(text):
    """Counts and verdict with quadratic comparisons."""
    text = text or ""
    w = [x for x in text.encode().split()]
    n = len(w)
    longest = [0] * n
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and w[i + k] == w[j + k]:
                k += 1
            longest[i], longest[j] = max(longest[i], k), max(longest[j], k)
    windows = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    again = {j for i in range(n - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    covered = {j for i in range(n) if longest[i] >= LEAST_REPEAT for j in range(i, i + longest[i])}
    lines = [x for x in text.split("\n") if x.encode().split()]
    failed = n < 20 or 100 * len(again) > 30 * n
    most = max(longest, default=0)
    kept = not failed and len(covered) <= MOST_COVERED * n and most <= LONGEST_REPEAT
    chars = sum(len(x.decode()) for x in w)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return n, chars, symbols, len(lines) - len(set(lines)), len(again), failed, kept, len(covered), most


def test_equals_a_plain_version(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "ü #x |\n\n  a\n  a\nb", "a" * 3000, "x " * 3000]
    for size in (5, 19, 20, 40, 150):
        for alphabet in ("a", "ab", "abc", "abcdefghijklmnop"):
            words = [rng.choice(alphabet) for _ in range(size)]
            texts.append(rng.choice([" ", "\n", "  "]).join(words))
            texts.append(" ".join(words + [str(i) for i in range(80)] + words))
    base = " ".join(map(str, range(200)))
    texts += [base, base + " " + base, base + " x " + " ".join(map(str, range(60)))]
    rows = [(i % 30, t, "c", 1) for i, t in enumerate(texts)] + [(None, base, "c", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    short = [r for r in rows if len(r[1] or "") < 5000]
    got = quality_rules(docs.filter("text is null or length(text) < 5000")).drop("repeats").collect()
    assert Counter(map(tuple, got)) == Counter((i, *plain(t)) for i, t, *_ in short)
    long = quality_rules(docs.filter("length(text) >= 5000")).first()
    assert (long.n_words, long.n_repeat_words, long.longest_repeat, long.base_failed) == (3000, 3000, 2999, True)


def test_repeats_name_their_places(spark):
    words = [str(i) for i in range(30)]
    text = " ".join(words[:15] + ["x"] + words[:15] + words[15:])
    row = quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(r.start, r.length) for r in row.repeats] == [(0, 15), (16, 15)]


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0
