import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from veilframe.llm.toxicity import DISCOUNT, LEAST, LOWEST, MARGIN, RARE, SHARED, SURE, fit_toxicity, labelled_sample, score_toxicity

BAD = ["vile", "rotten", "scummy", "foul"]


def corpus(n=1500):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        own = [words[int(300 * rng.random() ** 2)] for _ in range(rng.randrange(40, 200))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(max(3, len(own) // 25)):
                own.insert(rng.randrange(len(own)), rng.choice(BAD))
        rows.append((i, " ".join(own), "score", 1))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, toxicity int")
    marks = spark.createDataFrame([*labels, (1, 0, 1), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = fit_toxicity(docs, marks)
    got = {r.doc_id: r.toxicity for r in score_toxicity(docs, model).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == (i % 5 == 0) for i in held)
    assert right >= 0.98 * len(held)
    assert all(0 <= s <= 1 for s in got.values())


def test_repeating_a_toxic_text_does_not_clear_it(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    toxic = [t for i, t, *_ in rows if i % 5 == 0]
    once = model.scores(toxic)
    found = once >= 0.5
    assert found.mean() > 0.95
    for times in (10, 100):
        again = model.scores([" ".join([t] * times) for t in toxic])
        assert (again[found] >= 0.5).all()
        assert abs(again - once).max() < 0.1


def test_sample_is_bounded_and_leaves_out_the_held_out_and_the_contradictory(spark):
    rows = [(i, i % 2) for i in range(200)] + [(3, 0), (None, 1), (4, None)]
    sample = labelled_sample(spark.createDataFrame(rows, "doc_id long, toxic int"), 20).collect()
    assert sorted(r.toxic for r in sample) == [0] * 20 + [1] * 20
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id != 3 for r in sample)


def test_odd_texts_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "x"), (2, ""), (3, "vile " * 5000), (4, "!?")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = fit_toxicity(docs, none)
    assert {r.toxicity < 0.5 for r in score_toxicity(docs, model).collect()} == {True}
    assert score_toxicity(docs.limit(0), model).count() == 0
    assert score_toxicity(docs, model).count() == 6


def plain_ratios(texts, toxic):
    """The log ratio of any word pair (v, w), from nested counts; one expression at a time."""
    before = defaultdict(lambda: (set(), set()))  # of a pair, by class: the words before it
    for text, c in zip(texts, toxic, strict=True):
        found = re.findall(r"\w+", (text or "").lower())
        for i, w in enumerate(found):
            u, v = (found[i - 2] if i > 1 else ""), (found[i - 1] if i else "")
            before[v, w][c].add(u)
    n = {pair: [len(x) for x in own] for pair, own in before.items()}
    n = {pair: [a, b, a + b] for pair, (a, b) in n.items()}
    lefts, rights = defaultdict(list), defaultdict(list)
    for (v, w), counts in n.items():
        rights[v].append(counts)
        lefts[w].append(counts)
    often = lambda rows: sum(r[2] for r in rows) >= LEAST
    different = lambda rows: [sum(r[c] > 0 for r in rows) for c in (0, 1, 2)]
    all_k, all_n = different(n.values()), [sum(r[c] for r in n.values()) for c in (0, 1, 2)]

    def word(w, c):
        k = different(lefts[w])
        return (1 - LOWEST) * max(k[c] - DISCOUNT, 0) / all_k[c] + LOWEST * k[2] / all_k[2]

    def pair(v, w, c):
        rows = rights[v] if often(rights[v]) else []
        seen = [sum(r[i] for r in rows) for i in (0, 1, 2)]
        k = different(rows)
        left = [DISCOUNT * x for x in (k[0], k[1], k[0] + k[1])]
        backoff = sum(left) / max(sum(seen), 1) if seen[c] else 1.0
        held = max(n[v, w][c] - DISCOUNT, 0) / max(seen[c] - left[c], 1 - DISCOUNT)
        return (1 - backoff) * held + backoff * word(w, c)

    def ratio(p, count, count_toxic, toxic_share):
        own = (1 - SHARED) * count / (count + RARE)
        expected = count * toxic_share
        if abs(count_toxic - expected) <= SURE * math.sqrt(expected) or abs(math.log(p[1] / p[0])) <= math.log(MARGIN):
            return 0.0
        return math.log((own * p[1] + (1 - own) * p[2]) / (own * p[0] + (1 - own) * p[2]))

    def of(v, w):
        if w not in lefts or not often(lefts[w]):
            return 0.0
        if (v, w) in n and n[v, w][2] >= LEAST and v in lefts and often(lefts[v]):
            return ratio([pair(v, w, c) for c in (0, 1, 2)], n[v, w][2], n[v, w][1], all_n[1] / all_n[2])
        k = different(lefts[w])
        return ratio([word(w, c) for c in (0, 1, 2)], k[2], k[1], all_k[1] / (all_k[0] + all_k[1]))

    return of


def test_ratios_and_curve_equal_brute_force(spark):
    rows, labels = corpus(500)
    rows = [(i, t) for i, t, *_ in rows] + [(9001, None), (9002, ""), (9003, "Vile VILE one"), (9003, "vile one two")]
    labels = [x[::2] for x in labels] + [(9001, 1), (9002, 0), (9003, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    fold, marked = (lambda i: zlib.crc32(str(i).encode()) % 5), dict(labels)
    taught = [(t, marked[i]) for i, t in rows if i in marked and fold(i) > 1]
    of = plain_ratios(*zip(*taught, strict=True))

    def raw(text):
        found = re.findall(r"\w+", (text or "").lower())
        pairs = set(zip(["", *found], found, strict=False))
        return sum(of(v, w) for v, w in pairs), len(pairs)

    want = {t: raw(t) for _, t in rows}
    assert sum(abs(x) > 0.1 for x, _ in want.values()) > 50
    for text, (total, size) in want.items():
        assert model.raw(text or "") == (pytest.approx(total, abs=1e-9), size)
    # the curve lies where the likelihood of the documents of fold 1 is greatest
    curve = [(raw(t), marked[i]) for i, t in rows if i in marked and fold(i) == 1]
    curve = [(x / max(size, 1) ** 0.9, y) for (x, size), y in curve]
    likelihood = lambda a, b: sum(-math.log1p(math.exp(-(2 * y - 1) * (a * x + b))) for x, y in curve)
    best = likelihood(model.slope, model.offset)
    for a, b in ((1.1, 0), (0.9, 0), (1, 0.5), (1, -0.5)):
        assert likelihood(model.slope * a, model.offset + b) < best + 1e-2
