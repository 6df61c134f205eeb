import random

import pytest

import corpus_pipeline
from veilframe.llm import shingles
from veilframe.llm.simhash import fingerprint


def sets_of(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def staying(rows):
    """Ids of the stage by brute force over all pairs of rows with an id."""
    own = [(i, sets_of(t)) for i, t in rows if i is not None]
    up = list(range(len(own)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(own)):
        for j in range(i):
            if jaccard(own[i][1], own[j][1]) >= 0.8:
                up[top(i)] = top(j)
    least = {}
    for k, (i, _) in enumerate(own):
        least[top(k)] = min(least.get(top(k), i), i)
    return {i for k, (i, _) in enumerate(own) if least[top(k)] == i}


def planted():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, similar = [], []
    for k in range(120):
        words = rng.choices(vocabulary, k=200)
        copy = list(words)
        for at in rng.sample(range(200), 1 + k % 6):  # each changed word takes up to five shingles
            copy[at] = f"x{k}"
        rows += [(2 * k + 1000, " ".join(words)), (2 * k + 1001, " ".join(copy).upper())]
        similar.append(jaccard(sets_of(rows[-1][1]), sets_of(rows[-2][1])))
    chain = rng.choices(vocabulary, k=300)
    for k in range(30):  # neighbours are similar, the ends are not
        rows.append((5000 - k, " ".join(chain)))
        chain[10 * k : 10 * k + 2] = ["y", f"y{k}"]
    rows += [(1, None), (2, " "), (3, "short text"), (4, "Short  text"), (None, rows[0][1]), (7, "one"), (7, "other")]
    return rows, similar


@pytest.mark.parametrize("block", [512, 4])
def test_stage_keeps_what_brute_force_keeps(spark, monkeypatch, block):
    monkeypatch.setattr(shingles, "BLOCK", block)
    rows, similar = planted()
    assert sum(0.8 <= s < 0.95 for s in similar) > 50 and min(similar) < 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert {r.doc_id for r in left if r.doc_id is not None} == staying(rows)
    assert sum(r.doc_id is None for r in left) == 1 and sum(r.doc_id == 7 for r in left) == 2


def test_stage_links_what_op7_links(spark):
    """Texts that differ in little of their length, though in most of their different shingles."""
    refrain = "one and two and three go by " * 100
    rows = [(8, refrain + "here ends the first of them all as it was told"), (3, refrain + "there begins another tale that nobody has heard before now")]
    rows += [(5, "a text of its own that has nothing to do with them"), (9, None), (2, "")]
    prints = [fingerprint(t.encode()) for _, t in rows[:2]]
    assert (prints[0] ^ prints[1]).bit_count() <= 4 and jaccard(*(sets_of(t) for _, t in rows[:2])) < 0.5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [2, 3, 5]
