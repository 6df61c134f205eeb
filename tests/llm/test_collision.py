import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm.collision import nearest


def plain(rows, queries, k):
    out = []
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    for q in np.flatnonzero(queries):
        score = (x * x[q]).sum(1)
        others = ids != ids[q]
        order = np.lexsort((ids[others], -score[others]))[:k]
        out += [(int(ids[q]), r + 1, int(ids[others][o]), float(score[others][o])) for r, o in enumerate(order)]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 24)) * rng.uniform(0.5, 2, (3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    exact = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    want = plain(exact, np.arange(3000) % 20 == 0, 20)
    assert len(got) == len(want) == 150 * 20
    pairs = {(q, v): s for q, _, v, s in want}
    hits = [r for r in got if (r.query_id, r.vec_id) in pairs]
    assert len(hits) >= 0.9 * len(want)
    assert all(r.score == pairs[r.query_id, r.vec_id] for r in hits)


@pytest.mark.parametrize("kind", ["long", "lognormal"])
def test_recall_of_uneven_norms(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "long":
        x[[7, 1234]] *= [[3], [5]]
    else:
        x *= rng.lognormal(0, 0.5, (4000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, F.col("vec_id") % 100 == 0, 20).collect()
    want = {(q, v) for q, _, v, _ in plain(rows, np.arange(4000) % 100 == 0, 20)}
    assert len(got) == len(want)
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)


def test_ties_few_vectors_and_unusable_ones(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [0.0, 1.0]), (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0])]
    rows += [(100, [inf, 1.0]), (120, [None, 1.0]), (None, [1.0, 1.0]), (5, []), (140, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 1, 1.0), (20, 2, 3, 1.0), (20, 3, 2, 0.0)]
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_blocks_do_not_show(spark, monkeypatch):
    from veilframe.llm import collision

    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(300)] + [(1000 + i, [1.0] * 6) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(collision, "VERIFIED", 1.0)
    monkeypatch.setattr(collision, "BLOCK", 64)
    monkeypatch.setattr(collision, "QUERY_BLOCK", 4)
    got = sorted(tuple(r) for r in nearest(df, F.col("vec_id") % 20 == 0, 10).collect())
    want = sorted(plain(rows, np.array([i % 20 == 0 for i, _ in rows]), 10))
    assert got == want


def test_repeated_query_ids(spark):
    """Equal rows have equal whole lists; rows of one id with other vectors have their own."""
    rows = [(i, [float(i), 1.0, -float(i % 7)]) for i in range(1, 60)] + [(100, [1.0, 0.0, 0.0])] * 2 + [(200, [1.0, 0.0, 0.0]), (200, [0.0, 0.0, 1.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") >= 100, 5).collect()

    def lists(query):
        return sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == query)

    def best(vector, own):
        found = sorted((-sum(a * b for a, b in zip(vector, v)), i) for i, v in rows if i != own)[:5]
        return [(rank, i, -product) for rank, (product, i) in enumerate(found, 1)]

    assert lists(100) == sorted(best([1.0, 0, 0], 100) * 2)
    assert lists(200) == sorted(best([1.0, 0, 0], 200) + best([0, 0, 1.0], 200))
