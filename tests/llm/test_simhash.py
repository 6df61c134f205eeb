import numpy as np
import pandas as pd
import pytest
import xxhash

from veilframe.llm import simhash
from veilframe.llm.simhash import close_edges, components, fingerprint, near_copies, plan_search


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(fps, distance):
    up = {f: f for f in fps}

    def top(f):
        while up[f] != f:
            f = up[f]
        return f

    own = sorted(up)
    for i, a in enumerate(own):
        for b in own[:i]:
            if (a ^ b).bit_count() <= distance:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {f: top(f) for f in own}


def clustered(seed, centres, members):
    rng = np.random.default_rng(seed)
    out = []
    for c in rng.integers(0, 2**63, centres, dtype=np.uint64):
        for _ in range(members):
            f = int(c)
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                f ^= 1 << int(b)
            out.append(f)
    return sorted(set(out) | {0, 1, 2**64 - 1})


def test_fingerprints():
    for text in ("", None, " \n", "A b", "a b c d", "Äx B c D e", "the same words " * 50, "x" * 5000):
        assert fingerprint((text or "").encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("block", [4096, 8])
@pytest.mark.parametrize("distance", [0, 1, 3, 4])
def test_edges_connect_what_all_pairs_connect(spark, monkeypatch, distance, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    fps = clustered(distance, 12, 25)
    sample = np.array(fps, np.uint64)
    plan = plan_search(sample, len(fps), distance)
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    edges = close_edges(spark.createDataFrame(signed, "fp long"), plan, distance)
    pairs = [tuple(int(np.int64(x).view(np.uint64)) for x in r) for r in edges.collect()]
    assert all((a ^ b).bit_count() <= distance for a, b in pairs)
    want = plain_roots(fps, distance)
    roots = {r.node: r.root for r in components(edges).collect()}
    got = {f: roots.get(s, s) for f, (s,) in zip(fps, signed, strict=True)}
    groups = lambda m: sorted(sorted(f for f in m if m[f] == r) for r in set(m.values()))
    assert groups(got) == groups(want)


@pytest.mark.parametrize("m", [1, 2, 3, 4, 5])
def test_every_number_of_groups_finds_all(spark, m):
    fps = clustered(m, 6, 20)
    sample = np.array(fps, np.uint64)
    groups = simhash.bit_groups(sample, m)
    assert sorted(b for g in groups for b in g) == list(range(64))
    if m < 3:
        return  # thresholds of 3 and 4 bits write too many keys for a test
    chosen, _ = simhash.thresholds(sample, groups, len(fps), 4)
    assert sum(chosen) == 4 - m + 1 and min(chosen) >= -1
    plan = [(g, r) for g, r in zip(groups, chosen, strict=True) if r >= 0]
    edges = close_edges(spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long"), plan, 4)
    linked = {int(np.int64(x).view(np.uint64)) for r in edges.collect() for x in r}
    assert linked == {f for f in fps if any(f != g and (f ^ g).bit_count() <= 4 for g in fps)}


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000, 1001), (1001, 1000), (5, 5)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {roots.get(i, i) for i in range(401)} == {0}
    assert roots[1001] == 1000


def test_documents(spark):
    words = [f"w{i}" for i in range(300)]
    near = [*words[:150], "other", *words[151:]]
    rows = [(7, " ".join(words)), (3, " ".join(near)), (9, " ".join(words).upper()), (1, None), (2, ""), (4, "solo text"), (4, "solo text")]
    rows += [(None, " ".join(words)), (None, "alone here")]
    docs = spark.createDataFrame([(a, b, 0, "x") for a, b in rows], "doc_id long, text string, fp int, component_id string")
    got = near_copies(docs).toPandas()
    ids = {int(f) & (2**64 - 1) for f in got["fp"]}
    assert ids == {plain_fingerprint(t) for _, t in rows}
    roots = plain_roots([plain_fingerprint(t) for _, t in rows], 4)
    frame = pd.DataFrame([(i, roots[plain_fingerprint(t)]) for i, t in rows], columns=["i", "r"])
    want = frame.groupby("r")["i"].min()
    expected = sorted(((i, want[r]) for i, r in frame.itertuples(index=False)), key=repr)
    clean = lambda x: None if pd.isna(x) else int(x)
    assert sorted([(clean(a), clean(b)) for a, b in zip(got["doc_id"], got["component_id"], strict=True)], key=repr) == sorted(
        [(clean(a), clean(b)) for a, b in expected], key=repr
    )


def test_empty_table(spark):
    assert near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
