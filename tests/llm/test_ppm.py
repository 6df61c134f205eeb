import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from veilframe.llm.ppm import Lookup, score_documents


def plain_scores(rows, capacity, order=5):
    """The same model with dictionaries and one byte at a time."""
    train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    clean = lambda t: b" ".join((t or "").encode().lower().split())
    grams = Counter()
    for t in train:
        s = b"\xff" * order + clean(t) + b"\xff"
        grams.update(s[i - order : i + 1] for i in range(order, len(s)))
    n = sum(grams.values())
    least = max(1, -(-n // capacity))
    levels = []
    for k in range(order + 1):
        all_ = Counter()
        for g, c in grams.items():
            all_[g[order - k :]] += c
        total, seen = Counter(), defaultdict(dict)
        for g, c in all_.items():
            total[g[:-1]] += c
            if c >= least:
                seen[g[:-1]][g[-1]] = c
        levels.append((total, seen))
    out = []
    for _, t in rows:
        s = b"\xff" * order + clean(t) + b"\xff"
        score = 0.0
        for i in range(order, len(s)):
            excluded = set()
            for k in range(order, -1, -1):
                total, seen = levels[k]
                context = s[i - k : i]
                own = seen.get(context)
                if not own:
                    continue
                whole = total[context] - sum(own[x] for x in excluded) + len(own) - len(excluded)
                if s[i] in own:
                    score += math.log10(own[s[i]] / whole)
                    break
                lost = total[context] - sum(own.values()) + len(own) - len(excluded)
                if whole > 0:
                    score += math.log10(max(lost, 1e-9) / max(whole, 1e-9))
                excluded = set(own)
            else:
                score -= math.log10(256 - len(levels[0][1].get(b"", {})))
        out.append(score)
    return out


def plain_base(rows):
    train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    below = n + 0.5 * (v + 1)
    return [(len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.5) / below) for w in tokens(t))) for _, t in rows]


def test_equals_a_plain_model(spark, monkeypatch):
    from veilframe.llm import ppm

    rng = np.random.default_rng(3)
    words = ["the", "then", "there", "Other", "ünder", "a", "b", "zz", "other,"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(60)]
    rows += [(5, rows[5][1]), (6, "another text of the same id"), (None, "the other"), (61, None), (62, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("missing", "n")
    monkeypatch.setattr(ppm, "COMMON", 20)
    for capacity in (1 << 20, 200):
        monkeypatch.setattr(ppm.fit_trie, "__defaults__", (capacity,))
        got = sorted(map(tuple, score_documents(docs).collect()), key=repr)
        scores, base = plain_scores(rows, capacity), plain_base(rows)
        held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
        want = sorted(((i, h, *b, s) for (i, _), h, b, s in zip(rows, held, base, scores, strict=True)), key=repr)
        assert len(got) == len(want)
        for g, w in zip(got, want, strict=True):
            assert g[:5] == w[:5]
            assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_empty_table_and_no_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, score double, fold int")
    assert score_documents(empty).count() == 0
    alone = score_documents(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert (alone.n_tokens, alone.n_known, alone.train_tokens, alone.held_out) == (3, 0, 0, False)
    assert alone.score == pytest.approx(-4 * math.log10(256))


def test_lookup_finds_all_and_nothing_else():
    keys = np.arange(0, 50_000, 7, dtype=np.uint64) * np.uint64(2**20)
    found = Lookup(keys).find(np.arange(0, 50_000, dtype=np.uint64) * np.uint64(2**20))
    assert (found[::7] == np.arange(len(keys))).all()
    assert (np.delete(found, np.arange(0, 50_000, 7)) == -1).all()


def test_rare_contexts_count_in_a_large_corpus(spark):
    # over 2^20 training positions: contexts seen once were dropped from there on
    rows = [(i, "the cat sat on the mat " * 5_000) for i in range(16)]
    rows += [(20, "a zebra quartz"), (21, "my zebra quartz jug"), (22, None), (23, "the zebras")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in score_documents(docs).collect()}
    assert len(got) == len(rows)
    want = plain_scores(rows, 1 << 60)
    for (i, _), w in zip(rows, want, strict=True):
        assert got[i] == pytest.approx(w, rel=1e-9)


def test_what_is_sent_changes_no_score(spark, monkeypatch):
    from veilframe.llm import ppm

    rng = np.random.default_rng(5)
    words = ["the", "then", "there", "Other", "ünder", "a", "b", "zz", "other,"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 20)))) for i in range(40)]
    rows += [(4, rows[4][1]), (7, rows[7][1] + " 12"), (None, "quite the other"), (None, "quite the other"), (61, None), (62, "\U0001f600")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ppm, "COMMON", 2)
    want = sorted(((repr(i), *b, s) for (i, _), b, s in zip(rows, plain_base(rows), plain_scores(rows, 1 << 60), strict=True)))
    for sent in (0, 40):
        monkeypatch.setattr(ppm, "SENT", sent)
        got = sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in score_documents(docs).collect())
        assert len(got) == len(want)
        for g, w in zip(got, want, strict=True):
            assert g[:4] == w[:4]
            assert g[4:] == pytest.approx(w[4:], rel=1e-9)
