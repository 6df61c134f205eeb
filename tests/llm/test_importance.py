"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from veilframe.llm import importance as module
from veilframe.llm.importance import importance, resample

SCHEMA = "doc_id long, text string"


def plain_features(text, longest):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(own), [" ".join(own[i : i + n]) for n in range(1, longest + 1) for i in range(len(own) - n + 1)]


def plain(rows, target, longest=1, buckets=10_000, percent=10, least=20):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    each = [(i, *plain_features(t, longest)) for i, t in rows]
    here = Counter(bucket(x) for _, _, f in each for x in f)
    there = Counter(bucket(x) for t in target for x in plain_features(t, longest)[1])
    s, t = sum(here.values()), sum(there.values())
    gain = [math.floor(1000 * math.log((there[b] + 1.0) * (t_ := s + float(buckets)) / ((here[b] + 1.0) * (t + float(buckets))))) for b in range(buckets)]
    out = []
    for i, n, f in each:
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[5] = rank
    return sorted(map(tuple, out), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd():
    random.seed(3)
    vocabulary = ["the", "The", "ünï", "x1", "B", "--", "é", "a\tb", "c.d", "\x00q"]
    text = lambda: "\n".join(" ".join(random.choices(vocabulary, k=random.randint(0, 12))) for _ in range(random.randint(0, 6)))
    rows = [(i, text()) for i in range(200)]
    rows += [(300 + i, "common line here\n" + text()) for i in range(100)] + [(None, "same words again " * 9)] * 150
    return rows + [(1, text()), (2, None), (3, ""), (4, "\n\n"), (5, "long line " * 30_000), (6, "w\n" * 20_000), *rows[:20]]


TARGET = ["The ünï x1\nb c", None, "", "common line", "q q q"]


@pytest.mark.parametrize(("longest", "hot"), [(1, 4096), (1, 1), (2, 4096), (3, 4096), (4, 2)])
def test_odd_rows(spark, odd, longest, hot, monkeypatch):
    monkeypatch.setattr(module, "HOT", hot)
    docs = spark.createDataFrame(odd, SCHEMA).selectExpr("*", "1 as weight", "'x' as line", "2 as rank").repartition(6)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string").selectExpr("*", "7 as doc_id")
    assert rows_of(resample(docs, target, longest=longest, buckets=500)) == plain(odd, TARGET, longest, 500)


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "a b")], SCHEMA)
    assert rows_of(resample(nothing, some)) == []
    assert rows_of(resample(some, nothing, least_words=1, percent=100)) == plain([(1, "a b")], [], least=1, percent=100)


def test_features_of_a_line_are_taken_once(spark, odd):
    docs = spark.createDataFrame(odd, SCHEMA)
    lines = module.distinct_lines(module._texts(docs), 1, 100).collect()
    assert len({bytes(r.line) for r in lines}) == len(lines) < sum(r.occurrences for r in lines)


def test_crossing_runs_are_apart_from_those_of_lines(spark):
    rows = [(1, "a b\nc\n\nd e f")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = module.crossing_features(module._texts(df), 3, 1 << 30).first().features
    own = Counter(x for line in "a b,c,d e f".split(",") for x in plain_features(line, 3)[1])
    rest = Counter(plain_features(rows[0][1], 3)[1]) - own
    assert Counter(found) == Counter(zlib.crc32(x.encode()) % (1 << 30) for x in rest.elements())
    assert importance(df, df, longest=3).first().n_features == 6 + 5 + 4
