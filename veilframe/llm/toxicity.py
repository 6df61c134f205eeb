"""Toxicity by two Kneser-Ney language models, one of toxic and one of ordinary documents.

A word pair has the probability

    p_c(w | v) = max(n_c(v, w) - D, 0) / n_c(v) + b(v) * p_c(w)
    p_c(w)     = (1 - B) * k_c(w) / k_c + B * k(w) / k

where ``n_c(v, w)`` is the number of different words before the pair in class c, ``k_c(w)`` that
of different words before w, and ``k(w)`` the latter over both classes. All levels count
continuations, so copies of a passage count once. The weights ``b`` and ``B`` of the lower levels
are shared, and each class model is mixed with the model of both classes together (weight
``SHARED``, and more for rare expressions): what both say with nearly equal probability, such as the everyday words of a
language, then cancels out. Expressions whose two probabilities differ by less than ``MARGIN``, or whose
counts differ by no more than chance (``SURE``), get the shared estimate in both classes; the mix of
languages in the sample would otherwise weigh more than the few words that make a text toxic. The
score is the difference of the two log-likelihoods, divided by a power of the number of different
word pairs that it was summed over, and put through a logistic curve fitted on documents that gave no counts.

Labels are read from a bounded sample (``per_class`` documents of each class, smallest hash of
the id first); entries of the model occur in at least ``1 / capacity`` of all positions, so the
model that travels to the tasks has at most ``2 * capacity`` entries.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, in_batches, texts_of

PER_CLASS = 10_000
CAPACITY = 1 << 19
LEAST = 3  # a pair or word seen less often is left to the shared level
LENGTH_POWER = 0.9
DISCOUNT = 0.75
LOWEST = 0.3  # weight of the lowest, shared level
RARE = 20  # an expression seen so often is half as sure as a frequent one
MARGIN = 2.0  # class probabilities closer than this factor are taken as one
SURE = 3.0  # so many standard deviations must a count lie from the one expected of both classes
SHARED = 0.98  # weight of the model of both classes in either one
_WORD = re.compile(r"\w+")


@dataclass
class ToxicityModel:
    """Tables of the two models; log ratios are worked out once per kept entry."""

    words: dict[str, int]
    word_ratio: np.ndarray  # log p_1(w) / p_0(w)
    pair_keys: np.ndarray  # sorted v * len(words) + w
    pair_ratio: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, text: str) -> tuple[float, int]:
        """Log-likelihood ratio of a text's different word pairs, and how many these are.

        A pair counts once, as in the counts: a line repeated a hundred times says no more than one.
        """
        found = _WORD.findall(text.lower())
        if not found or not self.words:
            return 0.0, 0
        get, size = self.words.get, len(self.words)
        pairs = set(zip(["", *found], found, strict=False))
        ids = np.array([get(w, size) for _, w in pairs], np.int64)
        total = self.word_ratio[ids]  # of an unseen pair: the shared weight of v cancels out
        if len(self.pair_keys):
            keys = np.array([get(v, size) for v, _ in pairs], np.int64) * (size + 1) + ids
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            total = np.where(self.pair_keys[at] == keys, self.pair_ratio[at], total)
        return math.fsum(total), len(pairs)  # fsum: the order of a set must not show

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([s / max(n, 1) ** LENGTH_POWER for s, n in (self.raw(t or "") for t in texts)])
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * x + self.offset, -30, 30)))


def labelled_sample(labels: DataFrame, per_class: int) -> DataFrame:
    """Up to ``per_class`` ids of each class outside fold 0. Ids with two different labels are left out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.filter("doc_id is not null and toxic in (0, 1)").filter(fold_of(5) != 0)
    one = rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
    one = one.filter("toxic = most").select("doc_id", "toxic")
    taken = [one.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return taken[0].unionByName(taken[1])


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different word triples of a task's documents; emitted whenever many have gathered."""
    seen: tuple[set, set] = (set(), set())

    def out() -> Iterator[pa.RecordBatch]:
        for c, own in enumerate(seen):
            if own:
                u, v, w = zip(*own, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c] * len(own), pa.int32()), pa.array(u), pa.array(v), pa.array(w)], names=["c", "u", "v", "w"]
                )
                own.clear()

    for batch in batches:
        for text, c in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            found = _WORD.findall((text or "").lower())
            seen[c].update(zip(["", "", *found], ["", *found], found, strict=False))
            if sum(map(len, seen)) > 1_000_000:
                yield from out()
    yield from out()


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, capacity: int = CAPACITY
) -> ToxicityModel:
    """Learn from labelled documents outside fold 0; fold 1 of 5 fits the curve, the others count.

    Without usable labels every text scores 0.5 less a hair (nothing is called toxic).
    """
    sample = F.broadcast(labelled_sample(labels, per_class))  # at most 2 * per_class rows of two numbers
    known = texts_of(docs).join(sample, "doc_id").withColumn("fold", fold_of(5))
    triples = in_batches(known.filter("fold <> 1").select("text", "toxic"), _triples, "c int, u string, v string, w string")
    triples = triples.groupBy("u", "v", "w").agg(*[F.max((F.col("c") == c).cast("long")).alias(f"n{c}") for c in (0, 1)])
    pairs = triples.groupBy("v", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    pairs = pairs.persist()  # read four times below; computed again where an executor is lost
    try:
        totals = pairs.agg(
            *[F.sum(f"n{c}").alias(f"n{c}") for c in (0, 1)],
            *[F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"k{c}") for c in (0, 1)],
            F.count("*").alias("k"),
        ).first()
        at_least = max(LEAST, -(-((totals.n0 or 0) + (totals.n1 or 0)) // capacity))
        by_word = pairs.groupBy("w").agg(
            F.sum(F.col("n0") + F.col("n1")).alias("n"),
            *[F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"k{c}") for c in (0, 1)],
            F.count("*").alias("k"),
        )
        word_rows = by_word.filter(F.col("n") >= at_least).toPandas()
        by_first = pairs.groupBy("v").agg(
            *[F.sum(f"n{c}").alias(f"n{c}") for c in (0, 1)],
            *[F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"k{c}") for c in (0, 1)],
        )
        first_rows = by_first.filter(F.col("n0") + F.col("n1") >= at_least).toPandas()
        pair_rows = pairs.filter(F.col("n0") + F.col("n1") >= at_least).toPandas()
    finally:
        pairs.unpersist()
    model = _tables(totals, word_rows, first_rows, pair_rows)
    return _calibrate(docs.sparkSession, model, known.filter("fold = 1"))


def _tables(totals, word_rows, first_rows, pair_rows) -> ToxicityModel:
    size = len(word_rows)
    words = {w: i for i, w in enumerate(word_rows["w"])}
    if not size or not totals.k0 or not totals.k1:
        return ToxicityModel({}, np.zeros(1), np.zeros(0, np.int64), np.zeros(0))
    kinds = ("0", "1", "")  # either class, then both together

    def number(rows, name: str, kind: str) -> np.ndarray:
        return (rows[name + kind] if kind or name == "k" else rows[name + "0"] + rows[name + "1"]).to_numpy(float)

    common = word_rows["k"].to_numpy(float) / totals.k
    p = []
    for c in kinds:
        own = np.maximum(word_rows[f"k{c}"].to_numpy(float) - DISCOUNT, 0) / totals[f"k{c}"]
        p.append((1 - LOWEST) * own + LOWEST * common)
    first_rows["k"] = first_rows["k0"] + first_rows["k1"]  # at least the different pairs; both classes count what they share
    v, w = pair_rows["v"].map(words), pair_rows["w"].map(words)
    both = (v.notna() & w.notna()).to_numpy()
    v, w = v[both].astype(np.int64).to_numpy(), w[both].astype(np.int64).to_numpy()
    index = first_rows["v"].map(words)
    known = index.notna().to_numpy()
    at = index[known].astype(int).to_numpy()
    seen, left = np.zeros((3, size + 1)), np.zeros((3, size + 1))  # by first word: its pairs, and what the discount takes
    for i, c in enumerate(kinds):
        seen[i, at] = number(first_rows, "n", c)[known]
        left[i, at] = DISCOUNT * number(first_rows, "k", c)[known]
    weight = left.sum(0) / np.maximum(seen.sum(0), 1)  # what the pairs leave to the words, alike in all three
    q = []
    for i, c in enumerate(kinds):
        held = np.maximum(number(pair_rows, "n", c)[both] - DISCOUNT, 0) / np.maximum(seen[i, v] - left[i, v], 1 - DISCOUNT)
        level = np.where(seen[i, v] > 0, weight[v], 1.0)
        q.append((1 - level) * held + level * p[i][w])

    def ratio(rows, name: str, zero: np.ndarray, one: np.ndarray, all_: np.ndarray, chosen=slice(None)) -> np.ndarray:
        n, seen_toxic = number(rows, name, "")[chosen], number(rows, name, "1")[chosen]
        own = (1 - SHARED) * n / (n + RARE)
        logs = np.log((own * one + (1 - own) * all_) / (own * zero + (1 - own) * all_))
        expected = n * totals[name + "1"] / max(totals[name + "0"] + totals[name + "1"], 1)
        sure = np.abs(seen_toxic - expected) > SURE * np.sqrt(expected)
        return np.where(sure & (np.abs(np.log(one / zero)) > np.log(MARGIN)), logs, 0.0)

    word_ratio = np.append(ratio(word_rows, "k", *p), 0.0)
    keys = v * (size + 1) + w
    order = np.argsort(keys)
    return ToxicityModel(words, word_ratio, keys[order], ratio(pair_rows, "n", *q, both)[order])


def _calibrate(spark: SparkSession, model: ToxicityModel, known: DataFrame) -> ToxicityModel:
    shared = spark.sparkContext.broadcast(model)

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [shared.value.raw(t or "") for t in batch.column("text").to_pylist()]
            x = np.array([s / max(n, 1) ** LENGTH_POWER for s, n in raw], float)
            yield pa.RecordBatch.from_arrays([pa.array(x), batch.column("toxic")], names=["x", "y"])

    rows = in_batches(known.select("text", "toxic"), ratios, "x double, y int").toPandas()  # part of the bounded sample
    x, y = rows["x"].to_numpy(float), rows["y"].to_numpy(float)
    if len(set(y)) < 2:
        model.slope, model.offset = 0.0, -1e-3
        return model
    scale = max(float(x.std()), 1e-9)
    beta = np.zeros(2)
    design = np.stack([x / scale, np.ones_like(x)], 1)
    for _ in range(50):  # Newton steps on the logistic likelihood, slightly ridged so that it has an end
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - 1e-3 * beta
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    model.slope, model.offset = float(beta[0] / scale), float(beta[1])
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1). A null text scores as an empty one.

    The text goes through the tasks once; columns that are already called ``toxicity`` are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 * capacity entries
    kept = docs.drop("toxicity")
    schema = kept.withColumn("toxicity", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "toxicity"])

    return in_batches(kept, run, schema)
