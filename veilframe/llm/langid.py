"""Language of a text: words first, character n-grams for words never seen.

A known word adds the logarithm of its relative frequency in each language. An unseen word is
judged by its character n-grams, with marks at its ends: by the longest length of which any is
known, else one shorter, down to single characters. A word none of whose characters is known says
nothing. Counts are taken over all labelled documents, and every word and n-gram is kept in a table.
The most frequent words, at most ``CAPACITY`` of them, also travel to the tasks; the others are joined, once per different text of a task. Logarithms are whole numbers (of 2^-30),
whose sums do not depend on order, so ``capacity`` changes no result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.durable import stored
from .common import in_batches, shared_folder, texts_of

CAPACITY = 1 << 18
SENT_BYTES = 1 << 27  # of n-grams; larger tables are shuffled
LONGEST = 5
SMOOTHING = 0.5
UNIT = float(1 << 30)
CACHED_WORDS = 400_000
CACHED_TEXTS = 400_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def ngrams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _kept(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder, as checkpoints are not compressed."""
    return stored(df, shared_folder(df.sparkSession, "languages"))


@dataclass
class LanguageModel:
    languages: list[str]  # by number of words, most first: the order that settles ties
    words: dict[str, int]  # the frequent words
    word_logs: np.ndarray  # a row per frequent word, a column per language
    word_table: DataFrame | None  # word, counts: all words
    totals: list[float]  # smoothed sums of the words' counts
    gram_table: DataFrame | None  # gram, logs: all n-grams; their lengths are those of the strings
    grams: int = 0  # rows of gram_table


class Reader:
    """Frequent words of texts are added up, the others are counted."""

    def __init__(self, words: dict[str, int], logs: np.ndarray) -> None:
        self.words, self.size = words, len(words)
        self.logs = np.concatenate((logs, np.zeros((1, logs.shape[1]), np.int64)))
        self.clear()

    def clear(self) -> None:
        self.row = dict(self.words)
        self.names: list[str] = []

    def read(self, text: str | None) -> tuple[bool, np.ndarray, list[str], np.ndarray]:
        """Whether there is a letter, the frequent words' sums, and the other words with their counts."""
        words = words_of(text) if text else []
        for word in set(words).difference(self.row):
            self.row[word] = self.size + len(self.names)
            self.names.append(word)
        rows = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
        sums = self.logs[np.minimum(rows, self.size)].sum(0)
        other, counts = np.unique(rows[rows >= self.size], return_counts=True)
        # a word of the pattern may be made of number signs alone, as a half or a square
        letters = any(map(str.isalpha, chain.from_iterable(words)))
        return letters, sums, [self.names[i - self.size] for i in other], counts


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            columns = [pa.array([lang] * len(own)), pa.array(list(own)), pa.array(list(own.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(words_of(text or ""))
        if sum(map(len, counts.values())) > 500_000:
            yield from out()
    yield from out()


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            columns = [pa.array([lang] * len(own)), pa.array(list(own)), pa.array(list(own.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])
        counts.clear()

    for batch in batches:
        for lang, word in zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist(), strict=True):
            for n in range(1, LONGEST + 1):
                counts.setdefault(lang, Counter()).update(ngrams(word, n))
        if sum(map(len, counts.values())) > 500_000:
            yield from out()
    yield from out()


def _grams_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            words, grams, counts = [], [], []
            for word in batch.column("word").slice(at, 1024).to_pylist():
                own = Counter(chain.from_iterable(ngrams(word, n) for n in range(1, LONGEST + 1)))
                words += [word] * len(own)
                grams += own
                counts += own.values()
            columns = [pa.array(words, pa.string()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "gram", "n"])


def _by_language(rows: DataFrame, key: str, languages: list[str]) -> DataFrame:
    """``key`` and ``counts``, a number per language, from (key, lang, n)."""
    each = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)) for x in languages]
    return rows.groupBy(key).agg(F.array(*each).alias("counts"))


def _logs(totals: list[list[float]], at: Column) -> Column:
    """Logarithms of smoothed relative frequencies of ``counts``; ``at`` (from 1) says which totals hold."""
    each = []
    for i in range(len(totals[0])):
        total = F.element_at(F.array(*[F.lit(float(t[i])) for t in totals]), at)
        each.append(F.round(F.log((F.col("counts")[i] + SMOOTHING) / total) * UNIT).cast("long"))
    return F.array(*each)


def _totals(table: DataFrame, size: int) -> tuple[list[int], list[float]]:
    """Each language's sum of ``counts``, and the same smoothed over all different keys."""
    row = table.agg(F.count("*").alias("keys"), *[F.sum(F.col("counts")[i]).alias(f"s{i}") for i in range(size)]).first()
    sums = [row[f"s{i}"] or 0 for i in range(size)]
    return sums, [s + SMOOTHING * row["keys"] for s in sums]


def _most_frequent(words: DataFrame, capacity: int) -> DataFrame:
    """The rows of the largest sums of ``counts``, at most ``capacity``: those over a limit that a histogram of steps gives."""
    step = F.floor(F.log2(F.expr("aggregate(counts, 0L, (a, x) -> a + x)")) * 16)
    taken, least = 0, None
    for row in words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # at most 16 * 64 rows
        taken += row["count"]
        if taken > capacity:
            break
        least = row.step
    return words.filter(F.lit(False) if least is None else step >= least)


def fit_languages(docs: DataFrame, teaches: Column, capacity: int = CAPACITY) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of the rows where ``teaches`` holds and ``lang`` is not null.

    The number of languages is taken to be small (their names are collected). Languages without a word
    are not learned. ``capacity`` bounds what is sent to the tasks, not what is learned.
    """
    rows = docs.filter(teaches & F.col("lang").isNotNull())
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    names = sorted(r.lang for r in rows.select("lang").distinct().collect())
    nothing = LanguageModel([], {}, np.zeros((0, 0), np.int64), None, [], None)
    if not names:
        return nothing
    counted = in_batches(rows.filter("text is not null"), _count_words, "lang string, word string, n long")
    words = _kept(_by_language(counted, "word", names))
    sums, _ = _totals(words, len(names))
    order = sorted((i for i in range(len(names)) if sums[i]), key=lambda i: (-sums[i], names[i]))
    if not order:
        return nothing
    languages = [names[i] for i in order]
    words = words.select("word", F.array(*[F.col("counts")[i] for i in order]).alias("counts"))
    sums, smoothed = _totals(words, len(order))
    frequent = _most_frequent(words, capacity).select("word", _logs([smoothed], F.lit(1)).alias("logs")).toArrow()
    known = {w: i for i, w in enumerate(frequent.column("word").to_pylist())}
    logs = frequent.column("logs").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(known), len(languages))

    held = words.select("word", F.posexplode("counts").alias("lang", "n")).filter("n > 0")
    held = held.select(F.col("lang").cast("string").alias("lang"), "word")
    counted = in_batches(held, _count_grams, "lang string, gram string, n long")
    grams = _kept(_by_language(counted, "gram", [str(i) for i in range(len(languages))]))
    totals = [_totals(grams.filter(F.length("gram") == n), len(languages))[1] for n in range(1, LONGEST + 1)]
    gram_table = grams.select("gram", _logs(totals, F.length("gram")).alias("logs"))
    return LanguageModel(languages, known, logs, words, smoothed, gram_table, grams.count())


def _backed_off(words: DataFrame, model: LanguageModel) -> DataFrame:
    """``word`` and ``logs`` of words never seen: the mean of their known n-grams of the longest length."""
    size = len(model.languages)
    # a word is 8 bytes; a row has the n-gram, the array and what a hashed relation adds
    small = model.grams * (size + 8) * 8 <= SENT_BYTES
    known = F.broadcast(model.gram_table) if small else model.gram_table
    grams = in_batches(words, _grams_of_words, "word string, gram string, n long").join(known, "gram")
    each = [F.sum(F.col("n") * F.col("logs")[i]) for i in range(size)]
    by_length = grams.groupBy("word", F.length("gram").alias("length")).agg(F.sum("n").alias("n"), F.array(*each).alias("sums"))
    longest = by_length.groupBy("word").agg(F.max_by(F.struct("n", "sums"), "length").alias("m"))
    return longest.select("word", F.expr("transform(m.sums, s -> s div m.n)").alias("logs"))


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (the likelihood's share among the languages) of every row.

    A text that is null or has no letter is ``und`` with score 0, and so is every text for a model without languages.
    Equal texts are judged alike, whatever their ids; a text without a known word or character has equal shares.
    """
    rows, size = texts_of(docs), len(model.languages)
    if not size:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.word_logs))  # at most capacity words

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, asked, asks = Reader(*shared.value), set(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if len(reader.names) > CACHED_WORDS:
                    reader.clear()
                if len(asked) > CACHED_TEXTS:
                    asked.clear()
                found = [reader.read(t) for t in part.column("text").to_pylist()]
                letters, sums, words, counts = map(list, zip(*found, strict=True))
                # copies of a text have the same other words: one of them asks for all
                numbers: list[int | None] = [None] * len(words)
                keys = zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True)
                task = part.column("task")[0].as_py() << 33
                for i, key in enumerate(keys):
                    if words[i] and key not in asked:
                        asked.add(key)
                        numbers[i] = task + asks
                        asks += 1
                    else:
                        words[i], counts[i] = [], counts[i][:0]
                ends = pa.array(np.cumsum([0, *map(len, words)]), pa.int32())
                other = pa.StructArray.from_arrays(
                    [pa.array(list(chain.from_iterable(words)), pa.string()), pa.array(np.concatenate(counts), pa.int64())],
                    names=["word", "n"],
                )
                parts = pa.array(np.arange(part.num_rows + 1) * size, pa.int32())
                columns = [
                    part.column("doc_id"), part.column("a"), part.column("b"), pa.array(letters),
                    pa.ListArray.from_arrays(parts, pa.array(np.concatenate(sums), pa.int64())),
                    pa.array(numbers, pa.int64()), pa.ListArray.from_arrays(ends, other),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a", "b", "letters", "sums", "ask", "other"])

    marked = rows.withColumns({"a": F.xxhash64("text"), "b": F.xxhash64(F.lit(1), "text"), "task": F.spark_partition_id().cast("long")})
    schema = "doc_id long, a long, b long, letters boolean, sums array<long>, ask long, other array<struct<word:string,n:long>>"
    found = _kept(in_batches(marked, read, schema))
    asks = found.filter("ask is not null").select("ask", "a", "b", "other")
    asked = asks.select("ask", F.inline("other")).filter("word is not null")
    # what travels are the small counts of rare words; their logarithms are taken where a text's words meet
    seen = asked.join(model.word_table, "word").select("ask", "n", "counts").repartition("ask")
    logs = _logs([model.totals], F.lit(1))
    each = [F.sum(F.col("n") * F.col("logs")[i]) for i in range(size)]
    answers = seen.select("ask", "n", logs.alias("logs")).groupBy("ask").agg(F.array(*each).alias("rest"))
    missed = asked.join(model.word_table.select("word"), "word", "left_anti")
    judged = _backed_off(missed.select("word").distinct(), model)
    guesses = missed.join(judged, "word").groupBy("ask").agg(F.array(*each).alias("guess"))
    none = F.array(*[F.lit(0).cast("long")] * size)
    both = asks.select("ask", "a", "b").join(answers, "ask", "left").join(guesses, "ask", "left")
    both = both.withColumns({"rest": F.coalesce("rest", none), "guess": F.coalesce("guess", none)})
    both = both.select("a", "b", F.expr("zip_with(rest, guess, (x, y) -> x + y)").alias("rest"))
    rest = both.groupBy("a", "b").agg(F.min("rest").alias("rest"))  # tasks that met the same text have the same answer
    total = found.select("doc_id", "a", "b", "letters", "sums").join(rest, ["a", "b"], "left")
    total = total.withColumn("total", F.expr("if(rest is null, sums, zip_with(sums, rest, (x, y) -> x + y))"))
    total = total.withColumn("best", F.array_max("total"))
    names = F.array(*[F.lit(x) for x in model.languages])
    share = F.expr(f"1 / aggregate(total, 0d, (a, x) -> a + exp((x - best) / {UNIT:.1f}D))")
    return total.select(
        "doc_id",
        F.when(F.col("letters"), F.element_at(names, F.array_position("total", F.col("best")).cast("int"))).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("letters"), share).otherwise(0.0).alias("score"),
    )
