"""Resampling documents towards a target distribution, with every distinct line looked at once.

A document's weight is the sum of its features' gains, a feature being a run of consecutive words and its gain the
logarithm of how much commoner its bucket is in the target than here. Documents are drawn by weight plus Gumbel noise
of their id, the highest first (sampling without replacement by weight).

A newline never stands inside a word, so texts are cut there. The features of each distinct line are counted once; the
corpus holds them as often as the line occurs, and a document's weight is the sum over its lines. Runs over the
end of a line belong to the document and are added apart: each is counted at the line in which it starts.

Lines meet their weights by a join on 128-bit digests. A line that makes up a ``HOT``-th of all lines is joined by
broadcast (there are at most ``HOT`` of them), the others by a shuffle in which no key can be large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.durable import stored
from ..operators.numbering import number_within
from .common import durable, shared_folder

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
HOT = 4096
_UPPER = "".join(map(chr, range(65, 91)))


def digest(text: Column) -> Column:
    """The first 128 bits of SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def runs(of: Column, length: int, first: Column | int = 1, last: Column | None = None) -> Column:
    """Runs of ``length`` words joined by a space, by the place (from 1) of their first word."""
    if length == 1 and last is None:
        return of
    fits = F.size(of) - (length - 1)
    last = fits if last is None else F.least(last, fits)
    starts = F.when(last >= first, F.sequence(F.lit(first) if isinstance(first, int) else first, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(of, i, length), " "))


def bucket_of(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature) % buckets).cast("int")


def line_features(line: Column, longest: int, buckets: int) -> Column:
    """``n_words`` of one line and ``features``, the buckets of all runs inside it, repeats included."""

    def of(own: Column) -> Column:
        every = F.concat(*[runs(own, n) for n in range(1, longest + 1)])
        return F.struct(F.size(own).alias("n_words"), F.transform(every, lambda x: bucket_of(x, buckets)).alias("features"))

    # as an argument the words are looked up once, however often they are used
    return F.transform(F.array(words(line)), of)[0]


def crossing_features(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``texts`` with ``features``: buckets of the runs that start in one of its ``lines`` and end in a later one."""

    def at(own: Column, j: Column) -> Column:
        # the last words of the line and the first ones behind it; a line has one word at least
        tail = F.slice(own, F.greatest(F.size(own) - (longest - 2), F.lit(1)), longest - 1)
        near = F.flatten(F.slice("split", j + 2, longest - 1))
        return F.struct(F.concat(tail, F.slice(near, 1, longest - 1)).alias("words"), F.size(tail).alias("border"))

    def over(border: Column) -> Column:
        of = lambda n: runs(border["words"], n, F.greatest(border["border"] - (n - 2), F.lit(1)), border["border"])
        return F.transform(F.concat(*[of(n) for n in range(2, longest + 1)]), lambda x: bucket_of(x, buckets))

    # each step is held in a column of its own, so no line's words are looked up more than once
    names = texts.columns
    held = texts.select("*", F.explode_outer(F.array(F.transform("lines", words))).alias("split"))
    held = held.select("*", F.explode_outer(F.array(F.transform("split", at))).alias("borders"))
    return held.select(*names, F.flatten(F.transform("borders", over)).alias("features"))


def _texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``lines``: the lines that hold a word, lower-cased (A-Z only)."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("long").alias("doc_id"), lines.alias("lines"))


def distinct_lines(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``line`` (digest), its ``occurrences``, ``n_words`` and ``features`` (buckets), one row for each line."""
    counted = texts.select(F.explode("lines").alias("text")).groupBy("text").agg(F.count("*").alias("occurrences"))
    held = counted.select("text", "occurrences", F.explode(F.array(line_features(F.col("text"), longest, buckets))).alias("own"))
    return held.select(digest(F.col("text")).alias("line"), "occurrences", "own.n_words", "own.features")


def bucket_counts(lines: DataFrame, crossing: DataFrame | None) -> DataFrame:
    """``bucket`` and ``n``: features of the corpus, lines by their occurrences and crossing runs one by one."""
    every = lines.select(F.explode("features").alias("bucket"), F.col("occurrences").alias("n"))
    if crossing is not None:
        every = every.unionByName(crossing.select(F.explode("features").alias("bucket"), F.lit(1).cast("long").alias("n")))
    return every.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(here: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """``bucket`` and ``gain`` of all buckets, from two tables of bucket counts."""
    spark = here.sparkSession
    total = lambda df, name: df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    every = every.join(here.withColumnRenamed("n", "here"), "bucket", "left").join(target.withColumnRenamed("n", "there"), "bucket", "left").fillna(0)
    every = every.join(F.broadcast(total(here, "all_here").join(total(target, "all_there"))))  # one row
    d = lambda name, more: F.col(name).cast("double") + float(more)
    ratio = (d("there", 1) * d("all_here", buckets)) / (d("here", 1) * d("all_there", buckets))
    return every.select("bucket", F.floor(F.log(ratio) * 1000.0).cast("long").alias("gain"))


def _line_weights(lines: DataFrame, gain: DataFrame) -> DataFrame:
    """``line``, ``weight``, ``n_features``, ``n_words`` and ``occurrences``; ``gain`` has a row for each bucket."""
    summed = lines.select("line", "occurrences", "n_words", F.explode("features").alias("bucket")).join(F.broadcast(gain), "bucket")
    return summed.groupBy("line", "occurrences", "n_words").agg(F.sum("gain").alias("weight"), F.count("*").alias("n_features"))


def importance(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` of every row of ``docs``.

    A null text is empty and has weight 0; repeated ids and rows stay, each for itself; a null id stays null. Only
    ``doc_id`` and ``text`` are read, of ``target`` only ``text``. Features are runs of 1 to ``longest`` words.
    """
    folder = shared_folder(docs.sparkSession, "importance")
    texts = _texts(docs)
    aimed = _texts(target.select("text"))

    def crossing(df: DataFrame) -> DataFrame | None:
        return crossing_features(df, longest, buckets) if longest > 1 else None

    lines = stored(distinct_lines(texts, longest, buckets), folder)
    wanted = bucket_counts(distinct_lines(aimed, longest, buckets), crossing(aimed))
    gain = durable(gains(bucket_counts(lines, crossing(texts)), wanted, buckets))
    weights = stored(_line_weights(lines, gain), folder)
    total = weights.agg(F.coalesce(F.sum("occurrences"), F.lit(0))).first()[0]
    weights = weights.withColumn("hot", F.col("occurrences") * HOT >= total)
    hot = weights.filter("hot").select("line", F.struct("weight", "n_features", "n_words").alias("near"))
    cold = weights.filter("not hot").select("line", F.struct("weight", "n_features", "n_words").alias("far"))

    # a row is its id and text; equal rows are summed together and told apart again by their number
    row = ["doc_id", "text_key"]
    keyed = texts.withColumn("text_key", digest(F.array_join("lines", "\n")))
    placed = keyed.select(*row, F.posexplode_outer(F.transform("lines", digest)).alias("place", "line"))
    placed = placed.join(F.broadcast(hot), "line", "left")
    # what has met its weight, or has no line, is dealt by its row instead
    apart = F.when(F.col("near").isNull() & F.col("line").isNotNull(), F.col("line")).otherwise(F.concat(F.lit("row").cast("binary"), "text_key", F.coalesce(F.col("doc_id"), F.lit(0)).cast("string").cast("binary")))
    met = placed.withColumn("line", apart).join(cold, "line", "left").withColumn("met", F.coalesce("near", "far"))
    amount = lambda name: F.coalesce(F.sum(f"met.{name}"), F.lit(0)).alias(name)
    copies = F.sum((F.coalesce("place", F.lit(0)) == 0).cast("long")).alias("copies")
    summed = met.groupBy(*row).agg(amount("weight"), amount("n_features"), amount("n_words"), copies)
    if longest > 1:
        over = crossing_features(keyed, longest, buckets).select(*row, F.explode("features").alias("bucket")).join(F.broadcast(gain), "bucket")
        over = over.groupBy(*row).agg(F.sum("gain").alias("weight"), F.count("*").alias("n_features"))
        zero = lambda df: df.select(*row, "weight", "n_features", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) if c in df.columns else F.lit(0).cast("long").alias(c) for c in ("n_words", "copies")])
        both = zero(summed).unionByName(zero(over)).groupBy(*row)
        summed = both.agg(*[F.sum(c).alias(c) for c in ("weight", "n_features", "n_words", "copies")])
    each = F.explode(F.sequence(F.lit(1), F.col("copies")))
    shares = [F.expr(f"{c} div copies").alias(c) for c in ("n_words", "n_features", "weight")]
    return summed.select("doc_id", *shares, "copies").withColumn("copy", each).drop("copies", "copy")


def resample(docs: DataFrame, target: DataFrame, *, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """``importance`` with ``score``, and ``rank`` for the documents drawn.

    Drawn are, of the rows with ``least_words`` words, ``percent`` in a hundred (rounded down) with the highest scores;
    ties go to the smaller id, a null id before all others. The noise of a null id is that of an empty one.
    """
    scored = importance(docs, target, longest, buckets)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    noise = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.log(-F.log((noise + 0.5) / 4294967296.0)) * -1000.0).cast("long")
    scored = durable(scored.withColumn("score", F.col("weight") + gumbel).withColumn("below", -F.col("score")))
    fit = scored.filter(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    ranked = number_within(fit, [], ["below", "doc_id"], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
