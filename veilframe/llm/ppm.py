"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of all byte contexts of the training documents, up to ``ORDER`` bytes long. A
symbol is looked for under the longest known context; where that has not seen it, an escape is
paid and the next shorter context is asked, without the symbols that the longer one has already
ruled out. The probability of an escape is estimated from the number of different symbols of a
context (method C). A document's score is the sum of the logarithms over its bytes and one end
symbol; bytes 0xFF, which UTF-8 never uses, stand before the start and at the end.

The logarithm at a place follows from its context and symbol alone, ``ORDER + 1`` bytes. The strings of
that length are a table, as are the logarithms of those that training has. The most frequent ones (``SENT``
of them) travel to the tasks; the others are joined by string, and the escapes of strings that training
does not have are worked out by joins with the contexts, longest first. Which strings travel changes no result.

Beside it stands a plain word model over the same training documents. Its counts are of all words:
the most frequent ones (``COMMON`` of them) travel to the tasks, the others are joined.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, durable, fold_of, in_batches, texts_of

ORDER = 5
SENT = 1 << 20
COMMON = 1 << 18
_OUTSIDE = b"\xff"
_END = b"\xff"  # as a word
_BLOCK = 2_000_000
_PLACE = [("key", "<i8"), ("n", "<i4")]  # a document and how often
_SCORED = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "fold", "key", "n_tokens", "hits")] + [(c, pa.float64()) for c in ("base", "score")]
    + [("gram", pa.int64()), ("places", pa.binary())]
)
_SQL = {pa.int64(): "long", pa.float64(): "double", pa.binary(): "binary"}


def normalised(text: bytes) -> list[bytes]:
    """Words of a text with A-Z lower-cased."""
    return text.lower().split()


# ---------------------------------------------------------------- counting


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The last ``ORDER + 1`` bytes at each symbol of each text as one number, and each text's number of symbols."""
    edge = _OUTSIDE * ORDER
    joined = np.frombuffer(b"".join(edge + t + _END for t in texts), np.uint8).astype(np.uint64)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    out = np.zeros(max(len(joined) - ORDER, 0), np.uint64)
    for back in range(ORDER + 1):
        out |= joined[ORDER - back : len(joined) - back] << np.uint64(8 * back)
    # places whose symbol is an edge byte of the next text do not count
    begins = np.cumsum(sizes + ORDER) - (sizes + ORDER)
    place = np.arange(int(sizes.sum())) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    return out[place], sizes


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in held])
        counts = np.concatenate([c for _, c in held])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[first], np.add.reduceat(counts[order], first)

    def row(pair: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pair[0].view(np.int64)), pa.array(pair[1])], names=["gram", "n"])

    for texts in _blocks(batches):
        held.append(np.unique(_grams(texts)[0], return_counts=True))
        if sum(len(k) for k, _ in held) > _BLOCK:
            held = [merged()]
            if len(held[0][0]) > _BLOCK // 2:
                yield row(held.pop())
    if held:
        yield row(merged())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """Normalised texts in lists of some megabytes."""
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for text in as_bytes(batch.column("text")):
            texts.append(b" ".join(normalised(text)))
            size += len(text)
            if size > _BLOCK:
                yield texts
                texts, size = [], 0
    if texts:
        yield texts


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"]
        )
        counts.clear()
        return made

    for batch in batches:
        for text in as_bytes(batch.column("text")):
            counts.update(normalised(text))
            counts[_END] += 1
            if len(counts) > 500_000:
                yield out()
    if counts:
        yield out()


# ---------------------------------------------------------------- the trie


class Lookup:
    """Numbers to places by open addressing, for whole arrays at a time."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(2 * max(len(keys), 1)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.place = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            slots, first = np.unique(slot, return_index=True)
            free = self.place[slots] < 0
            chosen = first[free]
            self.place[slots[free]] = left[chosen]
            self.keys[slots[free]] = keys[left[chosen]]
            rest = np.ones(len(left), bool)
            rest[chosen] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where there is none."""
        slot = self._slot(keys)
        out = self.place[slot]
        wrong = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot = slot[wrong]
        while len(wrong):
            slot = (slot + 1) & self.mask
            at = self.place[slot]
            out[wrong] = at
            again = (at >= 0) & (self.keys[slot] != keys[wrong])
            wrong, slot = wrong[again], slot[again]
        return out


@dataclass
class Sent:
    """The frequent words and strings with their logarithms; as arrays for the driver, as tables in each worker."""

    words: pa.Table  # word, log
    grams: pa.Table  # gram, log

    @cached_property
    def by_word(self) -> dict[bytes, float]:
        return dict(zip(self.words["word"].to_pylist(), self.words["log"].to_pylist(), strict=True))

    @cached_property
    def strings(self) -> Lookup:
        return Lookup(self.grams["gram"].to_numpy().view(np.uint64))

    @cached_property
    def string_logs(self) -> np.ndarray:
        return np.append(self.grams["log"].to_numpy(), 0.0)


def _context(length: int) -> Column:
    """The ``length`` bytes before the last one of ``gram``."""
    return F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * length) - 1))


@dataclass
class Trie:
    """Counts of the strings of ``ORDER + 1`` bytes; those of shorter strings are sums of them."""

    grams: DataFrame  # gram, n
    least: int = 1  # strings seen less often are no nodes, but count in the totals of their contexts

    def logs(self) -> DataFrame:
        """``gram, n, log`` of the nodes of the longest contexts: symbols that pay no escape."""
        own = Window.partitionBy("context")
        rows = self.grams.withColumn("context", _context(ORDER))
        rows = rows.withColumn("whole", F.sum("n").over(own) + F.count(F.when(F.col("n") >= self.least, 1)).over(own))
        return rows.filter(F.col("n") >= self.least).select("gram", "n", (F.log10("n") - F.log10("whole")).alias("log"))

    def contexts(self, length: int, asked: DataFrame) -> DataFrame:
        """``context, whole, counts`` (total, and symbols with their counts) of the contexts of one length that ``asked`` needs."""
        nodes = self.grams.select(_context(length).alias("context"), F.col("gram").bitwiseAND(F.lit(255)).alias("symbol"), "n")
        nodes = nodes.groupBy("context", "symbol").agg(F.sum("n").alias("n"))  # first, as many strings share a short context
        if length > 1:
            nodes = nodes.join(asked.select(_context(length).alias("context")).distinct(), "context", "left_semi")
        kept = F.collect_list(F.when(F.col("n") >= self.least, F.struct("symbol", "n")))
        found = nodes.groupBy("context").agg(F.sum("n").alias("whole"), F.map_from_entries(kept).alias("counts"))
        return found.filter(F.size("counts") > 0)

    def escaped(self, asked: DataFrame) -> DataFrame:
        """``gram, log`` of strings (distinct) that are no nodes: their escapes, and the symbol under the context that knows it."""
        none = F.expr("cast(array() as array<bigint>)")
        rows = asked.select("gram", F.lit(0.0).alias("log"), none.alias("above"), F.lit(False).alias("found"))
        for length in range(ORDER, -1, -1):
            # strings that are done have a key no context has, each its own
            rows = rows.withColumn("context", F.when(F.col("found"), -1 - F.col("gram")).otherwise(_context(length)))
            own = self.contexts(length, asked)
            rows = rows.join(F.broadcast(own) if length < 2 else own, "context", "left").select(  # up to 256 contexts of 256 symbols
                "gram", "log", "above", "found", "counts",
                F.expr("try_element_at(counts, gram & 255)").alias("n"),
                F.expr("whole + size(counts) - size(above) - aggregate(above, 0L, (a, x) -> a + counts[x])").alias("all"),
                F.expr("whole + size(counts) - size(above) - aggregate(map_values(counts), 0L, (a, x) -> a + x)").alias("rest"),
            )
            step = F.expr(
                "case when counts is null then 0 when n is not null then log10(n) - log10(greatest(all, 1e-9))"
                " when all > 0 then log10(greatest(rest, 1e-9) / all) else 0 end"
            )
            if not length:  # a symbol that no context knows
                other = F.log10(F.greatest(256 - F.coalesce(F.size("counts"), F.lit(0)), F.lit(1)))
                step = step - F.when(F.col("found") | F.col("n").isNotNull(), 0.0).otherwise(other)
            rows = rows.select(
                "gram",
                (F.col("log") + step).alias("log"),
                F.when(F.col("n").isNotNull(), none).when(F.col("counts").isNotNull(), F.map_keys("counts")).otherwise(F.col("above")).alias("above"),
                (F.col("found") | F.col("n").isNotNull()).alias("found"),
            )
        return rows.select("gram", "log")


def fit_trie(docs: DataFrame, capacity: int | None = None) -> Trie:
    """Count all contexts of ``docs``. With a capacity, only strings of at least ``1 / capacity`` of the positions are nodes."""
    grams = durable(in_batches(docs.select("text"), _count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    if capacity is None:
        return Trie(grams)
    positions = grams.agg(F.sum("n")).first()[0] or 0
    return Trie(grams, max(1, -(-positions // capacity)))


def _frequent(counts: DataFrame, n: str, limit: int) -> int:
    """The count from which on rows are among the ``limit`` most frequent ones; counts less than a tenth apart may go together."""
    steps = counts.groupBy(F.floor(8 * F.log2(n)).alias("step")).agg(F.count("*").alias("rows"), F.min(n).alias("least"))
    least, rows = 1 << 62, 0
    for step in sorted(steps.collect(), key=lambda r: -r.step):  # some hundreds at most
        rows += step.rows
        if rows > limit:
            break
        least = step.least
    return least


# ---------------------------------------------------------------- scoring


def score_documents(docs: DataFrame, parts: int = 5, fold: int = 1) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Rows of crc32 fold ``fold`` of ``parts`` teach nothing. A null text counts as empty: one end token. Rows
    with a null id are scored but neither teach nor count as held out. Without training rows every count is 0.
    """
    rows = texts_of(docs).withColumn("fold", fold_of(parts))
    training = rows.filter(F.col("fold") != fold)
    words = in_batches(training.select("text"), _count_words, "word binary, c long")
    words = durable(words.groupBy("word").agg(F.sum("c").alias("c")))
    tokens, kinds = words.agg(F.sum("c"), F.count("*")).first()
    tokens = tokens or 0
    least = _frequent(words, "c", COMMON)
    below = 0.5 * (kinds + 1) + tokens
    unseen = math.log10(0.5 / below)
    word_log = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / below)
    common = words.filter((F.col("c") >= least) | (F.col("word") == F.lit(_END)))  # at most COMMON words, and the end
    common = common.select("word", word_log.alias("log")).toArrow()
    trie = fit_trie(training)
    logs = durable(trie.logs())
    often = _frequent(logs, "n", SENT)
    sent = logs.filter(F.col("n") >= often).select("gram", "log").toArrow()  # at most SENT strings
    shared = docs.sparkSession.sparkContext.broadcast(Sent(common, sent))

    def key_of(doc: int | None, text: bytes) -> int:
        return xxhash.xxh64_intdigest(text, (doc or 0) & ((1 << 64) - 1)) - (1 << 63)

    def packed_places(which: np.ndarray, places: np.ndarray, kinds: int) -> pa.Array:
        """The places of each of ``kinds`` things as one binary value."""
        bounds = 12 * np.searchsorted(which, np.arange(kinds + 1))
        return pa.Array.from_buffers(pa.binary(), kinds, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(places.tobytes())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document with what the sent tables say, and each other string of a task with the documents it stands in."""
        by_word, strings, string_logs = shared.value.by_word, shared.value.strings, shared.value.string_logs
        end = by_word.get(_END)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def others() -> pa.RecordBatch:
            missed, where = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((where, missed))
            missed, where = missed[order], where[order]
            first = np.flatnonzero(np.append(True, (missed[1:] != missed[:-1]) | (where[1:] != where[:-1])))
            packed = np.zeros(len(first), _PLACE)
            packed["key"], packed["n"] = where[first], np.diff(np.append(first, len(missed)))
            grams, which = np.unique(missed[first].view(np.int64), return_inverse=True)
            lists = packed_places(which, packed, len(grams))
            nothing = [pa.nulls(len(grams), f.type) for f in _SCORED if f.name not in ("gram", "places")]
            return pa.RecordBatch.from_arrays([*nothing, pa.array(grams), lists], schema=_SCORED)

        for batch in batches:
            docs_, texts = batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))
            count, hits, base, plain = [], [], [], []
            for text in texts:
                own = normalised(text)
                found = [x for x in map(by_word.get, own) if x is not None]
                count.append(len(own) + 1)
                hits.append(len(found) + (end is not None))
                base.append(math.fsum(found) + (unseen if end is None else end))
                plain.append(b" ".join(own))
            keys = np.array([key_of(d, t) for d, t in zip(docs_, texts, strict=True)], np.int64)
            scores = [np.zeros(0)]
            at = 0
            while at < len(plain):  # some megabytes at a time
                stop, size = at, 0
                while stop < len(plain) and size < 1_000_000:
                    size += len(plain[stop])
                    stop += 1
                grams, sizes = _grams(plain[at:stop])
                found = strings.find(grams)
                ends = np.cumsum(sizes)
                scores.append(np.add.reduceat(string_logs[found], ends - sizes))
                missed = np.flatnonzero(found < 0)
                if len(missed):
                    held.append((grams[missed], keys[at:stop][np.searchsorted(ends, missed, side="right")]))
                if sum(len(x) for x, _ in held) > 500_000:
                    yield others()
                at = stop
            columns = [batch.column("doc_id"), batch.column("fold"), pa.array(keys), pa.array(count, pa.int64()), pa.array(hits, pa.int64())]
            columns += [pa.array(base, pa.float64()), pa.array(np.concatenate(scores))]
            nothing = [pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *nothing], schema=_SCORED)
        if held:
            yield others()

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each rare word of a task with the documents it stands in (key and number, 12 bytes each)."""
        known = shared.value.by_word
        codes: dict[bytes, int] = {}
        which: list[int] = []
        where: list[int] = []
        often_: list[int] = []

        def out() -> pa.RecordBatch:
            code = np.array(which)
            order = np.argsort(code, kind="stable")
            packed = np.zeros(len(code), _PLACE)
            packed["key"], packed["n"] = np.array(where, np.int64)[order], np.array(often_, np.int32)[order]
            lists = packed_places(code[order], packed, len(codes))
            made = pa.RecordBatch.from_arrays([pa.array(list(codes), pa.binary()), lists], names=["word", "places"])
            for held in (codes, which, where, often_):
                held.clear()
            return made

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                own = Counter(w for w in normalised(text) if w not in known)
                if own:
                    which += [codes.setdefault(w, len(codes)) for w in own]
                    where += [key_of(doc, text)] * len(own)
                    often_ += own.values()
                if len(which) > 500_000:
                    yield out()
        if which:
            yield out()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums by document of what the joined words and strings add."""
        for batch in batches:
            places = batch.column("places")
            flat = np.frombuffer(b"".join(places.to_pylist()), _PLACE)
            sizes = pc.binary_length(places).to_numpy(zero_copy_only=False) // 12
            keys, at = np.unique(flat["key"], return_inverse=True)
            sums = []
            for name in ("hit", "base", "score"):
                each = np.repeat(batch.column(name).to_numpy(zero_copy_only=False), sizes)
                sums.append(np.bincount(at, weights=flat["n"] * each, minlength=len(keys)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                names=["key", "more_hits", "more_base", "more_score"],
            )

    done = durable(in_batches(rows, scored, ", ".join(f"{f.name} {_SQL[f.type]}" for f in _SCORED)))
    main, asked = done.filter("places is null").drop("gram", "places"), done.filter("places is not null").select("gram", "places")
    # strings that were not sent: those that training has, and all others
    known = logs.filter(F.col("n") < often).select("gram", "log")
    unknown = durable(asked.select("gram").distinct().join(known, "gram", "left_anti"))
    strings = asked.join(known.unionByName(trie.escaped(unknown)), "gram").select(
        "places", F.lit(0).alias("hit"), F.lit(0.0).alias("base"), F.col("log").alias("score")
    )
    uncommon = in_batches(rows.select("doc_id", "text"), rare, "word binary, places binary")
    uncommon = uncommon.join(words.filter(F.col("c") < least), "word", "left").select(
        "places",
        F.when(F.col("c") > 0, 1).otherwise(0).alias("hit"),
        word_log.alias("base"),
        F.lit(0.0).alias("score"),
    )
    more = in_batches(uncommon.unionByName(strings), added, "key long, more_hits long, more_base double, more_score double")
    more = more.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("more_hits", "more_base", "more_score")])
    # repeated rows have one key and were added up together
    alike = main.groupBy("key").agg(F.count("*").alias("rows"))
    extra = more.join(alike, "key").select(
        "key",
        (F.col("more_hits") / F.col("rows")).cast("long").alias("more_hits"),
        *[(F.col(c) / F.col("rows")).alias(c) for c in ("more_base", "more_score")],
    )
    return main.join(extra, "key", "left").select(
        "doc_id",
        F.coalesce(F.col("fold") == fold, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("hits") + F.coalesce("more_hits", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
