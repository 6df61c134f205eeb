"""Near copies by the Jaccard similarity of word shingles, searched with MinHash bands and verified.

Texts are lower-cased (A-Z) and split at white space; a text is the set of its runs of ``SHINGLE``
words, a shorter one a set of one. Texts of equal words are one node. ``BANDS`` keys of ``ROWS`` minima
each bring a pair of similarity s together with probability 1 - (1 - s**ROWS)**BANDS: at the least
similarity, 0.8, all but 3 of 100,000 pairs. Pairs under one key are linked only if their exact
similarity is ``SIMILAR`` at least, so no link is an estimate.

Keys that hold the same texts as another are left out: they would ask for the same comparisons.
Texts are moved only to the keys they share with others. Pairs that are connected already are not
compared, so a group of near copies costs about as many comparisons as it has members. Keys of more
than ``BLOCK`` texts are cut into blocks, and each pair of blocks is a key of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, durable, in_batches, texts_of
from .simhash import _Parts, components, fingerprint, linked_fingerprints

SHINGLE = 5
SIMILAR = 0.8
ROWS = 4
BANDS = 20
BLOCK = 512
_SEEDS = np.random.default_rng(23).integers(0, 2**64, ROWS * BANDS, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """64-bit digests of the runs of ``size`` words, in order and with repeats; one digest of fewer words."""
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    out = own[: len(own) - size + 1].copy()
    for k in range(1, size):
        out = (out ^ (out >> np.uint64(29))) * _ODD + own[k : len(own) - size + 1 + k]
    out = (out ^ (out >> np.uint64(32))) * _ODD
    return out ^ (out >> np.uint64(29))


def node_of(words: list[bytes]) -> int:
    """The text's words as a signed 64-bit number."""
    return xxhash.xxh64_intdigest(b" ".join(words), 7) - (1 << 63)


def band_keys(digests: np.ndarray) -> np.ndarray:
    least = np.full(len(_SEEDS), np.uint64(2**64 - 1))
    for at in range(0, len(digests), 2048):
        least = np.minimum(least, ((digests[at : at + 2048, None] ^ _SEEDS) * _ODD).min(0))
    keys = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ (keys >> np.uint64(31))) * _ODD + row
    return keys.view(np.int64)


def _marked(batches: Iterator[pa.RecordBatch], printed: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, keys, prints = [], [], []
        for text in as_bytes(batch.column("text")):
            words = text.lower().split()
            nodes.append(node_of(words))
            keys.append(band_keys(shingles(words)) if words else np.zeros(0, np.int64))
            if printed:
                prints.append(fingerprint(text))
        offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
        columns = {"doc_id": batch.column("doc_id"), "node": pa.array(nodes, pa.int64()), "bands": lists}
        if printed:
            columns["fp"] = pa.array(np.array(prints, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return float(not len(b))
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def _links(nodes: list[int], texts: list[bytes]) -> list[tuple[int, int]]:
    """Links that connect what all similar pairs of these texts connect."""
    sets: dict[int, np.ndarray] = {}
    for node, text in zip(nodes, texts, strict=True):
        words = text.lower().split()
        if node not in sets and node_of(words) == node:  # another text of a repeated id has another node
            sets[node] = np.unique(shingles(words))
    own = sorted(sets, key=lambda n: (len(sets[n]), n))
    parts, out, begin = _Parts(len(own)), [], 0
    for j, b in enumerate(own):
        while len(sets[own[begin]]) < SIMILAR * len(sets[b]):
            begin += 1
        for i in range(begin, j):
            if parts.top(i) != parts.top(j) and similarity(sets[own[i]], sets[b]) >= SIMILAR:
                parts.join(i, j)
                out.append((own[i], b))
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a key's texts may lie in several batches."""
    key, nodes, texts = None, [], []

    def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        a = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(a[:, i].copy()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        found: list[tuple[int, int]] = []
        columns = [batch.column(c).to_pylist() for c in ("band", "value", "s", "t", "node")]
        for *now, node, text in zip(*columns, as_bytes(batch.column("text")), strict=True):
            if now != key:
                found += _links(nodes, texts)
                key, nodes, texts = now, [], []
            nodes.append(node)
            texts.append(text)
        yield out(found)
    yield out(_links(nodes, texts))


def _close_nodes(nodes: DataFrame, distance: int) -> DataFrame | None:
    """Links (a, b) of nodes whose SimHash fingerprints ``fp`` differ in ``distance`` bits at most, those of equal ones included."""
    firsts = durable(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    edges = linked_fingerprints(firsts.select("fp"), distance)
    if edges is None:
        return None
    a, b = (firsts.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab")
    far = edges.join(a, "a").join(b, "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    equal = nodes.join(firsts, "fp").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return far.union(equal)


def similar_copies(docs: DataFrame, distance: int | None = None) -> DataFrame:
    """``doc_id`` and ``component_id``, the smallest id reachable over similar texts, of every row with an id.

    Null texts count as empty, and texts without words as equal. With ``distance``, texts whose SimHash
    fingerprints (``simhash``) differ in so many bits at most are linked as well.
    """
    rows = texts_of(docs).filter("doc_id is not null")
    printed = distance is not None
    schema = "doc_id long, node long, bands array<long>" + (", fp long" if printed else "")
    marked = durable(in_batches(rows, partial(_marked, printed=printed), schema))
    own = [F.first(c).alias(c) for c in ("bands", "fp")[: 1 + printed]]
    nodes = durable(marked.groupBy("node").agg(F.min("doc_id").alias("first_id"), *own))
    keyed = nodes.select("node", "first_id", F.posexplode("bands").alias("band", "value"))
    sizes = keyed.groupBy("band", "value").agg(
        F.count("*").alias("n"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(1, node))").alias("y")
    )
    shared = sizes.filter("n > 1").groupBy("n", "x", "y").agg(F.min(F.struct("band", "value")).alias("key"))
    shared = shared.select("key.band", "key.value", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    kept = keyed.join(shared, ["band", "value"])
    kept = kept.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    kept = kept.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    kept = durable(kept.select("band", "value", F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t"), "node", "first_id"))
    texts = rows.join(kept.select(F.col("first_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    pairs = kept.join(texts.withColumnRenamed("doc_id", "first_id"), "first_id").drop("first_id")
    pairs = pairs.repartition("band", "value", "s", "t").sortWithinPartitions("band", "value", "s", "t")
    edges = in_batches(pairs, _verified, "a long, b long").distinct()
    if distance is not None and (close := _close_nodes(nodes, distance)) is not None:
        edges = edges.union(close)
    roots = components(edges).select(F.col("node").alias("member"), "root")
    parts = nodes.join(roots, nodes.node == roots.member, "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    firsts = parts.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marked.join(parts.join(firsts, "root").select("node", "component_id"), "node").select("doc_id", "component_id")
