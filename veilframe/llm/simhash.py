"""Near copies by 64-bit SimHash, searched with the generalised pigeonhole principle.

Fingerprints that differ in at most t bits are split into m groups of bits. If the thresholds of
the groups add up to t - m + 1, two such fingerprints are within the threshold of at least one
group; a threshold of -1 leaves a group out. Bits that go together are put into the same group,
so that the other groups tell fingerprints apart, and the thresholds are chosen by dynamic
programming over the estimated number of candidates. The search is exact for any choice.

All steps work on the different fingerprints. A group value becomes a key: a threshold of 0 needs
one key, a threshold of r one for each choice of r bits left out. Fingerprints of one key are
compared in their task; only edges that join two parts are given on, so a group of thousands of
near copies yields as many edges, not its square. Keys of more than ``BLOCK`` fingerprints are cut
into blocks, and each pair of blocks is a key of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, durable, in_batches, texts_of

BITS = 64
DISTANCE = 4
SHINGLE = 4
BLOCK = 4096
SAMPLE = 20_000  # fingerprints that the choice of groups and thresholds looks at


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    words = text.lower().split()  # bytes: A-Z only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], 42) for a, b in spans], ">u8")
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's 64 bits as a signed long); null texts count as empty."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return in_batches(texts_of(docs), rows, "doc_id long, fp long")


def bit_groups(sample: np.ndarray, groups: int) -> list[list[int]]:
    """Split the bits into groups of nearly equal size that hold bits going together.

    Greedy: a group starts with the bit most tied to the free ones and takes the bits tied most to it.
    """
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
    spread = bits.std(0)
    centred = (bits - bits.mean(0)) / np.where(spread > 0, spread, 1)
    tied = np.abs(centred.T @ centred) / max(len(sample), 1)
    free, out = set(range(BITS)), []
    for g in range(groups):
        size = (BITS * (g + 1)) // groups - (BITS * g) // groups
        rest = sorted(free)
        own = [max(rest, key=lambda b: (tied[b, rest].sum(), -b))]
        while len(own) < size:
            rest = sorted(free - set(own))
            own.append(max(rest, key=lambda b: (tied[b, own].sum(), -b)))
        free -= set(own)
        out.append(sorted(own))
    return out


def group_values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for place, bit in enumerate(bits):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)) << np.uint64(place)
    return out


def thresholds(sample: np.ndarray, groups: list[list[int]], total: int, distance: int) -> tuple[list[int], float]:
    """Thresholds of least estimated cost that add up to ``distance - len(groups) + 1``.

    Cost of a group at threshold r: the keys written plus the pairs compared, where the share of
    pairs within r in this group is counted on the sample and carried over to ``total`` fingerprints.
    """
    goal = distance - len(groups) + 1
    highest = max(goal + len(groups) - 1, 0)
    pick = sample[np.linspace(0, len(sample) - 1, min(len(sample), 1500)).astype(int)]
    pairs = max(len(pick) * (len(pick) - 1) / 2, 1)
    scale = total * max(total - 1, 0) / 2 / pairs
    costs = []
    for bits in groups:
        values = group_values(pick, bits)
        apart = np.bincount(np.bitwise_count(values[:, None] ^ values[None, :])[np.triu_indices(len(pick), 1)], minlength=highest + 1)
        within = np.cumsum(apart)
        # twenty comparisons cost about as much as writing one key
        costs.append([0.0] + [total * comb(len(bits), r) + within[r] * scale / 20 for r in range(highest + 1)])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for g, cost in enumerate(costs):
        grown: dict[int, tuple[float, list[int]]] = {}
        for so_far, (price, chosen) in best.items():
            for r in range(-1, highest + 1):
                new = so_far + r
                if new + (len(costs) - g - 1) * highest < goal or new - (len(costs) - g - 1) > goal:
                    continue
                candidate = (price + cost[r + 1], [*chosen, r])
                if new not in grown or candidate < grown[new]:
                    grown[new] = candidate
        best = grown
    price, chosen = best[goal]
    return chosen, price


def plan_search(sample: np.ndarray, total: int, distance: int) -> list[tuple[list[int], int]]:
    """Groups of bits with their thresholds; the number of groups is the one of least estimated cost."""
    plans = []
    for m in range(1, distance + 2):
        groups = bit_groups(sample, m)
        chosen, price = thresholds(sample, groups, total, distance)
        if max(chosen) <= 2:  # more bits left out would mean thousands of keys each
            plans.append((price, m, list(zip(groups, chosen, strict=True))))
    return [(bits, r) for bits, r in min(plans)[2] if r >= 0]


def _keys(plan: list[tuple[list[int], int]]) -> list[Column]:
    """The keys of a fingerprint: number of the mask, and the bits under the mask."""
    out = []
    for bits, r in plan:
        for gone in combinations(bits, r):
            mask = sum(1 << b for b in bits if b not in gone)
            signed = mask - (1 << 64) if mask >> 63 else mask
            out.append(F.struct(F.lit(len(out)).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed)).alias("value")))
    return out


class _Parts:
    """Union by smallest index with path halving."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.top(i), self.top(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def _join_close(fps: np.ndarray, parts: _Parts, base: int, distance: int) -> list[tuple[int, int]]:
    """Edges that join parts among the fingerprints of one key, numbered from ``base``."""
    edges, step = [], max(1, 4_000_000 // max(len(fps), 1))
    for i in range(0, len(fps), step):
        near = np.bitwise_count(fps[i : i + step, None] ^ fps[None, :]) <= distance
        a, b = np.nonzero(near)
        upper = a + i < b
        for x, y in zip((a[upper] + i).tolist(), b[upper].tolist(), strict=True):
            if parts.join(base + x, base + y):
                edges.append((x, y))
    return edges


def _edges(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key, so a key's fingerprints follow each other, perhaps over two batches."""
        rest: tuple[np.ndarray, ...] | None = None

        def pairs(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            *key, fps = columns
            new = np.ones(len(fps), bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
            bounds = np.append(np.flatnonzero(new), len(fps))
            sizes = np.diff(bounds)
            out: list[tuple[int, int]] = []
            twos = bounds[:-1][sizes == 2]  # most keys: two fingerprints, all compared at once
            close = twos[np.bitwise_count(fps[twos] ^ fps[twos + 1]) <= distance]
            out += [(int(fps[i]), int(fps[i + 1])) for i in close]
            for at, size in zip(bounds[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                own = np.unique(fps[at : at + size])
                out += [(int(own[x]), int(own[y])) for x, y in _join_close(own, _Parts(len(own)), 0, distance)]
            a = np.array(out, np.uint64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(a[:, i].copy().view(np.int64)) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            now = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "value", "s", "t"))
            now = (*now, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            if rest is not None:
                now = tuple(np.concatenate(x) for x in zip(rest, now, strict=True))
            if not len(now[0]):
                continue
            last = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in now[:-1]]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield pairs(tuple(x[:cut] for x in now))
            rest = tuple(x[cut:].copy() for x in now)
        if rest is not None and len(rest[0]):
            yield pairs(rest)

    return run


def close_edges(fps: DataFrame, plan: list[tuple[list[int], int]], distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b) of fingerprints within ``distance`` whose connected parts are those of all such pairs.

    ``fps`` has one row for each different ``fp``.
    """
    keyed = fps.select("fp", F.explode(F.array(*_keys(plan))).alias("key")).select("fp", "key.mask", "key.value")
    sizes = keyed.groupBy("mask", "value").count()
    shared = sizes.filter("count > 1").select("mask", "value", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    rows = keyed.join(shared, ["mask", "value"])
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("mask", "value", F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t"), "fp")
    # dealt by key and block pair: a key of many fingerprints is spread over many tasks
    rows = rows.repartition("mask", "value", "s", "t").sortWithinPartitions("mask", "value", "s", "t")
    return in_batches(rows, _edges(distance), "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root``, the smallest node that edges (a, b) connect it with.

    Large-star and small-star steps in turn: each hangs a node's neighbours on the smallest of them,
    which halves the depth of every tree, so that the rounds grow with the logarithm of the longest
    path. Each round is written to the checkpoint folder.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(least, "u")
        hung = joined.filter(F.col("v") > F.col("u")) if large else joined
        out = hung.select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    now = durable(edges.filter("a <> b").distinct())
    check = None
    for _ in range(rounds):
        now = durable(star(star(now, True), False))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == check:
            break
        check = seen
    else:
        raise RuntimeError("components did not settle; raise rounds")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def linked_fingerprints(fps: DataFrame, distance: int = DISTANCE) -> DataFrame | None:
    """``close_edges`` of the different ``fp`` of a table, searched as a sample of them suggests; None if there are none."""
    total = fps.count()
    if not total:
        return None
    rows = fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()
    plan = plan_search(rows["fp"].to_numpy(np.int64).view(np.uint64), total, distance)
    return close_edges(fps, plan, distance)


def near_copies(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest id reachable over close fingerprints.

    Each input row gives one row, repeated ones too. Null ids are not linked to anything but keep a row,
    with a null component unless another document shares their part. An empty table gives an empty result.
    """
    marked = durable(fingerprints(docs, shingle))
    fps = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    edges = linked_fingerprints(fps.select("fp"), distance)
    if edges is None:
        return marked.select("doc_id", "fp", F.lit(None).cast("long").alias("component_id"))
    roots = components(edges)
    parts = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    firsts = parts.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = parts.join(firsts, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
