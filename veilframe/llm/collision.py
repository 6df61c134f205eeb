"""Nearest neighbours by counting collisions of single projections.

Each of ``PROJECTIONS`` random directions gives a sorted array of all vectors. A vector collides with
a query in one of them if its value lies in a window centred at the query's. Windows grow by a
factor until enough vectors collide in at least ``SHARE`` of the arrays; these are verified with
exact products. Growing a window only moves its two ends (virtual rehashing): what is kept of an array is
the place of every vector in it, and a vector collides if its place lies between them, so no array is built twice. For the largest product, vectors get one more coordinate that makes all of them equally
long; then the largest product is the smallest distance.

Vectors are dealt into blocks with arrays of their own, and queries into blocks as well. A block holds
norms of one range (``RANGES`` to a doubling) and lifts its vectors to the longest of that range only:
were they lifted to the longest of all, the further coordinate would drown the others. Every pair of
blocks is one group of bounded size; each query keeps its best of each block, and the best of those
are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 64
SHARE = 0.8
VERIFIED = 0.25  # part of a block that is verified at least, beside the k wanted
GROWTH = 1.15
RANGES = 8  # ranges of norms in which vectors are searched apart, for each doubling
BLOCK = 8192
QUERY_BLOCK = 1024
_SEED = 17


def projections(size: int, count: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(_SEED).standard_normal((size, count))


def exact_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors get equal products wherever they stand."""
    return (vectors * query).sum(1)


def search_block(
    ids: np.ndarray, vectors: np.ndarray, longest: float, query_ids: np.ndarray, queries: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its place, and ids and products of its ``k`` best in the block, best first, smaller id first."""
    n = len(ids)
    lifted = np.sqrt(np.maximum(longest * longest - (vectors * vectors).sum(1), 0))
    directions = projections(vectors.shape[1] + 1)
    values = np.ascontiguousarray((np.concatenate((vectors, lifted[:, None]), 1) @ directions).T)
    order = np.argsort(values, axis=1, kind="stable")
    places = np.empty(order.shape, np.uint16 if n <= 1 << 16 else np.uint32)
    np.put_along_axis(places, order, np.arange(n, dtype=places.dtype)[None, :], 1)
    values = np.take_along_axis(values, order, 1)
    centres = queries @ directions[:-1]  # the further coordinate of a query is 0
    least = int(np.ceil(SHARE * len(values)))
    wanted = min(n, k + 1 + int(VERIFIED * n))
    # the first window holds three quarters of an array if it stands at its middle
    radius = float(np.median(values[:, (7 * n) // 8] - values[:, n // 8]) / 2) or longest

    growing = np.arange(len(queries))
    while len(growing):
        low = np.stack([np.searchsorted(v, centres[growing, j] - radius, "left") for j, v in enumerate(values)], 1)
        high = np.stack([np.searchsorted(v, centres[growing, j] + radius, "right") for j, v in enumerate(values)], 1)
        left = []
        for q, a, b in zip(growing.tolist(), low, high, strict=True):
            inside = (places - a.astype(places.dtype)[:, None]) < (b - a).astype(places.dtype)[:, None]
            inside[b - a == n] = True  # a window over all of 2^16 vectors has no such length
            near = inside.view(np.uint8).sum(0, dtype=np.uint8) >= least
            if np.count_nonzero(near) < wanted and (a.any() or (b < n).any()):
                left.append(q)
                continue
            which = np.flatnonzero(near & (ids != query_ids[q]))
            # the best by a quick product, and what may equal them, get the exact one
            quick = vectors[which] @ queries[q]
            if len(which) > 2 * k:
                bar = np.partition(quick, len(quick) - k)[len(quick) - k]
                which = which[quick >= bar - 1e-9 * (abs(bar) + longest * np.abs(queries[q]).sum())]
            found = exact_products(vectors[which], queries[q])
            best = np.lexsort((ids[which], -found))[:k]
            yield q, ids[which[best]], found[best]
        growing = np.array(left, int)
        radius *= GROWTH


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``v`` (doubles) of rows that take part; a row without an id cannot be named and does not."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of each query's ``k`` largest inner products.

    ``is_query`` is a condition on ``vec_id``. Vectors are compared with those of their own length. Every row but
    the query's own is a candidate; other rows with its id are left out as well. Where rows repeat an id, each
    counts as a candidate, and each has a list of its own as a query: rows that are equal have equal lists.
    """
    rows = usable(vectors).withColumn("d", F.size("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    # unit vectors lie in the middle of a range; a norm too small for its square gets the lowest one
    rows = rows.withColumn("r", F.coalesce(F.floor(F.log2(norm) * RANGES + 0.5).cast("int"), F.lit(-(1 << 20))))
    # one row per length of vectors and range of norms: how many there are, and the longest norm
    ranges = rows.groupBy("d", "r").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.max(norm).alias("longest"))
    parts = rows.groupBy("d").agg(F.ceil(F.sum(is_query.cast("long")) / QUERY_BLOCK).cast("int").alias("parts"))
    sizes = F.broadcast(ranges.join(parts, "d").filter("parts > 0"))  # a double has no more than some thousand ranges
    # equal rows are searched once; a query row is told by its id and 128 bits of its vector
    asked = rows.filter(is_query).groupBy("vec_id", "v", "d").agg(F.count("*").alias("copies")).join(sizes, "d")
    keys = ["high", "low"]
    asked = asked.withColumn("high", F.xxhash64("v")).withColumn("low", F.xxhash64(F.lit(2), F.reverse("v")))
    rows = rows.join(sizes, ["d", "r"])
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    part = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("parts")).cast("int")
    candidates = rows.select("d", "r", "longest", block.alias("b"), F.explode(F.expr("sequence(0, parts - 1)")).alias("p"), F.lit(0).cast("long").alias("copies"), *[F.lit(0).cast("long").alias(c) for c in keys], "vec_id", "v")
    queries = asked.select("d", "r", "longest", F.explode(F.expr("sequence(0, blocks - 1)")).alias("b"), part.alias("p"), "copies", *keys, "vec_id", "v")

    named = [("query_id", np.int64), ("high", np.int64), ("low", np.int64), ("copies", np.int64), ("vec_id", np.int64), ("score", np.float64)]

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        copies, ids, high, low = (table.column(c).to_numpy() for c in ("copies", "vec_id", "high", "low"))
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        ask = copies > 0
        out = [[np.zeros(0, t)] for _, t in named]
        if ask.any() and not ask.all():
            longest = table.column("longest")[0].as_py()
            which = np.flatnonzero(ask)
            for q, found, products in search_block(ids[~ask], flat[~ask], longest, ids[ask], flat[ask], k):
                own = [np.full(len(found), column[which[q]], np.int64) for column in (ids, high, low, copies)]
                for column, values in zip(out, [*own, found, products], strict=True):
                    column.append(values)
        return pa.table([pa.array(np.concatenate(o)) for o in out], names=[n for n, _ in named])

    schema = "query_id long, high long, low long, copies long, vec_id long, score double"
    found = candidates.unionByName(queries).groupBy("d", "r", "b", "p").applyInArrow(group, schema)
    ranked = F.row_number().over(Window.partitionBy("query_id", *keys).orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", ranked).filter(F.col("rank") <= k)
    each = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("query_id", "rank", "vec_id", "score")
