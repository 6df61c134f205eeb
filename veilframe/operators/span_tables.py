"""Overlap resolution for spans kept as a table, of documents of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import resolve_overlaps
from ..functions.sql import expr

STRETCH = 4096  # characters of a document handled by one window group


def resolve_span_table(
    spans: DataFrame,
    key: Sequence[str],
    priority: Mapping[str, int],
    *,
    order: str = "ord",
) -> DataFrame:
    """Disjoint spans per document from a table (key, label, start, end, text, ord).

    No window holds a whole document: positions are cut into stretches, the reach of the
    stretches before it is carried into each, and only runs of spans that overlap each other
    are gathered for the greedy choice. Copies of a span are dropped before the shuffle, as
    only the first of them could win.
    """
    keys, part = list(key), "__part"
    first = F.min(F.struct(order, "text")).alias("__first")
    unique = (
        spans.where(F.col("end") > F.col("start"))
        .groupBy(*keys, "start", "end", "label")
        .agg(first)
        .select(*keys, "start", "end", "label", F.col(f"__first.{order}").alias("__ord"), F.col("__first.text").alias("text"))
        .withColumn(part, F.floor(F.col("start") / STRETCH))
    )
    # furthest end in the stretches before, from one row per stretch
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    reach = unique.groupBy(*keys, part).agg(F.max("end").alias("__reach"))
    carried = reach.select(*keys, part, F.max("__reach").over(before).alias("__carried"))
    within = Window.partitionBy(*keys, part).orderBy("start", "end", "__ord", "label")
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.max("end").over(earlier), F.col("__carried"))
    headed = unique.join(carried, [*keys, part]).withColumn(
        "__head", F.when(reached.isNull() | (F.col("start") >= reached), F.col("start"))
    )
    # the start of the latest head names the island, again carried from stretch to stretch
    heads = headed.groupBy(*keys, part).agg(F.max("__head").alias("__last"))
    previous = heads.select(*keys, part, F.max("__last").over(before).alias("__from"))
    so_far = F.max("__head").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    islands = headed.join(previous, [*keys, part]).withColumn("__island", F.coalesce(so_far, F.col("__from")))
    gathered = islands.groupBy(*keys, "__island").agg(
        F.sort_array(F.collect_list(F.struct(F.col("__ord").alias("ord"), "start", "end", "label", "text"))).alias("__spans")
    )
    return gathered.select(*keys, F.inline(expr(resolve_overlaps("__spans", priority))))
