"""Consecutive numbers within groups of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable


def join_on(
    left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner", *, scopes: list[str] = ()
) -> DataFrame:
    """Equi-join on ``columns``, and on ``scopes`` with null equal to null; each is kept once.

    The columns of the right side are renamed first, so both sides may stem from one table.
    ``columns`` must not be null in rows that should meet. A value found everywhere is split over tasks by adaptive execution, as its right side is
    one row.
    """
    renamed = {c: f"__right_{c}" for c in dict.fromkeys([*scopes, *columns])}
    other = right.withColumnsRenamed(renamed)
    condition = F.lit(True)
    for mine, theirs in renamed.items():
        equal = F.col(mine).eqNullSafe(F.col(theirs)) if mine in scopes else F.col(mine) == F.col(theirs)
        condition = condition & equal
    return left.join(other, condition, how).drop(*renamed.values())


def number_within(
    df: DataFrame, group: list[str], order: list[str], into: str = "n", *, keep: Callable[[DataFrame], DataFrame] = durable
) -> DataFrame:
    """``row_number`` over (group, order) without gathering a group in one task.

    The rows are range-partitioned by (group, order), so a partition holds a stretch of
    consecutive rows. Numbers inside the stretch plus the counts of the stretches before it
    give the number. The partition numbers are made durable first: a lost task that sampled
    other bounds on recomputation would number differently. ``keep`` says where.
    """
    part, before, inside = "__part", "__before", "__inside"
    ranged = keep(df.repartitionByRange(*group, *order).withColumn(part, F.spark_partition_id()))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*group, part)
        .count()
        .select(*group, part, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias(before))
    )
    stretch = Window.partitionBy(*group, part).orderBy(*order)
    counted = ranged.withColumn(inside, F.row_number().over(stretch))
    joined = join_on(counted, offsets, [part], scopes=group)
    return joined.select(*df.columns, (F.col(inside) + F.col(before)).alias(into))
