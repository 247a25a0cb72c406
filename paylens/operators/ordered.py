"""Row numbers, ranks and previous rows over one order of a whole frame.

A window without a partition moves all rows to one task. Here the rows are
ranged over tasks and sorted there, and written once; what a task needs of those
before it, a count and a last row, is one row a task. ``checkpoint`` holds the
ranges, so that a lost executor's rows come back with the same places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paylens.session import checkpointed

_PART, _PLACE, _BEFORE = "__part", "__place", "__before"
#: Low bits of ``monotonically_increasing_id``: the place of a row in its task.
_PLACE_BITS = 33


def _ranged(df: DataFrame, order: Sequence[Column], tasks: int | None) -> DataFrame:
    """The rows in order, with their task and their place in it."""
    clash = {_PART, _PLACE, _BEFORE} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are taken")
    parted = df.repartitionByRange(tasks, *order) if tasks else df.repartitionByRange(*order)
    place = F.monotonically_increasing_id()
    placed = parted.sortWithinPartitions(*order).withColumn(_PLACE, place)
    return checkpointed(
        placed.withColumn(_PART, F.shiftright(_PLACE, _PLACE_BITS)).withColumn(
            _PLACE, F.col(_PLACE).bitwiseAND(F.lit(2**_PLACE_BITS - 1))
        )
    )


def _one_a_task(ranged: DataFrame, *made: Column) -> DataFrame:
    """A row for each task that has rows; their window is over tasks, not over rows."""
    return ranged.groupBy(_PART).agg(*made)


def numbered(df: DataFrame, order: Sequence[Column], name: str, tasks: int | None = None) -> DataFrame:
    """Add the number of each row, from 1, in an order that leaves no ties open."""
    ranged = _ranged(df, order, tasks)
    counts = _one_a_task(ranged, F.count(F.lit(1)).alias("__rows"))
    earlier = W.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(_PART, F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias(_BEFORE))
    joined = ranged.join(F.broadcast(offsets), _PART)  # a row a task
    return joined.withColumn(name, F.col(_BEFORE) + F.col(_PLACE) + 1).drop(_PART, _PLACE, _BEFORE)


def ranked(df: DataFrame, value: str, name: str, ascending: bool = False, tasks: int | None = None) -> DataFrame:
    """Add the rank by ``value`` as SQL's ``rank()`` gives it, nulls last. Equal values share the lowest number.

    Values are counted before they are ranged, so that one which a third of all
    rows hold is one row.
    """
    held = df.groupBy(F.col(value).alias("__value")).agg(F.count(F.lit(1)).alias("__rows"))
    order = F.col("__value").asc_nulls_last() if ascending else F.col("__value").desc_nulls_last()
    ranged = _ranged(held, [order], tasks)
    inside = W.partitionBy(_PART).orderBy(_PLACE).rowsBetween(W.unboundedPreceding, -1)
    counts = _one_a_task(ranged, F.sum("__rows").alias("__all"))
    earlier = W.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(_PART, F.coalesce(F.sum("__all").over(earlier), F.lit(0)).alias(_BEFORE))
    ranks = ranged.withColumn("__inside", F.coalesce(F.sum("__rows").over(inside), F.lit(0)))
    ranks = ranks.join(F.broadcast(offsets), _PART).select("__value", (F.col(_BEFORE) + F.col("__inside") + 1).alias(name))
    return df.join(ranks, df[value].eqNullSafe(ranks["__value"])).drop("__value")


def lagged(
    df: DataFrame, order: Sequence[Column], columns: dict[str, str], tasks: int | None = None
) -> DataFrame:
    """Add values of the row before in an order that leaves no ties open; null for the first row."""
    ranged = _ranged(df, order, tasks)
    inside = W.partitionBy(_PART).orderBy(_PLACE)
    last = F.max_by(F.struct(*columns), _PLACE).alias("__last")
    before = _one_a_task(ranged, last).select(_PART, F.lag("__last").over(W.orderBy(_PART)).alias(_BEFORE))
    joined = ranged.join(F.broadcast(before), _PART)  # a row a task
    values = {
        new: F.when(F.col(_PLACE) == 0, F.col(_BEFORE)[old]).otherwise(F.lag(old).over(inside))
        for old, new in columns.items()
    }
    return joined.withColumns(values).drop(_PART, _PLACE, _BEFORE)
