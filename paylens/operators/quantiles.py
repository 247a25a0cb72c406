"""Exact interpolated percentiles of columns of any length, by passes that narrow value ranges.

``percentile`` holds the distinct values of a column in one task. Here each
pass counts the values that lie in the ranges still open, in a fixed number of
equal bins, and keeps the bin that holds a wanted place, with the least and
largest value in it. A range ends when it is one value. Least and largest fall
into different bins, so every pass leaves fewer distinct values; outliers cost
one pass. A pass returns at most ``BINS`` rows a range, whatever the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.session import checkpointed

BINS = 1024


@dataclass(frozen=True)
class _Range:
    """Values from ``low`` to ``high``, of which ``before`` smaller ones exist, hold the wanted place."""

    low: float
    high: float
    before: int


def _bin(value: Column, low: float, high: float) -> Column:
    """The bin of a value of a range. Halves, so that the width of a range never overflows."""
    width = high / 2 - low / 2
    if width == 0:  # neighbours at the end of what a double can tell
        return F.when(value > low, BINS - 1).otherwise(0)
    share = (value / 2 - F.lit(low / 2)) / F.lit(width)
    return F.when(value >= high, BINS - 1).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int"))


def _narrowed(finite: DataFrame, ranges: dict[int, _Range]) -> dict[int, _Range]:
    """One pass: the bin of each open range that holds its place."""
    value = F.col("value")
    distinct = sorted({(r.low, r.high) for r in ranges.values()})
    inside = [(value >= low) & (value <= high) for low, high in distinct]
    # Ranges are equal, or part in one value at most; a value may count in several.
    bins = F.array(
        *[F.when(test, F.struct(F.lit(k).alias("k"), _bin(value, *distinct[k]).alias("bin"))) for k, test in enumerate(inside)]
    )
    counted = (
        finite.select("value", F.explode(F.array_compact(bins)).alias("at"))
        .groupBy("at.k", "at.bin")
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        .collect()
    )
    narrowed = {}
    for place, r in ranges.items():
        before = r.before
        k = distinct.index((r.low, r.high))
        for row in sorted((c for c in counted if c["k"] == k), key=lambda c: c["bin"]):
            if before + row["n"] > place:
                narrowed[place] = _Range(row["low"], row["high"], before)
                break
            before += row["n"]
    return narrowed


def values_at(df: DataFrame, measure: str, places: Sequence[int]) -> dict[int, float]:
    """The values at places, counted from 0, of the measure in ascending order; nulls do not count, NaN comes last."""
    column = checkpointed(df.select(F.col(measure).cast("double").alias("value")).where("value is not null"))
    return _values_at(column, _ends(column), places)


def _ends(column: DataFrame) -> dict:
    value, infinity = F.col("value"), F.lit(math.inf)
    finite = ~F.isnan(value) & (F.abs(value) < infinity)
    return column.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(value == -infinity).alias("least"),
        F.count_if(finite).alias("finite"),
        F.count_if((value == infinity) & ~F.isnan(value)).alias("most"),
        F.min(F.when(finite, value)).alias("low"),
        F.max(F.when(finite, value)).alias("high"),
    ).first().asDict()


def _values_at(column: DataFrame, ends: dict, places: Sequence[int]) -> dict[int, float]:
    found: dict[int, float] = {}
    opened: dict[int, _Range] = {}
    for place in set(places):
        if place < ends["least"]:
            found[place] = -math.inf
        elif place < ends["least"] + ends["finite"]:
            opened[place] = _Range(ends["low"], ends["high"], ends["least"])
        else:
            found[place] = math.inf if place < ends["least"] + ends["finite"] + ends["most"] else math.nan
    finite = column.where(~F.isnan("value") & (F.abs("value") < F.lit(math.inf)))
    while True:
        found |= {place: r.low for place, r in opened.items() if r.low == r.high}
        opened = {place: r for place, r in opened.items() if r.low != r.high}
        if not opened:
            return found
        opened = _narrowed(finite, opened)


def percentiles(df: DataFrame, measure: str, shares: Sequence[float]) -> list[float | None]:
    """The values that ``percentile`` gives for shares from 0 to 1; null of no values."""
    if not all(0 <= share <= 1 for share in shares):
        raise ValueError(f"shares {shares} are not from 0 to 1")
    column = checkpointed(df.select(F.col(measure).cast("double").alias("value")).where("value is not null"))
    ends = _ends(column)
    if not ends["n"]:
        return [None] * len(shares)
    at = [(ends["n"] - 1) * share for share in shares]
    found = _values_at(column, ends, [end(p) for p in at for end in (math.floor, math.ceil)])

    def between(place: float) -> float:
        low, high = math.floor(place), math.ceil(place)
        if low == high or found[low] == found[high]:
            return found[low]
        return (high - place) * found[low] + (place - low) * found[high]

    return [between(p) for p in at]
