"""Building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paylens.functions import growth_pct, total


def totals(df: DataFrame, keys: Sequence[str], measures: dict[str, str]) -> DataFrame:
    """Sum each measure per key; ``measures`` maps input column to output name.

    The map-side half of the aggregation folds a hot key to one row per task
    before anything is shuffled.
    """
    return df.groupBy(*keys).agg(*[total(df, m).alias(name) for m, name in measures.items()])


def with_previous(
    summed: DataFrame, keys: Sequence[str], period: Sequence[str], columns: dict[str, str]
) -> DataFrame:
    """Add the value of the previous *existing* period per key.

    Only for frames already reduced to one row per key and period: a key then
    holds as many rows as there are periods, and so does the window without keys.
    """
    window = W.partitionBy(*keys).orderBy(*period) if keys else W.orderBy(*period)
    return summed.withColumns({new: F.lag(old).over(window) for old, new in columns.items()})


def keyed_growth(
    df: DataFrame, key: str, period: str, measure: str, digits: int | None = 2
) -> DataFrame:
    """Per key and period: ``total``, ``previous`` and ``growth`` in percent."""
    summed = totals(df, [key, period], {measure: "total"})
    lagged = with_previous(summed, [key], [period], {"total": "previous"})
    return lagged.withColumn("growth", growth_pct(F.col("total"), F.col("previous"), digits))


def _end(
    df: DataFrame,
    ranking: Column,
    order: list[Column],
    partition: Sequence[str],
    k: int,
    side: str,
) -> DataFrame:
    window = W.partitionBy(*partition).orderBy(*order) if partition else W.orderBy(*order)
    ranked = df.withColumn("__rank", ranking.over(window)).filter(F.col("__rank") <= k)
    return ranked.withColumn("side", F.lit(side)).drop("__rank")


def both_ends(
    df: DataFrame,
    value: str,
    k: int,
    *,
    partition: Sequence[str] = (),
    tie: Sequence[str] = (),
    with_ties: bool = False,
) -> DataFrame:
    """First and last ``k`` rows by ``value``, marked ``top`` or ``bottom`` in ``side``.

    Each end is a window of its own, so Spark limits it to ``k`` rows inside each
    task before the shuffle; one window ranked both ways would move whole groups.
    A row in both ends appears twice.
    """
    ranking = F.rank() if with_ties else F.row_number()
    ties = [] if with_ties else [F.col(c).asc_nulls_first() for c in tie]
    top = [F.col(value).desc_nulls_last(), *ties]
    bottom = [F.col(value).asc_nulls_first(), *ties]
    return _end(df, ranking, top, partition, k, "top").unionByName(
        _end(df, ranking, bottom, partition, k, "bottom")
    )


def top_rows(df: DataFrame, value: str, n: int, tie: Sequence[str]) -> DataFrame:
    """The ``n`` largest rows, ties broken by the key so that reruns agree."""
    return df.orderBy(
        F.col(value).desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in tie]
    ).limit(n)


def bottom_rows(df: DataFrame, value: str, n: int, tie: Sequence[str]) -> DataFrame:
    return df.orderBy(
        F.col(value).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in tie]
    ).limit(n)
