"""Change between periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paylens.functions import grid_mean, growth_pct, relative_growth_pct, total
from paylens.operators.common import (
    both_ends,
    bottom_rows,
    keyed_growth,
    top_rows,
    totals,
    with_previous,
)


def growth(
    df: DataFrame,
    period: str,
    measures: dict[str, str],
    *,
    digits: int | None = None,
    base_period: int | None = None,
    require_previous: bool = False,
) -> DataFrame:
    """Totals per period and their growth over the previous one.

    ``measures`` maps input column to the name of its total; growth is named
    ``<total>_growth_pct``. Growth is taken before ``base_period`` is dropped.
    """
    summed = totals(df, [period], measures)
    names = list(measures.values())
    lagged = with_previous(summed, [], [period], {n: f"__prev_{n}" for n in names})
    if require_previous:
        for n in names:
            lagged = lagged.filter(F.col(f"__prev_{n}").isNotNull())
    if base_period is not None:
        lagged = lagged.filter(F.col(period) != base_period)

    def pct(name):
        current, previous = F.col(name), F.col(f"__prev_{name}")
        if digits is None:
            return relative_growth_pct(current, previous)
        return growth_pct(current, previous, digits)

    return lagged.select(
        period, *names, *[pct(n).alias(f"{n}_growth_pct") for n in names]
    ).orderBy(period)


def avg_growth_of_extremes(
    df: DataFrame, key: str, period: str, measure: str, *, k: int, since: int, n: int
) -> DataFrame:
    """Mean yearly growth of the keys that were ever among the ``k`` best or worst of a year."""
    yearly = keyed_growth(df, key, period, measure)
    ranked = yearly.filter(F.col("growth").isNotNull())
    extremes = both_ends(ranked, "growth", k, partition=[period], tie=[key]).select(key).distinct()
    mean = (
        yearly.filter(F.col(period) >= since)
        .join(extremes, key, "left_semi")
        .groupBy(key)
        .agg(grid_mean(F.col("growth"), 2).alias("avg_growth_pct"))
    )
    best = top_rows(mean, "avg_growth_pct", n, [key])
    return best.fillna(0.0, subset=["avg_growth_pct"])


def declining_trend(
    df: DataFrame,
    key: str,
    period: str,
    measure: str,
    *,
    window: tuple[int, int],
    target: int,
    n: int,
) -> DataFrame:
    """Growth series of the ``n`` keys that grew least in ``target``."""
    yearly = keyed_growth(df.filter(F.col(period).between(*window)), key, period, measure)
    known = yearly.filter(F.col("previous").isNotNull())
    # A limit of n rows bounds this side.
    weakest = F.broadcast(
        bottom_rows(known.filter(F.col(period) == target), "growth", n, [key]).select(key)
    )
    return (
        known.join(weakest, key, "left_semi")
        .select(key, period, F.col("growth").alias("growth_pct"))
        .orderBy(key, period)
    )


def peak_period_spike(
    df: DataFrame, outer: str, inner: str, measure: str, *, window: tuple[int, int]
) -> DataFrame:
    """Per ``outer`` period, the ``inner`` period that rose most over the one before it."""
    summed = totals(df.filter(F.col(outer).between(*window)), [outer, inner], {measure: "total"})
    lagged = with_previous(summed, [], [outer, inner], {"total": "previous"})
    spiked = lagged.withColumn("spike", growth_pct(F.col("total"), F.col("previous")))
    order = W.partitionBy(outer).orderBy(F.col("spike").desc_nulls_last(), F.col(inner))
    return (
        spiked.withColumn("__rank", F.row_number().over(order))
        .filter(F.col("__rank") == 1)
        .select(
            outer,
            F.col(inner).alias(f"{inner.lower()}_with_max_spike"),
            "total",
            "previous",
            F.round("spike", 2).alias("spike_pct"),
        )
        .orderBy(outer)
    )


def adjacent_period_delta(
    df: DataFrame, key: str | Sequence[str], period: str, measure: str, *, target: int, n: int
) -> DataFrame:
    """Largest absolute rise from ``target - 1`` to ``target``; keys need both years.

    One conditional aggregation reads just two years and shuffles once per key,
    where joining yearly totals to themselves would shuffle each side.
    """
    keys = [key] if isinstance(key, str) else list(key)
    both = df.filter(F.col(period).isin(target - 1, target)).select(
        *keys,
        F.when(F.col(period) == target, F.col(measure)).alias("now"),
        F.when(F.col(period) == target - 1, F.col(measure)).alias("before"),
        (F.col(period) == target).alias("is_now"),
    )
    change = (
        both.groupBy(*keys)
        .agg(
            total(both, "now").alias("now"),
            total(both, "before").alias("before"),
            F.max("is_now").alias("has_now"),
            F.min("is_now").alias("only_now"),
        )
        .filter(F.col("has_now") & ~F.col("only_now"))
        .select(*keys, (F.col("now") - F.col("before")).alias("growth_from_prev_year"))
    )
    return top_rows(change, "growth_from_prev_year", n, keys)


def consistent_growth(
    left: DataFrame,
    right: DataFrame,
    key: str,
    period: str,
    *,
    left_measure: str,
    right_measure: str,
    left_name: str,
    right_name: str,
    n: int,
) -> DataFrame:
    """Keys whose mean yearly growth is positive in both facts, best of ``right`` first."""

    def rates(df, measure, name):
        known = keyed_growth(df, key, period, measure).filter(F.col("previous").isNotNull())
        return known.select(key, period, F.col("growth").alias(name))

    paired = rates(left, left_measure, "__left").join(
        rates(right, right_measure, "__right"), [key, period]
    )
    means = (
        paired.groupBy(key)
        .agg(
            grid_mean(F.col("__left"), 2).alias("left_mean"),
            grid_mean(F.col("__right"), 2).alias("right_mean"),
        )
        .filter((F.col("left_mean") > 0) & (F.col("right_mean") > 0))
        .select(
            key,
            F.round("left_mean", 2).alias(left_name),
            F.round("right_mean", 2).alias(right_name),
        )
    )
    return top_rows(means, right_name, n, [key])
