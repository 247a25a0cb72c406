"""Top-k, both-ends and peak reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paylens.functions import mean, ratio
from paylens.operators.common import both_ends, top_rows, totals


def topk_sum(
    df: DataFrame,
    key: str | Sequence[str],
    measure: str,
    n: int,
    *,
    name: str,
    where: Column | None = None,
    digits: int | None = None,
    whole: bool = False,
) -> DataFrame:
    """The ``n`` keys with the largest total; rounding happens after the ranking.

    Pass several keys (say state and district) to keep equal names apart.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows = df if where is None else df.filter(where)
    best = top_rows(totals(rows, keys, {measure: name}), name, n, keys)
    if whole:
        return best.withColumn(name, F.round(name, 0).cast("bigint"))
    return best if digits is None else best.withColumn(name, F.round(name, digits))


def shuffled(df: DataFrame, seed: int, key: Sequence[str] | None = None) -> DataFrame:
    """Rows of a small report in a random order that only the seed and the key's values decide."""
    columns = list(key or df.columns)
    return df.orderBy(F.xxhash64(*columns, F.lit(seed)), *columns)


def top_bottom(df: DataFrame, key: str, measure: str, k: int, *, name: str) -> DataFrame:
    """Keys ranked within ``k`` from either end, ties kept, each key once."""
    summed = totals(df, [key], {measure: name})
    # The k-th value from either end decides, so no window has to hold all tied keys:
    # each threshold comes from k rows a task.
    value = F.col(name)
    best = summed.select(name).orderBy(value.desc_nulls_last()).limit(k)
    worst = summed.select(name).orderBy(value.asc_nulls_first()).limit(k)
    high = best.agg(F.struct(F.min(name).alias("v"), F.bool_or(value.isNull()).alias("missing"))).scalar()
    low = worst.agg(F.max(name)).scalar()
    # Nulls are last from the top and first from the bottom. A key at both ends counts as top.
    is_top = F.coalesce(value >= high["v"], value.isNull() & high["missing"], F.lit(False))
    is_bottom = value.isNull() | F.coalesce(value <= low, F.lit(False))
    return (
        summed.withColumn("side", F.when(is_top, "top").when(is_bottom, "bottom"))
        .where("side is not null")
        .select(key, name, "side")
        .orderBy(value.desc_nulls_last(), F.col(key))
    )


def ratio_top_bottom(
    df: DataFrame, key: str, numerator: str, denominator: str, k: int, *, name: str
) -> DataFrame:
    """Ratio of the two rounded means per key; ``k`` best and ``k`` worst.

    With fewer than ``2k`` keys a key shows up at both ends, once per end.
    """
    means = df.groupBy(key).agg(
        F.round(mean(df, numerator), 2).alias("__num"),
        F.round(mean(df, denominator), 2).alias("__den"),
    )
    rates = means.select(key, F.round(ratio(F.col("__num"), F.col("__den")), 2).alias(name))
    ends = both_ends(rates, name, k, tie=[key])
    return ends.orderBy(F.col(name).desc_nulls_last(), F.col(key), F.col("side").desc())


def period_extremes(
    df: DataFrame,
    outer: str,
    inner: str,
    numerator: str,
    denominator: str,
    *,
    name: str,
    base_period: int | None = None,
) -> DataFrame:
    """Per ``outer`` period, the ``inner`` periods with the highest and the lowest ratio."""
    summed = totals(df, [outer, inner], {numerator: "__num", denominator: "__den"})
    rates = summed.select(
        outer, inner, F.round(ratio(F.col("__num"), F.col("__den")), 4).alias(name)
    )
    if base_period is not None:
        rates = rates.filter(F.col(outer) != base_period)
    ends = both_ends(rates, name, 1, partition=[outer], with_ties=True).drop("side")
    return ends.distinct().orderBy(outer, F.col(name).asc_nulls_first(), inner)


def peak_period(df: DataFrame, outer: str, inner: str, measure: str, *, name: str) -> DataFrame:
    """Per ``outer`` period, the ``inner`` period or periods with the largest total."""
    summed = totals(df, [outer, inner], {measure: name})
    order = W.partitionBy(outer).orderBy(F.col(name).desc_nulls_last())
    return (
        summed.withColumn("__rank", F.rank().over(order))
        .filter(F.col("__rank") == 1)
        .drop("__rank")
        .orderBy(outer, inner)
    )


def range_topk(
    df: DataFrame, key: str, period: str, measure: str, n: int, *, name: str, scale: float = 1.0
) -> DataFrame:
    """Spread between a key's best and worst period total, largest spreads first."""
    spread = spread_of_totals(df, key, period, measure, name=name, scale=scale)
    return top_rows(spread, name, n, [key])


def spread_of_totals(
    df: DataFrame, key: str, period: str, measure: str, *, name: str, scale: float = 1.0
) -> DataFrame:
    summed = totals(df, [key, period], {measure: "__total"})
    spread = (F.max("__total") - F.min("__total")) / F.lit(scale)
    return summed.groupBy(key).agg(spread.alias(name))


def nested_topk_share(
    df: DataFrame,
    outer: str,
    inner: str,
    *,
    rank_by: str,
    share_of: str,
    k_outer: int,
    k_inner: int,
    total_name: str,
    share_name: str,
) -> DataFrame:
    """Best ``k_inner`` members of the best ``k_outer`` groups, with their share of the group."""
    inner_sums = totals(df, [outer, inner], {rank_by: "__rank_by", share_of: total_name})
    # One more sum over the same shuffled rows gives both the ranking of the
    # groups and the denominators; the limit bounds the broadcast.
    groups = inner_sums.groupBy(outer).agg(
        F.sum("__rank_by").alias("__group_rank_by"), F.sum(total_name).alias("__group_total")
    )
    best = F.broadcast(top_rows(groups, "__group_rank_by", k_outer, [outer]))
    shares = inner_sums.join(best.drop("__group_rank_by"), outer).withColumn(
        share_name,
        F.round(ratio(F.col(total_name), F.col("__group_total")) * F.lit(100.0), 2),
    )
    order = W.partitionBy(outer).orderBy(
        F.col("__rank_by").desc_nulls_last(), F.col(inner).asc_nulls_first()
    )
    return (
        shares.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= k_inner)
        .select(outer, inner, total_name, share_name, "position")
        .orderBy(outer, "position")
    )
