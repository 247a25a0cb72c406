"""Shares of a whole, and comparisons between facts or keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.functions import plain_mean, percent_of
from paylens.operators.common import bottom_rows, totals


def avg_share(
    df: DataFrame, period: str, category: str, measure: str, *, name: str, digits: int = 2
) -> DataFrame:
    """Each category's share of its period, averaged over periods without weights."""
    by_category = totals(df, [period, category], {measure: "__part"})
    # Summing the sums again keeps a period from being gathered in one task, as
    # a window over it would.
    by_period = totals(by_category, [period], {"__part": "__whole"})
    shares = by_category.join(by_period, period).select(
        category, percent_of(F.col("__part"), F.col("__whole")).alias("__share")
    )
    return (
        shares.groupBy(category)
        .agg(F.round(plain_mean(F.col("__share")), digits).alias(name))
        .orderBy(category)
    )


def penetration(
    base: DataFrame,
    part: DataFrame,
    key: str,
    *,
    base_count: str,
    base_amount: str,
    part_count: str,
    part_amount: str,
    n: int,
) -> DataFrame:
    """How far one fact reaches into another per key, lowest count rate first."""
    base_totals = totals(base, [key], {base_count: "base_count", base_amount: "base_amount"})
    part_totals = totals(part, [key], {part_count: "part_count", part_amount: "part_amount"})
    rated = (
        base_totals.join(part_totals, key, "left")
        .withColumn(
            "penetration_rate", F.round(percent_of(F.col("part_count"), F.col("base_count")), 5)
        )
        .withColumn(
            "value_share", F.round(percent_of(F.col("part_amount"), F.col("base_amount")), 5)
        )
        .filter(F.col("penetration_rate").isNotNull())
    )
    return bottom_rows(rated, "penetration_rate", n, [key])


def pct_difference(
    df: DataFrame, key: str, first: str, second: str, measure: str, *, name: str
) -> DataFrame:
    """By how many percent ``first`` exceeds ``second``; an absent key counts as zero."""
    # Plain sums: two keys of a report, on whatever scale it was given.
    sums = df.filter(F.col(key).isin(first, second)).agg(
        F.coalesce(F.sum(F.when(F.col(key) == first, F.col(measure))), F.lit(0)).alias("__first"),
        F.coalesce(F.sum(F.when(F.col(key) == second, F.col(measure))), F.lit(0)).alias("__second"),
    )
    return sums.select(
        percent_of(F.col("__first") - F.col("__second"), F.col("__second")).alias(name)
    )
