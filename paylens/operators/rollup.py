"""Headline totals, categories and per-state roll-ups of one slice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.functions import plain_mean, ratio, total
from paylens.operators.common import totals
from paylens.operators.quantiles import percentiles

# Fixed value: one crore.
CRORE = 1e7


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def count_amount_kpis(
    df: DataFrame, count: str, amount: str, *, truncate_crore: bool
) -> DataFrame:
    """Total count and amount, amount per count (0 without any) and the amount in crore."""
    sums = df.agg(total(df, count).alias("total_count"), total(df, amount).alias("total_amount"))
    crore = F.col("total_amount") / F.lit(CRORE)
    # The truncating display drops the fraction, the other rounds half to even.
    shown = crore.cast("bigint") if truncate_crore else F.rint(crore).cast("bigint")
    return sums.select(
        F.coalesce("total_count", F.lit(0)).alias("total_count"),
        F.coalesce("total_amount", F.lit(0.0)).alias("total_amount"),
        F.coalesce(ratio(F.col("total_amount"), F.col("total_count")), F.lit(0.0)).alias(
            "average_value"
        ),
        F.coalesce(shown, F.lit(0)).alias("amount_crore"),
    )


def sum_kpis(df: DataFrame, measures: dict[str, str]) -> DataFrame:
    return df.agg(
        *[F.coalesce(total(df, m), F.lit(0)).alias(name) for m, name in measures.items()]
    )


def category_totals(df: DataFrame, category: str, measure: str, *, name: str) -> DataFrame:
    """Every category's total as a whole number, largest first."""
    summed = totals(df, [category], {measure: name})
    return summed.orderBy(F.col(name).desc_nulls_last(), category).withColumn(
        name, F.round(name, 0).cast("bigint")
    )


def state_metrics(
    df: DataFrame, key: str, measures: list[str], *, mean_of: tuple[str, str] | None = None,
    mean_name: str = "average_value",
) -> DataFrame:
    """Sums per state and, if asked, the unweighted mean of the rows' own quotients; in no order."""
    sums = [total(df, m).alias(m) for m in measures]
    if mean_of is not None:
        quotient = ratio(F.col(mean_of[0]), F.col(mean_of[1]))
        sums.append(plain_mean(quotient).alias(mean_name))
    return df.groupBy(key).agg(*sums)


def color_bounds(metrics: DataFrame, measure: str, low: float = 0.05, high: float = 0.95):
    """Interpolated percentiles of a per-state metric, as the ends of a colour scale."""
    ends = F.percentile(measure, F.array(F.lit(low), F.lit(high)))
    return metrics.agg(ends.alias("__ends")).select(
        F.get("__ends", F.lit(0)).alias("vmin"), F.get("__ends", F.lit(1)).alias("vmax")
    )


def value_bounds(df: DataFrame, measure: str, shares: Sequence[float]) -> DataFrame:
    """(share, value): interpolated percentiles of a metric with any number of rows, by passes over it."""
    ends = percentiles(df, measure, shares)
    return df.sparkSession.createDataFrame(list(zip(map(float, shares), ends)), "share double, value double")


def geo_coverage(metrics: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Metrics with a flag telling whether a map feature of the same name exists."""
    known = features.select(F.col(key)).distinct().withColumn("has_feature", F.lit(True))
    return (
        metrics.join(known, key, "left")
        .withColumn("has_feature", F.coalesce("has_feature", F.lit(False)))
        .orderBy(key)
    )


def geo_unmatched(metrics: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Names found on one side only: states missing on the map, features without data."""
    states, shapes = metrics.select(key).distinct(), features.select(key).distinct()
    return (
        states.join(shapes, key, "left_anti")
        .withColumn("missing_in", F.lit("features"))
        .unionByName(
            shapes.join(states, key, "left_anti").withColumn("missing_in", F.lit("metrics"))
        )
        .orderBy("missing_in", key)
    )
