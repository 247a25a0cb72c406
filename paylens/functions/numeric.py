"""Numeric column expressions shared by the operators.

Every quotient is null, never an error, when its denominator is zero or null.
Floating measures are amounts of money and are summed on a decimal grid: plain
double addition depends on the order in which partial sums merge, so a retried
task or another partition count could flip a tie in a ranking. Means of quotients
are plain averages. All of it is built-in, code-generated arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MILLION = 1_000_000


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent_of(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole``."""
    return F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double"))


def growth_pct(current: Column, previous: Column, digits: int | None = None) -> Column:
    """Change from ``previous`` to ``current`` in percent of ``previous``."""
    pct = percent_of(current - previous, previous)
    return pct if digits is None else F.round(pct, digits)


def relative_growth_pct(current: Column, previous: Column) -> Column:
    """Relative change as a factor first, then scaled: ``(current / previous - 1) * 100``."""
    return (ratio(current, previous) - F.lit(1.0)) * F.lit(100.0)


def grid_total(value: Column, digits: int = 6) -> Column:
    """Sum of a floating column on a grid of ``10 ** -digits``, as a double.

    Each value is put on the grid and cut into two whole numbers, which are
    summed as such: the result does not depend on order, partitions or retries,
    and is exact for values on the grid (amounts of money). Smaller parts than
    half the grid count as nothing; choose more digits where they matter, or
    plain ``F.sum``. NaN counts as missing. Values of 9e17 and more, far beyond
    the grid's use, are added as plain doubles.
    """
    if not 0 <= digits <= 12:
        raise ValueError("digits from 0 to 12")
    million, steps = F.lit(_MILLION), F.lit(float(10**digits))
    present = F.when(~F.isnan(value), value)
    large = F.abs(present) >= F.lit(9e17)
    within = F.when(~large, present)
    units = within.cast("bigint")
    parts = F.rint((within - units) * steps).cast("bigint")

    def summed(limb: Column) -> Column:
        return F.sum(limb).cast("decimal(20,0)")

    step = F.lit(f"{10.0**-digits:.{digits}f}").cast(f"decimal({digits + 1},{digits})")
    whole = (
        summed(F.call_function("div", units, million)) * million.cast("decimal(7,0)")
        + summed(units % million)
        + summed(parts) * step
    ).cast("double")
    beyond = F.sum(F.when(large, present))
    return F.coalesce(whole + beyond, whole, beyond)


def _is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def total(df: DataFrame, measure: str, digits: int | None = 6) -> Column:
    """Sum of a measure of ``df``: bigint for integers, double for everything else.

    Floating measures are summed on a grid of ``digits`` (see ``grid_total``), or
    as plain doubles if that is None.
    """
    data_type = df.schema[measure].dataType
    column = F.col(measure)
    if _is_floating(data_type):
        value = column.cast("double")
        return F.sum(F.when(~F.isnan(value), value)) if digits is None else grid_total(value, digits)
    if isinstance(data_type, T.DecimalType):
        return F.sum(column).cast("double")
    return F.sum(column)


def plain_mean(value: Column) -> Column:
    """Mean of quotients, rates and shares; nulls and NaN are left out."""
    return F.avg(F.when(~F.isnan(value), value))


def grid_mean(value: Column, digits: int) -> Column:
    """Mean of values that are on a grid already, say rounded percentages; in any order the same."""
    counted = F.count(F.when(~F.isnan(value), value))
    return F.try_divide(grid_total(value, digits), counted.cast("double"))


def mean(df: DataFrame, measure: str) -> Column:
    """Mean of a measure of ``df``."""
    if _is_floating(df.schema[measure].dataType):
        return plain_mean(F.col(measure).cast("double"))
    return ratio(F.sum(measure), F.count(measure))
