import random
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from paylens.functions import plain_mean, growth_pct, mean, percent_of, ratio, relative_growth_pct, total


def one(df, column):
    return df.select(column.alias("x")).first()[0]


def test_quotients_are_null_over_zero_or_null(spark):
    df = spark.createDataFrame([(5.0, 0.0, None)], "a double, zero double, missing double")
    a, zero, missing = F.col("a"), F.col("zero"), F.col("missing")
    for expression in (ratio, percent_of, growth_pct, relative_growth_pct):
        assert one(df, expression(a, zero)) is None
        assert one(df, expression(a, missing)) is None


def test_growth_rounds_only_on_request(spark):
    df = spark.createDataFrame([(7, 3)], "now bigint, before bigint")
    assert one(df, growth_pct(F.col("now"), F.col("before"))) == 4 * 100.0 / 3
    assert one(df, growth_pct(F.col("now"), F.col("before"), 2)) == 133.33
    assert one(df, relative_growth_pct(F.col("now"), F.col("before"))) == (7 / 3 - 1.0) * 100.0


@settings(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.decimals(-10**9, 10**9, places=2, allow_nan=False), min_size=1, max_size=60))
def test_total_is_the_decimal_sum(spark, amounts):
    df = spark.createDataFrame([(float(a),) for a in amounts], "v double")
    assert df.agg(total(df, "v")).first()[0] == float(sum(amounts, Decimal(0)))


def test_total_does_not_depend_on_order_or_partitions(spark):
    random.seed(3)
    amounts = [(round(random.uniform(0, 1e9), 2),) for _ in range(5000)]
    seen = set()
    for parts in (1, 3, 7, 16):
        random.shuffle(amounts)
        df = spark.createDataFrame(amounts, "v double").repartition(parts)
        seen.add(df.agg(total(df, "v")).first()[0])
    assert len(seen) == 1


def test_totals_keep_integers_and_leave_out_missing_values(spark):
    df = spark.createDataFrame(
        [(1, 1.5, Decimal("1.10")), (2, float("nan"), Decimal("2.20")), (None, None, None)],
        "n bigint, v double, d decimal(10,2)",
    )
    sums = df.agg(total(df, "n").alias("n"), total(df, "v").alias("v"), total(df, "d").alias("d"))
    assert dict(sums.dtypes) == {"n": "bigint", "v": "double", "d": "double"}
    assert tuple(sums.first()) == (3, 1.5, 3.3)
    assert df.agg(plain_mean(F.col("v"))).first()[0] == 1.5
    assert df.agg(mean(df, "n")).first()[0] == 1.5


def test_totals_outgrow_single_values(spark):
    df = spark.createDataFrame([(9e18,), (9e18,), (0.5,), (-1e18,)], "v double")
    assert df.agg(total(df, "v")).first()[0] == 1.7e19
    df = spark.createDataFrame([(-2500000.75,), (-0.25,), (1.5,)], "v double")
    assert df.agg(total(df, "v")).first()[0] == -2499999.5


def test_values_beyond_the_grid_are_added_as_doubles(spark):
    df = spark.createDataFrame([(1e30,), (0.5,), (2e19,)], "v double")
    assert df.agg(total(df, "v")).first()[0] == 1e30 + 2e19
    assert df.where("v > 1").agg(total(df, "v")).first()[0] == 1e30 + 2e19
    df = spark.createDataFrame([(3e19,)], "v double")
    assert df.agg(total(df, "v")).first()[0] == 3e19


def test_the_grid_is_a_parameter(spark):
    df = spark.createDataFrame([(1e-9,)] * 10, "v double")
    assert df.agg(total(df, "v")).first()[0] == 0.0
    assert df.agg(total(df, "v", digits=9)).first()[0] == 1e-8
    assert df.agg(total(df, "v", digits=None)).first()[0] == pytest.approx(1e-8)
    assert df.agg(mean(df, "v")).first()[0] == pytest.approx(1e-9)
    with pytest.raises(ValueError):
        total(df, "v", digits=13)


def test_overflow_raises_instead_of_wrapping(spark):
    df = spark.createDataFrame([(2**62,), (2**62,)], "n bigint")
    with pytest.raises(ArithmeticException):
        df.agg(total(df, "n")).collect()


def test_empty_totals_are_null(spark):
    df = spark.createDataFrame([], "n bigint, v double")
    assert tuple(df.agg(total(df, "n"), total(df, "v"), mean(df, "v")).first()) == (None,) * 3
