"""Numbers, ranks, previous rows and percentiles without a single task, against windows and ``percentile``."""

import math
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paylens.operators import ordered, quantiles

TASKS = 5


@pytest.fixture(scope="module", params=["many", "tied", "few", "one", "none"])
def frame(request, spark):
    chosen = random.Random(7)
    rows = {
        "many": [(i, chosen.choice([None, chosen.randint(-50, 50)]), f"n{i % 7}") for i in range(3000)],
        "tied": [(i, 5 if i % 3 else i, None) for i in range(900)],
        "few": [(2, 1, "a"), (1, None, "b"), (3, 1, "c")],
        "one": [(1, 9, "a")],
        "none": [],
    }[request.param]
    return spark.createDataFrame(rows, "id int, v int, name string").repartition(4)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_numbers_equal_the_windows(frame):
    order = [F.col("v").desc_nulls_last(), F.col("id")]
    expected = frame.withColumn("n", F.row_number().over(W.orderBy(*order)).cast("long"))
    assert collected(ordered.numbered(frame, order, "n", TASKS)) == collected(expected)


@pytest.mark.parametrize("ascending", [True, False])
def test_ranks_equal_the_windows(frame, ascending):
    order = F.col("v").asc_nulls_last() if ascending else F.col("v").desc_nulls_last()
    expected = frame.withColumn("r", F.rank().over(W.orderBy(order)).cast("long"))
    assert collected(ordered.ranked(frame, "v", "r", ascending, TASKS)) == collected(expected)


def test_previous_rows_equal_the_windows(frame):
    order = [F.col("v").asc_nulls_first(), F.col("id")]
    window = W.orderBy(*order)
    expected = frame.withColumns({"v0": F.lag("v").over(window), "name0": F.lag("name").over(window)})
    assert collected(ordered.lagged(frame, order, {"v": "v0", "name": "name0"}, TASKS)) == collected(expected)


def test_no_task_sees_all_rows(spark):
    """Rows move by ranges; only one row a task meets in one place."""
    df = spark.range(40_000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(10**6)))
    order = [F.col("v"), F.col("id")]
    sizes = ordered._ranged(df, order, 8).groupBy("__part").count().toPandas()["count"]
    assert len(sizes) == 8 and sizes.max() < 2 * 40_000 / 8
    with pytest.raises(ValueError):
        ordered.numbered(df.withColumn("__part", F.lit(1)), order, "n")


SHARES = [0.0, 0.05, 0.25, 0.5, 0.613, 0.95, 1.0]


@pytest.mark.parametrize(
    "values",
    [
        [1.0], [None], [], [2.0, 2.0, 2.0], [1.0, None, 4.0], [0.1 * i for i in range(500)], [1.0] * 400 + [7.5] * 300 + [9.0],
        [-1e308, 1e308, 3.0, 4.0, 5.0], [5e-324, 0.0, 1e-323, 1.5e-323], [10.0**i for i in range(-300, 300, 7)],
        [math.inf, 1.0, -math.inf, 2.0, 3.0], [math.nan, 1.0, 2.0, math.inf], [1.0, math.nextafter(1.0, 2.0)] * 20, [-0.0, 0.0, 1.0],
    ],
)
def test_percentiles_equal_the_built_in(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    expected = df.agg(F.percentile("v", F.array(*map(F.lit, SHARES))).alias("p")).first()["p"] or [None] * len(SHARES)
    got = quantiles.percentiles(df, "v", SHARES)
    assert [str(g) if g != 0 else "0" for g in got] == [str(e) if e != 0 else "0" for e in expected]


def test_percentiles_of_many_values(spark):
    df = spark.range(200_000).select((F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1000.0).alias("v"))
    df = df.unionByName(spark.range(100_000).select(F.lit(77.25).alias("v")))  # one value holds a third
    expected = df.agg(F.percentile("v", F.array(*map(F.lit, SHARES))).alias("p")).first()["p"]
    assert quantiles.percentiles(df, "v", SHARES) == expected
    with pytest.raises(ValueError):
        quantiles.percentiles(df, "v", [1.5])


def test_values_at_places(spark):
    df = spark.createDataFrame([(v,) for v in [3, 1, None, 2, 2]], "v int")
    assert quantiles.values_at(df, "v", [0, 1, 2, 3]) == {0: 1.0, 1: 2.0, 2: 2.0, 3: 3.0}
