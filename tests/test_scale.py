"""What the plans must look like, and what hot keys must not change."""

import pytest
from pyspark.sql import functions as F

from checks.plans import final_plan, profile
from paylens.plans import explorer
from paylens.plans.cases import QUERIES, CaseYears
from paylens.sources.star_schema import COLUMNS, star_model
from tests.conftest import STAR

YEARS = CaseYears(base=1995, since=1996, window=(1997, 2001), span=(1995, 2001), target=2000)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def settings(spark):
    """Change session settings for one test."""
    before = {}

    def change(**values):
        for key, value in values.items():
            key = "spark.sql." + key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_questions_read_each_fact_once_and_multiply_nothing(spark, star, name):
    found = profile(final_plan(QUERIES[name](star_model(spark, star), YEARS)))
    assert found["PRODUCT"] == 0
    assert found["scan lineitem"] <= 1
    # Consistent growth takes users and payments from the orders, once each.
    assert found["scan orders"] <= (2 if name == "consistent_growth" else 1)


def test_no_plan_leaves_the_jvm(spark, star):
    for name in QUERIES:
        plan = plan_of(QUERIES[name](star_model(spark, star), YEARS))
        assert "Python" not in plan and "Pandas" not in plan


def test_years_and_quarters_reach_the_scan_as_date_ranges(spark, star):
    model = star_model(spark, star)
    plan = plan_of(QUERIES["top_states_insurance"](model, YEARS))
    assert "GreaterThanOrEqual(l_shipdate,2000-01-01T00:00)" in plan
    assert "LessThan(l_shipdate,2001-01-01T00:00)" in plan
    assert "EqualTo(l_returnflag,R)" in plan
    plan = plan_of(explorer.kpis(model, "transactions", 2000, 4))
    assert "GreaterThanOrEqual(o_orderdate,2000-10-01T00:00)" in plan
    assert "LessThan(o_orderdate,2001-01-01T00:00)" in plan


def test_ranges_and_filters_select_the_same_rows(spark, star):
    model = star_model(spark, star)
    for name in ("agg_trans", "map_ins", "top_user"):
        whole = model.table(name)
        for years, quarter in [((1996, 1998), None), ((1996, 1996), 2), ((1996, 1997), 4), (None, 3)]:
            wanted = whole
            if years:
                wanted = wanted.filter(F.col("Year").between(*years))
            if quarter:
                wanted = wanted.filter(F.col("Quarter") == quarter)
            got = model.table(name, years=years, quarter=quarter)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_scans_read_only_what_is_used(spark, star):
    plan = plan_of(QUERIES["top_states_insurance"](star_model(spark, star), YEARS))
    lines = [p for p in plan.splitlines() if "FileScan" in p and "lineitem" in p]
    assert all("l_orderkey" not in p and "l_partkey" not in p for p in lines)
    # Counting needs no prices.
    plan = plan_of(QUERIES["peak_quarter_spike"](star_model(spark, star), YEARS))
    assert "o_totalprice" not in plan and "o_orderpriority:" in plan


def test_both_ends_are_limited_before_the_shuffle(spark, star):
    # Ends with ties come from two thresholds, without a window over all brands.
    plan = plan_of(QUERIES["brand_top_bottom"](star_model(spark, star), YEARS))
    assert "Window" not in plan and "TakeOrderedAndProject" in plan
    plan = plan_of(QUERIES["avg_yoy_growth_extremes"](star_model(spark, star), YEARS))
    assert plan.count("row_number(), 3, Partial") == 2


def test_pincode_growth_shuffles_each_pincode_once(spark, star):
    before = plan_of(star_model(spark, star).table("top_ins", years=(1999, 2000)))
    after = plan_of(QUERIES["pincode_growth"](star_model(spark, star), YEARS))
    assert after.count("Exchange hashpartitioning") == before.count("Exchange hashpartitioning") + 1
    assert "TakeOrderedAndProject" in after


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """The tables with a third of the rows moved to one customer, part and supplier."""
    folder = tmp_path_factory.mktemp("skewed")

    def read(table):
        return spark.read.schema(COLUMNS[table]).parquet(f"{STAR}/{table}.parquet")

    def move(df, *keys):
        for key in keys:
            kind = df.schema[key].dataType
            hot = F.pmod(F.xxhash64("l_orderkey" if "l_orderkey" in df.columns else "o_orderkey"), F.lit(3)) == 0
            df = df.withColumn(key, F.when(hot, F.lit(1).cast(kind)).otherwise(F.col(key)))
        return df

    frames = {t: read(t) for t in COLUMNS}
    frames["orders"] = move(frames["orders"], "o_custkey")
    frames["lineitem"] = move(frames["lineitem"], "l_partkey", "l_suppkey")
    for table, df in frames.items():
        # Several files, so that a hot partition has several pieces to be split by.
        df.repartition(6).write.parquet(f"{folder}/{table}.parquet")
    return str(folder)


# A cluster's thresholds, scaled down to a few thousand rows.
SMALL = {
    "autoBroadcastJoinThreshold": "-1",
    "adaptive__autoBroadcastJoinThreshold": "-1",
    "adaptive__skewJoin__skewedPartitionThresholdInBytes": "4KB",
    "adaptive__skewJoin__skewedPartitionFactor": "2",
    "adaptive__advisoryPartitionSizeInBytes": "4KB",
}


@pytest.mark.parametrize(
    ("table", "joins"), [("agg_trans", 1), ("map_trans", 1), ("map_ins", 2), ("agg_user", 2)]
)
def test_hot_join_keys_are_split(spark, skewed, settings, table, joins):
    settings(**SMALL)
    assert final_plan(star_model(spark, skewed).table(table)).count("skew=true") == joins


@pytest.mark.parametrize(
    ("table", "fact"),
    [
        ("top_trans", "orders"),
        ("top_ins", "lineitem"),
        ("agg_ins", "lineitem"),
        ("map_user", "lineitem"),
        ("top_user", "lineitem"),
    ],
)
def test_hot_keys_are_folded_before_the_join(spark, skewed, table, fact):
    """The first shuffle of the fact comes after a map-side aggregation."""
    lines = plan_of(star_model(spark, skewed).table(table)).splitlines()
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and f"{fact}.parquet" in x)
    above = [x for x in lines[:scan] if "HashAggregate" in x or "Exchange hashpartitioning" in x]
    assert "HashAggregate" in above[-1]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_skew_and_join_strategy_change_no_result(spark, skewed, settings, name):
    by_broadcast = QUERIES[name](star_model(spark, skewed), YEARS).collect()
    settings(**SMALL, shuffle__partitions="7")
    by_shuffle = QUERIES[name](star_model(spark, skewed), YEARS).collect()
    assert by_shuffle == by_broadcast and by_shuffle

