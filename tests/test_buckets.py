"""Bucketed tables: replaced as a whole, summed without an exchange."""

import pytest
from pyspark.sql import functions as F

from checks.registry import YEARS
from paylens import QUERIES, FactModel
from paylens.sinks import write_bucketed
from paylens.sources import tables
from paylens.sources.star_schema import star_model


@pytest.fixture
def database(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS buckets_of_tests")
    yield "buckets_of_tests"
    spark.sql("DROP DATABASE buckets_of_tests CASCADE")


def test_growth_of_pincodes_over_buckets_moves_no_rows(spark, star, database, rows):
    model = star_model(spark, star)
    write_bucketed(model.table("top_ins"), f"{database}.top_ins", "Pincode", 4)
    stored = FactModel.of(lambda name: tables.scan_table(spark, name, f"{database}.{name}"))
    growth = QUERIES["pincode_growth"](stored, YEARS)
    assert rows(growth) == rows(QUERIES["pincode_growth"](model, YEARS)) and rows(growth)
    plan = growth._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Bucketed: true" in plan
    # Two tables of as many buckets join without one.
    write_bucketed(model.table("top_trans"), f"{database}.top_trans", "Pincode", 4)
    sums = [stored.table(n).groupBy("Pincode").agg(F.count("*").alias(n)) for n in ("top_ins", "top_trans")]
    joined = sums[0].hint("merge").join(sums[1], "Pincode")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
    assert joined.count() == model.table("top_ins").select("Pincode").intersect(model.table("top_trans").select("Pincode")).count()


def test_a_failed_replace_leaves_the_table_whole(spark, database):
    table = f"{database}.t"
    first, second = (spark.range(n).withColumn("Pincode", F.col("id") % 3) for n in (5, 7))
    held = write_bucketed(first, table, "Pincode", 2)
    broken = second.withColumn("id", F.when(F.col("id") == 6, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="killed"):
        write_bucketed(broken, table, "Pincode", 2)
    assert spark.table(table).count() == 5
    reader = spark.table(table)
    write_bucketed(second, table, "Pincode", 2)
    assert spark.table(table).count() == 7 and reader.count() == 5
    write_bucketed(first, table, "Pincode", 2)
    assert spark.table(table).count() == 5 and not spark.catalog.tableExists(held)
    assert len(spark.catalog.listTables(database)) == 3  # the view and two versions
