"""Stored tables in versions: half a load is never seen, old versions go, counts come with the load."""

import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from paylens import schemas
from paylens.operators import quality
from paylens.plans.model import FactModel
from paylens.sinks import load_tables, stored_dimensions, stored_profile, write_table
from paylens.sinks.versions import POINTERS, Versions
from paylens.sources.star_schema import star_model
from paylens.sources.tables import read_parquet_table, scan_table


def frame(spark, n, state="s"):
    rows = [(state, 2020 + i % 3, 1 + i % 4, "Insurance", i, float("nan") if i % 7 == 3 else float(i)) for i in range(n)]
    return spark.createDataFrame(rows, schemas.TABLES["agg_ins"])


def read(spark, path):
    return sorted(map(repr, read_parquet_table(spark, str(path), "agg_ins").collect()))


def failing(df):
    """Some quarters are written, then a task fails."""
    return df.withColumn("State", F.when((F.col("Year") == 2022) & (F.col("Quarter") == 3), F.raise_error(F.lit("killed"))).otherwise(F.col("State")))


def test_a_load_that_fails_half_way_leaves_the_old_table_whole(spark, tmp_path):
    path = tmp_path / "agg_ins"
    write_table(frame(spark, 24), path=str(path))
    before = read(spark, path)
    held = read_parquet_table(spark, str(path), "agg_ins")
    with pytest.raises(Exception, match="killed"):
        write_table(failing(frame(spark, 48, "new")), path=str(path))
    assert read(spark, path) == before and len(before) == 24

    def killed(folder):
        frame(spark, 48, "new").where("Year = 2020").write.partitionBy(*schemas.PERIOD).parquet(folder)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        Versions(spark, str(path)).replace(killed)
    assert read(spark, path) == before
    # The killed load has left files, which no reader of the table sees and a later clean-up removes.
    left = [f for f in os.listdir(path) if f.startswith("version-")]
    assert len(left) == 2
    write_table(frame(spark, 5), path=str(path))
    assert len(read(spark, path)) == 5 and held.count() == 24
    assert len(os.listdir(path)) == 4  # pointers, old, new, and the left-over of less than a day
    assert len(Versions(spark, str(path)).clean(kept=1, grace=0)) == 2
    assert len(read(spark, path)) == 5 and len(os.listdir(path)) == 2


def test_a_load_that_is_killed_before_its_pointer_is_not_seen(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "t"))
    assert versions.current() is None and versions.folder() is None and versions.clean() == []

    def killed(folder):
        frame(spark, 3).write.parquet(folder)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        versions.replace(killed)
    assert versions.current() is None
    os.makedirs(tmp_path / "t" / POINTERS, exist_ok=True)
    (tmp_path / "t" / POINTERS / ".half").write_text('{"fol')
    assert versions.current() is None


def test_versions_in_turn_and_at_once(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "t"))

    def writer(n):
        def write(folder):
            os.makedirs(folder)
            return {"n": n}

        return write

    for n in range(4):
        assert versions.replace(writer(n)) == versions.folder() and versions.current()["n"] == n
    assert len(os.listdir(tmp_path / "t")) == 3
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda n: Versions(spark, str(tmp_path / "u"))._point({"folder": f"f{n}", "n": n}), range(24)))
    numbers = sorted(f for f in os.listdir(tmp_path / "u" / POINTERS) if not f.startswith("."))
    assert numbers == [f"{k:010d}" for k in range(1, 25)]
    assert {json.loads((tmp_path / "u" / POINTERS / f).read_text())["n"] for f in numbers} == set(range(24))


def test_a_plain_folder_is_read_and_taken_over(spark, tmp_path):
    path = str(tmp_path / "agg_ins")
    frame(spark, 9).write.partitionBy(*schemas.PERIOD).parquet(path)
    assert len(read(spark, path)) == 9
    write_table(frame(spark, 4), path=path)
    assert len(read(spark, path)) == 4
    assert sorted(f.split("-")[0] for f in os.listdir(path)) == [POINTERS, "version"]


def test_catalog_tables_stay_whole_too(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS kept")
    frame(spark, 2).write.mode("overwrite").saveAsTable("kept.agg_ins")  # one of before there were versions
    write_table(frame(spark, 24), table="kept.agg_ins")
    with pytest.raises(Exception, match="killed"):
        write_table(failing(frame(spark, 48)), table="kept.agg_ins")
    assert scan_table(spark, "agg_ins", "kept.agg_ins").count() == 24
    write_table(frame(spark, 6), table="kept.agg_ins")
    found = scan_table(spark, "agg_ins", "kept.agg_ins")
    assert found.schema.simpleString() == schemas.TABLES["agg_ins"].simpleString() and found.count() == 6
    pruned = found.filter("Year = 2020")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Year" in pruned
    spark.sql("DROP DATABASE kept CASCADE")


def test_counts_of_a_load_equal_those_of_a_scan(spark, star, tmp_path):
    model = star_model(spark, star)
    odd = model.table("map_ins").withColumn("District_name", F.when(F.col("Quarter") > 1, F.col("District_name")))
    frames = {"agg_ins": frame(spark, 40), "map_ins": odd, "top_user": model.table("top_user").limit(0)}
    load_tables(frames, root=str(tmp_path))
    paths = {name: f"{tmp_path}/{name}" for name in frames}
    stored = FactModel.from_parquet(spark, str(tmp_path))
    tables = {name: stored.table(name) for name in frames}

    def rows(df):
        return sorted(map(tuple, df.collect()))

    profile, size = stored_profile(spark, paths), stored_dimensions(spark, paths)
    assert profile.schema.simpleString() == quality.null_profiles(tables).schema.simpleString()
    assert rows(profile) == rows(quality.null_profiles(tables)) and any(r[2] for r in rows(profile))
    assert rows(size) == rows(quality.dimensions(tables))
    assert size.schema.simpleString() == quality.dimensions(tables).schema.simpleString()
    # No scan: the rows are those of the pointers.
    for df in (profile, size):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Relation" not in plan and "parquet" not in plan.lower()
    with pytest.raises(ValueError, match="absent"):
        stored_profile(spark, {"absent": f"{tmp_path}/absent"})
