"""Writers: CSV, partitioned Parquet, catalog tables.

Parquet folders and catalog tables are kept in versions (``versions.py``): a
replace is seen whole or not at all, and its null counts are taken on the way.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Collection, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from paylens import schemas
from paylens.operators.quality import null_or_nan
from paylens.sinks.versions import KEPT, Versions


def write_csv(df: DataFrame, path: str) -> None:
    """Replace ``path`` by CSV files with a header line each."""
    df.write.mode("overwrite").option("header", True).csv(path)


def _missing(df: DataFrame) -> list[Column]:
    """Rows and nulls per column, as ``operators.quality.null_profile`` counts them."""
    return [F.count(F.lit(1)).alias("rows"), *(F.count_if(null_or_nan(df, c)).alias(f"null:{c}") for c in df.columns)]


def _filled(df: DataFrame, more: Mapping[str, Any] | None, as_it_lies: bool = False) -> Callable[[str], dict[str, Any]]:
    """Write a frame to a folder, partitioned by year and quarter, and tell what was written.

    The rebalance hint lets Spark merge small partitions and split a quarter that
    holds much of the data, so files come out at a sane size either way. Rows that
    lie by year and quarter already are not moved again. Rows and nulls are counted
    by the tasks that write.
    """

    def write(folder: str) -> dict[str, Any]:
        seen = Observation()
        placed = df if as_it_lies else df.hint("rebalance", *schemas.PERIOD)
        counted = placed.observe(seen, *_missing(df))
        counted.write.partitionBy(*schemas.PERIOD).parquet(folder)
        told = seen.get
        nulls = {c: told[f"null:{c}"] for c in df.columns}
        return {**(more or {}), "rows": told["rows"], "nulls": nulls}

    return write


def write_table(
    df: DataFrame, path: str | None = None, table: str | None = None, told: Mapping[str, Any] | None = None, as_it_lies: bool = False
) -> None:
    """Replace a Parquet folder or a catalog table, partitioned by year and quarter.

    The old version stays in use until the new one is complete. In the catalog, a
    table is a view of its current version, in a folder of its database. ``told`` is
    kept with the version. ``as_it_lies`` is for rows read from files by year and
    quarter: they are written by the tasks that read them.
    """
    if (path is None) == (table is None):
        raise ValueError("give either a path or a table name")
    spark = df.sparkSession
    if path is not None:
        Versions(spark, path).replace(_filled(df, told, as_it_lies))
        return
    database, _, name = table.rpartition(".")
    home = spark.catalog.getDatabase(database or spark.catalog.currentDatabase()).locationUri
    if spark.catalog.tableExists(table) and spark.catalog.getTable(table).tableType != "VIEW":
        # A table from before there were versions.
        spark.sql(f"DROP TABLE {_quoted(table)}")
    folder = Versions(spark, f"{home.rstrip('/')}/{name}.versions").replace(_filled(df, told, as_it_lies))
    columns = ", ".join(f"`{c}`" for c in df.columns)
    spark.sql(f"CREATE OR REPLACE VIEW {_quoted(table)} AS SELECT {columns} FROM parquet.`{folder}`")


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> str:
    """Replace a table of the catalog, cut into buckets by the hash of ``key`` and sorted by it; returns what holds the rows.

    Sums by the key, and joins on it with a table of as many buckets, then move
    no rows. One task reads a bucket, so this is for tables that hold a key once a
    state and period, however many payments it had. The table is a view of its
    current version, which is replaced when the new one is complete; the version
    before stays for readers that have begun.
    """
    spark = df.sparkSession
    database, _, name = table.rpartition(".")
    database = database or spark.catalog.currentDatabase()
    pattern = re.compile(rf"{re.escape(name.lower())}_bucketed_(\d{{6}})_[0-9a-f]{{8}}")
    found = ((pattern.fullmatch(t.name), t.name) for t in spark.catalog.listTables(database))
    known = sorted((int(match[1]), version) for match, version in found if match)
    number = known[-1][0] + 1 if known else 1
    version = f"{name.lower()}_bucketed_{number:06d}_{uuid.uuid4().hex[:8]}"
    holder = f"{database}.{version}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).saveAsTable(holder)
    columns = ", ".join(f"`{c}`" for c in df.columns)
    spark.sql(f"CREATE OR REPLACE VIEW {_quoted(f'{database}.{name}')} AS SELECT {columns} FROM {_quoted(holder)}")
    for _, old in known[: 1 - KEPT]:
        spark.sql(f"DROP TABLE IF EXISTS {_quoted(f'{database}.{old}')}")
    return holder


def _quoted(table: str) -> str:
    return ".".join(f"`{part}`" for part in table.split("."))


def stored_profile(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(table_name, column_name, null_count) of stored tables, as counted when they were written; nothing is scanned."""
    rows = [
        (table, column, n)
        for table, told in _told(spark, paths).items()
        for column, n in told["nulls"].items()
    ]
    return spark.createDataFrame(rows, "table_name string, column_name string, null_count bigint")


def stored_dimensions(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(table_name, row_count, column_count) of stored tables, as counted when they were written."""
    rows = [(table, told["rows"], len(told["nulls"])) for table, told in _told(spark, paths).items()]
    return spark.createDataFrame(rows, "table_name string, row_count bigint, column_count int")


def _told(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, dict[str, Any]]:
    found = {table: Versions(spark, path).current() for table, path in paths.items()}
    absent = sorted(table for table, told in found.items() if told is None)
    if absent:
        raise ValueError(f"not stored in versions: {absent}")
    return found


def load_tables(
    tables: Mapping[str, DataFrame],
    root: str | None = None,
    database: str | None = None,
    at_once: int = 4,
    report: bool = False,
    as_they_lie: Collection[str] = (),
) -> dict[str, str | None]:
    """Create or replace every table.

    ``as_they_lie`` names tables that are read from files by year and quarter.

    A table that fails does not keep the others from loading; then all errors are
    raised together, or returned by table if ``report`` is set (None: loaded). The writes do not
    depend on each other, so a few jobs are submitted together: one table's last
    tasks need not leave the cluster idle.
    """

    def load(name: str) -> str | None:
        try:
            if root is not None:
                write_table(tables[name], path=f"{root.rstrip('/')}/{name}", as_it_lies=name in as_they_lie)
            else:
                write_table(tables[name], table=f"{database}.{name}" if database else name, as_it_lies=name in as_they_lie)
        except Exception as error:
            return f"{type(error).__name__}: {error}"
        return None

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        errors = dict(zip(tables, pool.map(load, tables)))
    failed = {name: error for name, error in errors.items() if error}
    if failed and not report:
        raise RuntimeError(f"tables not stored: {failed}")
    return errors


def register_views(tables: Mapping[str, DataFrame], prefix: str = "") -> list[str]:
    """Make the tables known by name in the session; returns the names found there.

    A prefix keeps them apart from the session's own views.
    """
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
    session = next(iter(tables.values())).sparkSession
    known = {prefix + name for name in tables}
    return sorted(t.name for t in session.catalog.listTables() if t.name in known)
