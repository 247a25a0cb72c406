"""Run queries on Spark and their SQL on DuckDB, and compare the results exactly.

    python -m checks.compare [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import ORACLES
from checks.registry import all_queries


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _value(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def _normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(row[i]) for i in order) for row in rows), key=repr)


_TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def differences(spark: SparkSession, connection, folder: str, name: str) -> list[str]:
    """What differs between the two results; empty if nothing does."""
    result = all_queries()[name](spark, folder)
    rows = [tuple(r) for r in result.collect()]
    if name not in ORACLES:
        return [] if rows else ["no rows"]
    answer = connection.sql(ORACLES[name])
    found = []
    ours = {c: _TYPES.get(t, t) for c, t in result.dtypes}
    theirs = dict(zip(answer.columns, map(str, answer.types)))
    if ours != theirs:
        found.append(f"schema {ours} <> {theirs}")
        if sorted(ours) != sorted(theirs):
            return found
    left, right = _normal(result.columns, rows), _normal(answer.columns, answer.fetchall())
    if len(left) != len(right):
        found.append(f"{len(left)} rows <> {len(right)} rows")
    unequal = [(a, b) for a, b in zip(left, right) if a != b]
    if unequal:
        found.append(f"{len(unequal)} rows differ, first {unequal[0]}")
    return found


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(all_queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    bad = 0
    for name in names:
        start = time.perf_counter()
        try:
            found = differences(spark, connection, folder, name)
        except Exception as error:
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(found)
        print(f"{'ok ' if not found else 'BAD'} {time.perf_counter() - start:6.2f}s {name}", *found, flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
