"""Flat tables: CSV, Parquet and the catalog, always with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens import schemas
from paylens.sinks.versions import resolved


def _known(name: str) -> str:
    if name not in schemas.TABLES:
        raise ValueError(f"unknown table: {name}")
    return name


def read_csv_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table kept as CSV with a header line."""
    return (
        spark.read.schema(schemas.TABLES[_known(name)])
        .option("header", True)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_parquet_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table kept as Parquet, of its current version if it has versions; Year and Quarter prune when they are partitions."""
    frame = spark.read.schema(schemas.TABLES[_known(name)]).parquet(resolved(spark, path))
    return frame.select(*schemas.column_names(name))


def scan_table(spark: SparkSession, name: str, view: str | None = None) -> DataFrame:
    """A table or view of the session by its name, or table ``name`` under the name ``view``."""
    return spark.table(view or _known(name)).select(*schemas.column_names(_known(name)))


def slice_period(
    df: DataFrame, years: tuple[int, int] | None = None, quarter: int | None = None
) -> DataFrame:
    """Rows of an inclusive span of years and, if given, of one quarter."""
    if years is not None:
        low, high = years
        df = df.filter(F.col("Year") == low if low == high else F.col("Year").between(low, high))
    return df if quarter is None else df.filter(F.col("Quarter") == quarter)


def read_slice(
    spark: SparkSession, name: str, year: int, quarter: int, view: str | None = None
) -> DataFrame:
    """One quarter of a named table, its values bound as parameters."""
    return spark.sql(
        "SELECT * FROM {table} WHERE Year = :year AND Quarter = :quarter",
        args={"year": year, "quarter": quarter},
        table=scan_table(spark, name, view),
    )
