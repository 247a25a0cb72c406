"""Data-quality reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_or_nan(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    floating = df.schema[name].dataType.typeName() in ("float", "double")
    return column.isNull() | F.isnan(column) if floating else column.isNull()


def null_profile(df: DataFrame, table: str) -> DataFrame:
    """Nulls per column from one pass over the table; NaN counts as null."""
    counts = df.agg(*[F.count_if(null_or_nan(df, c)).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "null_count").select(
        F.lit(table).alias("table_name"), "column_name", "null_count"
    )


def null_profiles(tables: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [null_profile(df, t) for t, df in tables.items()])


def dimensions(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table."""
    counted = [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(t).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count")
        )
        for t, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def preview(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)


def random_preview(
    df: DataFrame, n: int, seed: int | None = None, key: Sequence[str] | None = None
) -> DataFrame:
    """``n`` rows drawn at random without replacement.

    With a seed, the draw depends on it and on the key's values (all columns if
    none is named) only, not on partitions.
    """
    if seed is None:
        return df.orderBy(F.rand()).limit(n)
    columns = list(key or df.columns)
    texts = [F.col(c).cast("string") for c in columns]
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *texts)), *columns).limit(n)


def members(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose value is one of ``values``; used to check a correction."""
    return df.filter(F.col(column).isin(*values))
