"""Cleaning of the nine tables: narrow, shuffle-free column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.functions import canonical_pincode, title_case

# Which columns carry names to be put in title case.
TITLE_COLUMNS = {
    "agg_trans": ["State", "Transaction_type"],
    "agg_ins": ["State"],
    "agg_user": ["State"],
    "map_trans": ["State", "District_name"],
    "map_ins": ["State", "District_name"],
    "map_user": ["State", "District_name"],
    "top_trans": ["State"],
    "top_ins": ["State"],
    "top_user": ["State"],
}

# Spellings of one district.
DISTRICT_ALIASES = {"Nicobars District": "Nicobar District"}


def title_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: title_case(F.col(c)) for c in columns})


def standardise(df: DataFrame, column: str, aliases: Mapping[str, str]) -> DataFrame:
    """Replace whole values; anything not listed stays as it is."""
    return df.replace(dict(aliases), subset=[column])


def standardise_from(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """The same from a table (``alias``, ``name``) when the list is too long to write down.

    An alias may be repeated, but not with another name: that raises, for it would
    double rows. Spark broadcasts the table if its measured size allows, and joins
    by shuffle otherwise.
    """
    names = aliases.groupBy(F.col("alias").alias(column)).agg(
        F.min("name").alias("__low"), F.max("name").alias("__high")
    )
    clash = F.raise_error(F.concat(F.lit("alias with several names: "), F.col(column).cast("string")))
    lookup = names.select(
        column, F.when(F.col("__low").eqNullSafe(F.col("__high")), F.col("__low")).otherwise(clash).alias("__name")
    )
    return df.join(lookup, column, "left").select(
        *[F.coalesce("__name", c).alias(c) if c == column else F.col(c) for c in df.columns]
    )


def canonical_pincodes(df: DataFrame, column: str = "Pincode") -> DataFrame:
    return df.withColumn(column, canonical_pincode(F.col(column)))


def collated(df: DataFrame, columns: Sequence[str], collation: str = "UTF8_LCASE") -> DataFrame:
    """Compare, group and join these columns without regard to case.

    Names are compared byte by byte otherwise. Databases often ignore case, and
    then count ``COOLPAD`` and ``Coolpad`` as one brand.
    """
    return df.withColumns({c: F.collate(F.col(c), collation) for c in columns})


def clean_table(df: DataFrame, name: str) -> DataFrame:
    """All cleaning steps that apply to table ``name``."""
    cleaned = title_columns(df, TITLE_COLUMNS[name])
    if "District_name" in cleaned.columns:
        cleaned = standardise(cleaned, "District_name", DISTRICT_ALIASES)
    return cleaned
