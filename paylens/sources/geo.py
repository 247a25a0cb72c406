"""Map features: the names that a boundary file knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the property that holds a state's name.
NAME_PROPERTY = "ST_NM"

_SCHEMA = "features array<struct<properties: map<string, string>>>"


def parse_features(
    docs: DataFrame,
    key: str = "State",
    name_property: str = NAME_PROPERTY,
    mode: str = "FAILFAST",
) -> DataFrame:
    """Names in feature collections given as text in ``value``; geometry is never parsed.

    A text that is no JSON, or no feature collection, stops the read; with
    ``mode="PERMISSIVE"`` it has no features.
    """
    features = F.from_json("value", _SCHEMA, {"mode": mode})["features"]
    if mode.upper() == "FAILFAST":
        features = F.coalesce(features, F.raise_error(F.lit("a map file without features")))
    parsed = docs.select(F.explode(features).alias("feature"))
    return parsed.select(F.col("feature.properties")[name_property].alias(key))


def read_geo_features(
    spark: SparkSession, path: str, key: str = "State", name_property: str = NAME_PROPERTY
) -> DataFrame:
    docs = spark.read.text(path, wholetext=True)
    return parse_features(docs, key, name_property)
