"""JSON documents that Spark derives from the star-schema tables.

One document per state and quarter for the tables whose lists are short by
nature (payment types, brands, districts). A quarter can hold any number of
pincodes, so there each stretch of 64 pincodes gets a document of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.plans.model import FactModel


def slug(name: Column) -> Column:
    return F.lower(F.translate(name, "_ ", "--"))


def _path() -> Column:
    return F.format_string("/drop/state/%s/%d/%d.json", slug(F.col("State")), "Year", "Quarter")


def _document(field: str, content: Column) -> Column:
    return F.to_json(F.struct(F.struct(content.alias(field)).alias("data"))).alias("value")


def _listed(df: DataFrame, field: str, item: Column) -> DataFrame:
    grouped = df.groupBy("State", "Year", "Quarter").agg(F.collect_list(item).alias("items"))
    return grouped.select(_path().alias("path"), _document(field, F.col("items")))


def _metric(label: str) -> Column:
    return F.struct(
        F.col(f"{label}_count").alias("count"), F.col(f"{label}_amount").alias("amount")
    )


def _instruments(df: DataFrame, label: str) -> DataFrame:
    item = F.struct(
        slug(F.col(f"{label}_type")).alias("name"),
        F.array(_metric(label), _metric(label)).alias("paymentInstruments"),
    )
    return _listed(df, "transactionData", item)


def _stretches(df: DataFrame, item: Column) -> DataFrame:
    stretch = F.floor(F.col("Pincode").cast("int") / 64)
    grouped = df.groupBy("State", "Year", "Quarter", stretch).agg(F.collect_list(item).alias("items"))
    return grouped.select(_path().alias("path"), _document("pincodes", F.col("items")))


def documents_of(model: FactModel, name: str) -> DataFrame:
    df = model.table(name)
    district = F.lower("District_name").alias("name") if name.startswith("map_") else None
    if name in ("agg_trans", "agg_ins"):
        return _instruments(df, "Transaction" if name == "agg_trans" else "Insurance")
    if name == "agg_user":
        item = F.struct(
            F.col("Brand_name").alias("brand"),
            F.col("User_count").alias("count"),
            F.col("Percentage_of_users").alias("percentage"),
        )
        return _listed(df, "usersByDevice", item)
    if name == "map_trans":
        item = F.struct(district, F.array(_metric("Transaction")).alias("metric"))
        return _listed(df, "hoverDataList", item)
    if name == "map_ins":
        # A district with a single policy reports no metric; a quarter with
        # payments but without insurance reports an empty list.
        metric = F.when(F.col("Insurance_count") > 1, F.array(_metric("Insurance")))
        item = F.struct(district, F.coalesce(metric, F.array()).alias("metric"))
        silent = (
            model.table("agg_trans")
            .select("State", "Year", "Quarter")
            .distinct()
            .join(model.table("agg_ins"), ["State", "Year", "Quarter"], "left_anti")
        )
        empty = silent.select(
            _path().alias("path"), F.lit('{"data": {"hoverDataList": []}}').alias("value")
        )
        return _listed(df, "hoverDataList", item).unionByName(empty)
    if name == "map_user":
        item = F.struct(
            F.lower("District_name").alias("name"),
            F.struct(
                F.col("Registered_users").alias("registeredUsers"),
                F.col("Number_of_app_opens").alias("appOpens"),
            ).alias("figures"),
        )
        grouped = df.groupBy("State", "Year", "Quarter").agg(
            F.map_from_entries(F.collect_list(item)).alias("items")
        )
        return grouped.select(_path().alias("path"), _document("hoverData", F.col("items")))
    if name == "top_user":
        item = F.struct(
            F.col("Pincode").alias("name"), F.col("Registered_users").alias("registeredUsers")
        )
        return _stretches(df, item)
    label = "Transaction" if name == "top_trans" else "Insurance"
    return _stretches(df, F.struct(F.col("Pincode").alias("entityName"), _metric(label).alias("metric")))


def feature_documents(nations: DataFrame, regions: DataFrame, left_out: int) -> DataFrame:
    """One feature collection per region: its nations and, as a stray, its own name.

    The region ``left_out`` has no nations on the map.
    """
    drawn = nations.filter(F.col("n_regionkey") != left_out).select(
        "n_regionkey", F.col("n_name").alias("name")
    )
    strays = regions.select(
        F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("name")
    )
    feature = F.struct(F.struct(F.col("name").alias("ST_NM")).alias("properties"))
    return (
        drawn.unionByName(strays)
        .groupBy("n_regionkey")
        .agg(F.collect_list(feature).alias("features"))
        .select(
            F.to_json(
                F.struct(F.lit("FeatureCollection").alias("type"), F.col("features"))
            ).alias("value")
        )
    )
