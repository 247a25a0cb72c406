"""Quarterly JSON drops, one document per state and quarter, as nine fact tables.

A drop is read as (path, value) rows, one row per document. The ``parse``
functions work on such rows wherever they come from, in batch or streaming, and
are narrow: executors read, parse and explode documents without a shuffle.

A document that is no JSON, is cut off or holds a value of another type stops
the read. With ``mode="PERMISSIVE"`` such documents yield no rows, or nulls;
``rejected_documents`` lists them. A document that lacks a list is no error,
except in the three pincode tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens import schemas

# Fixed value: the last three levels of a document's path.
_KEY_PATTERN = r"/([^/]+)/(\d{4})/(\d)\.json$"


def documents(
    spark: SparkSession, root: str, file_filter: str = "*.json", key_pattern: str | None = None
) -> DataFrame:
    """Every JSON document below ``root``, whole, with its path.

    Drops laid out otherwise give a filter of file names and a pattern whose
    three groups find state, year and quarter in a path.
    """
    texts = spark.read.text(
        root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=file_filter
    )
    path = F.col("_metadata.file_path")
    if key_pattern is not None:
        keys = [F.regexp_extract(path, key_pattern, i) for i in (1, 2, 3)]
        path = F.concat(F.lit("/"), F.concat_ws("/", *keys), F.lit(".json"))
    return texts.select(path.alias("path"), "value")


def period_keys(path: Column) -> list[Column]:
    """State, Year and Quarter from a document's path."""
    return [
        F.regexp_extract(path, _KEY_PATTERN, 1).alias("State"),
        F.regexp_extract(path, _KEY_PATTERN, 2).cast("int").alias("Year"),
        F.regexp_extract(path, _KEY_PATTERN, 3).cast("int").alias("Quarter"),
    ]


def _parsed(docs: DataFrame, name: str, mode: str) -> DataFrame:
    payload = F.from_json("value", schemas.DOCUMENTS[name], {"mode": mode})
    return docs.select("path", *period_keys(F.col("path")), payload.alias("doc"))


def _conformed(df: DataFrame, name: str) -> DataFrame:
    return df.select(
        *[F.col(f.name).cast(f.dataType) for f in schemas.TABLES[name].fields]
    )


def _first(array: str) -> Column:
    return F.get(F.col(array), F.lit(0))


def _instruments(docs: DataFrame, name: str, mode: str, label: str) -> DataFrame:
    """Categories with their first payment instrument; a document without any yields nothing."""
    rows = _parsed(docs, name, mode).select(
        "State", "Year", "Quarter", F.explode("doc.data.transactionData").alias("item")
    )
    first = _first("item.paymentInstruments")
    return rows.select(
        "State",
        "Year",
        "Quarter",
        F.col("item.name").alias(f"{label}_type"),
        first["count"].alias(f"{label}_count"),
        first["amount"].alias(f"{label}_amount"),
    )


def _hover_lists(docs: DataFrame, name: str, mode: str, label: str, keep_empty: bool) -> DataFrame:
    """Districts with their first metric; ``keep_empty`` gives an empty document one null row."""
    explode = F.explode_outer if keep_empty else F.explode
    rows = _parsed(docs, name, mode).select(
        "State", "Year", "Quarter", explode("doc.data.hoverDataList").alias("item")
    )
    first = _first("item.metric")
    return rows.select(
        "State",
        "Year",
        "Quarter",
        F.col("item.name").alias("District_name"),
        first["count"].alias(f"{label}_count"),
        first["amount"].alias(f"{label}_amount"),
    )


def _pincodes(docs: DataFrame, name: str, mode: str) -> DataFrame:
    """Listed pincodes; under FAILFAST a document without the list stops the read."""
    listed = F.col("doc.data.pincodes")
    if mode.upper() == "FAILFAST":
        listed = F.coalesce(listed, F.raise_error(F.concat(F.lit("no pincodes in "), "path")))
    return _parsed(docs, name, mode).select(
        "State", "Year", "Quarter", F.explode(listed).alias("item")
    )


def _top_metrics(docs: DataFrame, name: str, mode: str, label: str) -> DataFrame:
    return _pincodes(docs, name, mode).select(
        "State",
        F.col("item.entityName").alias("Pincode"),
        "Year",
        "Quarter",
        F.col("item.metric.count").alias(f"{label}_count"),
        F.col("item.metric.amount").alias(f"{label}_amount"),
    )


def parse_agg_trans(docs: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    return _conformed(_instruments(docs, "agg_trans", mode, "Transaction"), "agg_trans")


def parse_agg_ins(docs: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    return _conformed(_instruments(docs, "agg_ins", mode, "Insurance"), "agg_ins")


def parse_agg_user(docs: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    rows = _parsed(docs, "agg_user", mode).select(
        "State", "Year", "Quarter", F.explode("doc.data.usersByDevice").alias("item")
    )
    brands = rows.select(
        "State",
        "Year",
        "Quarter",
        F.col("item.brand").alias("Brand_name"),
        F.col("item.count").alias("User_count"),
        F.col("item.percentage").alias("Percentage_of_users"),
    )
    return _conformed(brands, "agg_user")


def parse_map_trans(docs: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    rows = _hover_lists(docs, "map_trans", mode, "Transaction", keep_empty=False)
    return _conformed(rows, "map_trans")


def parse_map_ins(docs: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    rows = _hover_lists(docs, "map_ins", mode, "Insurance", keep_empty=True)
    return _conformed(rows, "map_ins")


def parse_map_user(docs: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    rows = _parsed(docs, "map_user", mode).select(
        "State", "Year", "Quarter", F.explode("doc.data.hoverData").alias("District_name", "item")
    )
    users = rows.select(
        "State",
        "Year",
        "Quarter",
        "District_name",
        F.col("item.registeredUsers").alias("Registered_users"),
        F.col("item.appOpens").alias("Number_of_app_opens"),
    )
    return _conformed(users, "map_user")


def parse_top_trans(docs: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    return _conformed(_top_metrics(docs, "top_trans", mode, "Transaction"), "top_trans")


def parse_top_ins(docs: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    return _conformed(_top_metrics(docs, "top_ins", mode, "Insurance"), "top_ins")


def parse_top_user(docs: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    users = _pincodes(docs, "top_user", mode).select(
        "State",
        F.col("item.name").alias("Pincode"),
        "Year",
        "Quarter",
        F.col("item.registeredUsers").alias("Registered_users"),
    )
    return _conformed(users, "top_user")


PARSERS: dict[str, Callable[..., DataFrame]] = {
    "agg_trans": parse_agg_trans,
    "agg_ins": parse_agg_ins,
    "agg_user": parse_agg_user,
    "map_trans": parse_map_trans,
    "map_ins": parse_map_ins,
    "map_user": parse_map_user,
    "top_trans": parse_top_trans,
    "top_ins": parse_top_ins,
    "top_user": parse_top_user,
}


def rejected_documents(docs: DataFrame, name: str) -> DataFrame:
    """(path, value) of the documents of table ``name`` that stop a read, and a permissive one skips."""
    schema = f"{schemas.DOCUMENTS[name]}, __bad string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}
    parsed = docs.withColumn("__doc", F.from_json("value", schema, options))
    wrong = F.col("__doc.__bad").isNotNull() | F.col("__doc").isNull()
    if name.startswith("top_"):
        wrong = wrong | F.col("__doc.data.pincodes").isNull()
    return parsed.where(wrong).select("path", "value")


def table_root(drop_root: str, name: str) -> str:
    return f"{drop_root.rstrip('/')}/{schemas.DROP_PATHS[name]}"


def read_drop_table(
    spark: SparkSession, drop_root: str, name: str, mode: str | None = None
) -> DataFrame:
    """Raw table ``name`` of a drop laid out like the published repository."""
    docs = documents(spark, table_root(drop_root, name))
    return PARSERS[name](docs) if mode is None else PARSERS[name](docs, mode)
