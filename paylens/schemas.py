"""Explicit schemas of the nine fact tables and of the JSON documents behind them."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
}


def _struct(columns: str) -> T.StructType:
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


# Table and column names of the data model.
TABLES: dict[str, T.StructType] = {
    "agg_trans": _struct(
        "State string, Year int, Quarter int, Transaction_type string, "
        "Transaction_count bigint, Transaction_amount double"
    ),
    "agg_ins": _struct(
        "State string, Year int, Quarter int, Insurance_type string, "
        "Insurance_count bigint, Insurance_amount double"
    ),
    "agg_user": _struct(
        "State string, Year int, Quarter int, Brand_name string, "
        "User_count bigint, Percentage_of_users double"
    ),
    "map_trans": _struct(
        "State string, Year int, Quarter int, District_name string, "
        "Transaction_count bigint, Transaction_amount double"
    ),
    "map_ins": _struct(
        "State string, Year int, Quarter int, District_name string, "
        "Insurance_count bigint, Insurance_amount double"
    ),
    "map_user": _struct(
        "State string, Year int, Quarter int, District_name string, "
        "Registered_users bigint, Number_of_app_opens bigint"
    ),
    "top_trans": _struct(
        "State string, Pincode string, Year int, Quarter int, "
        "Transaction_count bigint, Transaction_amount double"
    ),
    "top_ins": _struct(
        "State string, Pincode string, Year int, Quarter int, "
        "Insurance_count bigint, Insurance_amount double"
    ),
    "top_user": _struct(
        "State string, Pincode string, Year int, Quarter int, Registered_users bigint"
    ),
}

# The part of each JSON document that carries facts.
DOCUMENTS: dict[str, str] = {
    "agg_trans": "data struct<transactionData: array<struct<name: string, "
    "paymentInstruments: array<struct<count: bigint, amount: double>>>>>",
    "agg_ins": "data struct<transactionData: array<struct<name: string, "
    "paymentInstruments: array<struct<count: bigint, amount: double>>>>>",
    "agg_user": "data struct<usersByDevice: array<struct<brand: string, "
    "count: bigint, percentage: double>>>",
    "map_trans": "data struct<hoverDataList: array<struct<name: string, "
    "metric: array<struct<count: bigint, amount: double>>>>>",
    "map_ins": "data struct<hoverDataList: array<struct<name: string, "
    "metric: array<struct<count: bigint, amount: double>>>>>",
    "map_user": "data struct<hoverData: map<string, struct<registeredUsers: bigint, appOpens: bigint>>>",
    "top_trans": "data struct<pincodes: array<struct<entityName: string, "
    "metric: struct<count: bigint, amount: double>>>>",
    "top_ins": "data struct<pincodes: array<struct<entityName: string, "
    "metric: struct<count: bigint, amount: double>>>>",
    "top_user": "data struct<pincodes: array<struct<name: string, registeredUsers: bigint>>>",
}

# Where each table's documents live below the root of a JSON drop.
DROP_PATHS: dict[str, str] = {
    "agg_trans": "aggregated/transaction/country/india/state",
    "agg_ins": "aggregated/insurance/country/india/state",
    "agg_user": "aggregated/user/country/india/state",
    "map_trans": "map/transaction/hover/country/india/state",
    "map_ins": "map/insurance/hover/country/india/state",
    "map_user": "map/user/hover/country/india/state",
    "top_trans": "top/transaction/country/india/state",
    "top_ins": "top/insurance/country/india/state",
    "top_user": "top/user/country/india/state",
}

PERIOD = ("Year", "Quarter")


def column_names(name: str) -> list[str]:
    return TABLES[name].fieldNames()


def natural_key(name: str) -> list[str]:
    """The columns whose values identify a row; nothing enforces them."""
    detail = [c for c in column_names(name) if c in
              ("Transaction_type", "Insurance_type", "Brand_name", "District_name", "Pincode")]
    return ["State", *PERIOD, *detail]
