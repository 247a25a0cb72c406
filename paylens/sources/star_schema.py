"""The nine fact tables derived from an order-and-lineitem star schema.

States are nations; payments are orders of the customer's nation, insurance is
returned lineitems of the supplier's nation, devices are part brands and app
opens are the lineitems of an order.

Notes on scale. Fact rows are joined to dimensions by key with no hints: Spark
broadcasts a dimension only where its measured size is below the session's
threshold, and otherwise shuffles, with skewed keys split at run time. ``top_*``,
``agg_ins`` and the users' tables sum facts per join key *before* the join, so that
a customer, supplier or order holding a large part of all rows is folded to a few
rows inside each map task. ``agg_trans``, ``map_trans``, ``map_ins`` and ``agg_user``
join raw rows: folding first would add an exchange and reduce little. Money is summed as whole cents: exact in any order.
Dimension keys are unique, as in any star schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paylens import schemas
from paylens.plans.model import FactModel



# The columns used of each table. Declared, so that opening a table
# reads no file footers, and no more than these columns ever.
COLUMNS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_brand string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, "
    "l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz",
}


def read_star_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(COLUMNS[table]).parquet(f"{folder.rstrip('/')}/{table}.parquet")


def _cents(price: str) -> Column:
    return F.rint(F.col(price) * F.lit(100.0)).cast("bigint").alias("cents")


def _pincode(key: str) -> Column:
    return (F.col(key) + F.lit(100_000)).cast("string")


def _within(
    df: DataFrame, stamp: str, years: tuple[int, int] | None, quarter: int | None
) -> DataFrame:
    """Keep the wanted periods, as a range over the raw date where one exists.

    Parquet can skip row groups by a range of dates, not by ``year(date)``.
    """
    if years is None:
        return df if quarter is None else df.filter(F.quarter(stamp) == quarter)
    low, high = years
    start, end = f"{low:04d}-01-01 00:00:00", f"{high + 1:04d}-01-01 00:00:00"
    if quarter is not None and low == high:
        start = f"{low:04d}-{3 * quarter - 2:02d}-01 00:00:00"
        end = end if quarter == 4 else f"{low:04d}-{3 * quarter + 1:02d}-01 00:00:00"
    elif quarter is not None:
        df = df.filter(F.quarter(stamp) == quarter)
    return df.filter(
        (F.col(stamp) >= F.lit(start).cast("timestamp_ntz"))
        & (F.col(stamp) < F.lit(end).cast("timestamp_ntz"))
    )


class StarSchema:
    """Loader of the nine tables over Parquet files in one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark = spark
        self._folder = folder

    def _read(self, table: str) -> DataFrame:
        return read_star_table(self._spark, self._folder, table)

    def _customers(self) -> DataFrame:
        return self._read("customer").select("c_custkey", "c_nationkey", "c_mktsegment")

    def _suppliers(self) -> DataFrame:
        return self._read("supplier").select("s_suppkey", "s_nationkey")

    def _named(self, summed: DataFrame, nation_key: str) -> DataFrame:
        """Replace the nation's key by its name, on rows that are already summed."""
        nations = self._read("nation").select("n_nationkey", F.col("n_name").alias("State"))
        return summed.join(nations, F.col(nation_key) == F.col("n_nationkey"))

    def _orders(self, years, quarter, *columns) -> DataFrame:
        return _within(self._read("orders"), "o_orderdate", years, quarter).select(
            F.year("o_orderdate").alias("Year"), F.quarter("o_orderdate").alias("Quarter"), *columns
        )

    def _lines(self, years, quarter, *columns, returned: bool = False) -> DataFrame:
        lines = _within(self._read("lineitem"), "l_shipdate", years, quarter)
        if returned:
            lines = lines.filter(F.col("l_returnflag") == "R")
        return lines.select(
            F.year("l_shipdate").alias("Year"), F.quarter("l_shipdate").alias("Quarter"), *columns
        )

    # Payments: orders by the customer's state.

    def _payments(self, years, quarter, detail: str, label: str) -> DataFrame:
        orders = self._orders(years, quarter, "o_custkey", "o_orderpriority", _cents("o_totalprice"))
        summed = (
            orders.join(self._customers(), F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("c_nationkey", "Year", "Quarter", F.col(detail).alias(label))
            .agg(
                F.count("*").alias("Transaction_count"),
                (F.sum("cents") / F.lit(100.0)).alias("Transaction_amount"),
            )
        )
        return self._named(summed, "c_nationkey")

    def agg_trans(self, years, quarter) -> DataFrame:
        return self._payments(years, quarter, "o_orderpriority", "Transaction_type")

    def map_trans(self, years, quarter) -> DataFrame:
        return self._payments(years, quarter, "c_mktsegment", "District_name")

    def top_trans(self, years, quarter) -> DataFrame:
        per_customer = (
            self._orders(years, quarter, "o_custkey", _cents("o_totalprice"))
            .groupBy("o_custkey", "Year", "Quarter")
            .agg(
                F.count("*").alias("Transaction_count"),
                (F.sum("cents") / F.lit(100.0)).alias("Transaction_amount"),
            )
        )
        placed = per_customer.join(self._customers(), F.col("o_custkey") == F.col("c_custkey"))
        return self._named(placed, "c_nationkey").withColumn("Pincode", _pincode("c_custkey"))

    # Insurance: returned lineitems by the supplier's state.

    def _insured_per_supplier(self, years, quarter) -> DataFrame:
        per_supplier = (
            self._lines(years, quarter, "l_suppkey", _cents("l_extendedprice"), returned=True)
            .groupBy("l_suppkey", "Year", "Quarter")
            .agg(F.count("*").alias("Insurance_count"), F.sum("cents").alias("cents"))
        )
        return per_supplier.join(self._suppliers(), F.col("l_suppkey") == F.col("s_suppkey"))

    def agg_ins(self, years, quarter) -> DataFrame:
        summed = (
            self._insured_per_supplier(years, quarter)
            .groupBy("s_nationkey", "Year", "Quarter")
            .agg(
                F.sum("Insurance_count").alias("Insurance_count"),
                (F.sum("cents") / F.lit(100.0)).alias("Insurance_amount"),
            )
        )
        return self._named(summed, "s_nationkey").withColumn("Insurance_type", F.lit("Insurance"))

    def top_ins(self, years, quarter) -> DataFrame:
        return (
            self._named(self._insured_per_supplier(years, quarter), "s_nationkey")
            .withColumn("Pincode", _pincode("s_suppkey"))
            .withColumn("Insurance_amount", F.col("cents") / F.lit(100.0))
        )

    def _branded_lines(self, lines: DataFrame) -> DataFrame:
        parts = self._read("part").select("p_partkey", "p_brand")
        return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(
            self._suppliers(), F.col("l_suppkey") == F.col("s_suppkey")
        )

    def map_ins(self, years, quarter) -> DataFrame:
        lines = self._lines(
            years, quarter, "l_partkey", "l_suppkey", _cents("l_extendedprice"), returned=True
        )
        summed = (
            self._branded_lines(lines)
            .groupBy("s_nationkey", "Year", "Quarter", F.col("p_brand").alias("District_name"))
            .agg(
                F.count("*").alias("Insurance_count"),
                (F.sum("cents") / F.lit(100.0)).alias("Insurance_amount"),
            )
        )
        return self._named(summed, "s_nationkey")

    # Users.

    def agg_user(self, years, quarter) -> DataFrame:
        lines = self._lines(years, quarter, "l_partkey", "l_suppkey")
        counted = (
            self._branded_lines(lines)
            .groupBy("s_nationkey", "Year", "Quarter", F.col("p_brand").alias("Brand_name"))
            .agg(F.count("*").alias("User_count"))
        )
        # A state-quarter holds one row per brand by now. A plan that does not
        # ask for the share drops this window altogether.
        whole = F.sum("User_count").over(W.partitionBy("s_nationkey", "Year", "Quarter"))
        shares = counted.withColumn("Percentage_of_users", F.col("User_count") / whole)
        return self._named(shares, "s_nationkey")

    def _active_customers(self, years, quarter) -> DataFrame:
        """Per customer and quarter: orders with lineitems, and those lineitems."""
        opens = (
            self._read("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("opens"))
        )
        orders = self._orders(years, quarter, "o_orderkey", "o_custkey")
        per_customer = (
            orders.join(opens, F.col("o_orderkey") == F.col("l_orderkey"))
            .groupBy("o_custkey", "Year", "Quarter")
            .agg(F.count("*").alias("orders"), F.sum("opens").alias("opens"))
        )
        return per_customer.join(self._customers(), F.col("o_custkey") == F.col("c_custkey"))

    def map_user(self, years, quarter) -> DataFrame:
        # A customer has one nation and one segment, so rows per group are distinct customers.
        summed = (
            self._active_customers(years, quarter)
            .groupBy("c_nationkey", "Year", "Quarter", F.col("c_mktsegment").alias("District_name"))
            .agg(
                F.count("*").alias("Registered_users"),
                F.sum("opens").alias("Number_of_app_opens"),
            )
        )
        return self._named(summed, "c_nationkey")

    def top_user(self, years, quarter) -> DataFrame:
        placed = self._named(self._active_customers(years, quarter), "c_nationkey")
        return placed.withColumn("Pincode", _pincode("c_custkey")).withColumnRenamed(
            "orders", "Registered_users"
        )

    def table(
        self, name: str, years: tuple[int, int] | None = None, quarter: int | None = None
    ) -> DataFrame:
        return getattr(self, name)(years, quarter).select(*schemas.column_names(name))


def star_model(spark: SparkSession, folder: str) -> FactModel:
    return FactModel(StarSchema(spark, folder).table)
