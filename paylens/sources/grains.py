"""The nine tables from a few stored grains of the star schema, instead of each from the facts.

A grain is a sum of facts by some dimensions and quarters. A table is taken from
the smallest stored grain of its family (payments, insured lines, active
customers) that has its dimensions. A coarse grain is summed from the finest of
its family where that has its dimensions, else from the facts. Both grains of
insured lines come from one pass, whose joins move each line once: loading all
nine scans lineitems twice and orders three times, not once or more for every table.

No grain has both a customer or supplier and another dimension of the facts
(priority, brand): such rows are as many as the facts, and would be shuffled,
sorted and stored for nothing. Where each customer has one row, rows of a
customer's grain are those of its tables and are not summed again.

Grains are stored in versions, by quarter. Where the input files are the same as
when they were stored, they are used as they are.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paylens import schemas
from paylens.plans.model import FactModel
from paylens.sinks.versions import Versions
from paylens.sinks.writers import write_table
from paylens.sources.inputs import fingerprint
from paylens.sources.star_schema import StarSchema, _cents, _pincode
from paylens.sources.tables import slice_period

#: Part of what stored grains are recognised by: another number whenever their content changes.
CONTENT = 2


@dataclass(frozen=True)
class Grain:
    family: str
    dimensions: frozenset[str]

    @property
    def name(self) -> str:
        return "-".join((self.family, *sorted(self.dimensions)))


@dataclass(frozen=True)
class Wanted:
    """What a table asks of its family: dimensions by the names of its columns, and measures and a condition in SQL."""

    family: str
    columns: dict[str, str]
    measures: dict[str, str]
    only: str = "true"


MEASURES = {"payments": ("n", "cents"), "insured": ("lines", "returned", "cents"), "actives": ("users", "orders", "opens")}

#: The finest grain of each family first.
GRAINS = [
    Grain("payments", frozenset({"customer", "nation", "segment"})),
    Grain("payments", frozenset({"nation", "segment", "priority"})),
    Grain("insured", frozenset({"supplier", "nation"})),
    Grain("insured", frozenset({"nation", "brand"})),
    Grain("actives", frozenset({"customer", "nation", "segment"})),
    Grain("actives", frozenset({"nation", "segment"})),
]

_PAID = {"Transaction_count": "n", "Transaction_amount": "cents / 100D"}
_INSURED = {"Insurance_count": "returned", "Insurance_amount": "cents / 100D"}
_RETURNED = "returned > 0"

WANTED = {
    "agg_trans": Wanted("payments", {"priority": "Transaction_type"}, _PAID),
    "map_trans": Wanted("payments", {"segment": "District_name"}, _PAID),
    "top_trans": Wanted("payments", {"customer": "Pincode"}, _PAID),
    "agg_ins": Wanted("insured", {}, _INSURED | {"Insurance_type": "'Insurance'"}, _RETURNED),
    "map_ins": Wanted("insured", {"brand": "District_name"}, _INSURED, _RETURNED),
    "top_ins": Wanted("insured", {"supplier": "Pincode"}, _INSURED, _RETURNED),
    "agg_user": Wanted("insured", {"brand": "Brand_name"}, {"User_count": "lines"}),
    "map_user": Wanted("actives", {"segment": "District_name"}, {"Registered_users": "users", "Number_of_app_opens": "opens"}),
    "top_user": Wanted("actives", {"customer": "Pincode"}, {"Registered_users": "orders"}),
}


def smallest(grains: dict[Grain, int], family: str, dimensions: frozenset[str]) -> Grain:
    """Of grains with their numbers of rows, the one with fewest that has the dimensions."""
    fitting = [g for g in grains if g.family == family and dimensions <= g.dimensions]
    if not fitting:
        raise ValueError(f"no grain of {family} has {sorted(dimensions)}")
    return min(fitting, key=lambda g: (grains[g], g.name))


class StarGrains:
    """Loader of the nine tables over grains stored below ``root``."""

    def __init__(self, spark: SparkSession, folder: str, root: str):
        self._spark, self._folder, self._root = spark, folder, root.rstrip("/")
        self._star = StarSchema(spark, folder)
        self._rows: dict[Grain, int] = {}
        self._single: dict[Grain, bool] = {}
        self._lines_summed: DataFrame | None = None

    def _versions(self, grain: Grain) -> Versions:
        return Versions(self._spark, f"{self._root}/{grain.name}")

    def finest(self, family: str) -> DataFrame:
        """The finest grain of a family, from the facts."""
        star = self._star
        if family == "payments":
            orders = star._orders(None, None, "o_custkey", _cents("o_totalprice"))
            # Folded before the join: a customer with a third of all orders is a few rows of each task.
            folded = orders.groupBy("o_custkey", "Year", "Quarter").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
            joined = folded.join(star._customers(), F.col("o_custkey") == F.col("c_custkey"))
            return joined.select(
                F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"),
                "Year", "Quarter", "n", "cents",
            )
        if family == "insured":
            return self._insured(self._summed_lines(), "supplier")
        return star._active_customers(None, None).select(
            F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"),
            "Year", "Quarter", F.lit(1).cast("bigint").alias("users"), "orders", "opens",
        )

    def _summed_lines(self) -> DataFrame:
        """Lines by supplier and lines by brand in one frame: they are joined once for both.

        A line goes to the joins with its quarter as one number, its flag as a boolean, and its amount only where that counts.
        """
        returned = F.col("l_returnflag") == "R"
        amount = F.when(returned, _cents("l_extendedprice")).alias("cents")
        lines = self._star._lines(None, None, "l_partkey", "l_suppkey", returned.alias("back"), amount)
        lines = lines.withColumn("period", 4 * F.col("Year") + F.col("Quarter") - 1).drop(*schemas.PERIOD)
        dimensions = ["s_suppkey", "s_nationkey", "p_brand", "period"]
        sets = [[d for d in dimensions if d != left_out] for left_out in ("p_brand", "s_suppkey")]
        return (
            self._star._branded_lines(lines)
            .groupingSets(sets, *dimensions)
            .agg(
                F.count("*").alias("lines"), F.count_if("back").alias("returned"), F.sum("cents").alias("cents"),
                F.grouping("s_suppkey").alias("by_brand"),
            )
        )

    def _insured(self, summed: DataFrame, by: str) -> DataFrame:
        """The grain by supplier or by brand of lines that were summed by both."""
        key = {"supplier": F.col("s_suppkey").alias("supplier"), "brand": F.col("p_brand").alias("brand")}[by]
        quarter = F.pmod("period", F.lit(4))
        rows = summed.where(F.col("by_brand") == int(by == "brand")).withColumns(
            {"Year": ((F.col("period") - quarter) / 4).cast("int"), "Quarter": quarter + 1}
        )
        return rows.select(key, F.col("s_nationkey").alias("nation"), "Year", "Quarter", *MEASURES["insured"])

    def _coarse(self, grain: Grain, finest: Grain) -> DataFrame:
        """A coarse grain, from the finest of its family if that has the dimensions, else from the facts."""
        if grain.dimensions <= finest.dimensions:
            return self._summed(self._read(finest), grain.dimensions, grain.family)
        orders = self._star._orders(None, None, "o_custkey", "o_orderpriority", _cents("o_totalprice"))
        return (
            orders.join(self._star._customers(), F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(
                F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"),
                "Year", "Quarter",
            )
            .agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
        )

    def _single_customers(self) -> bool:
        """Whether each customer has one row, so that its nation and segment are one."""
        keys = self._star._read("customer").where("c_custkey is not null").groupBy("c_custkey").count()
        return keys.where("count > 1").isEmpty()

    def store(self, families: Collection[str] | None = None) -> list[str]:
        """Store the grains (of some families) that are not there from the same input; returns the names of those that were written."""
        tables = [f"{self._folder.rstrip('/')}/{t}.parquet" for t in ("customer", "supplier", "part", "orders", "lineitem")]
        of_input = fingerprint(self._spark, tables, CONTENT)
        written = []
        try:
            for grain in GRAINS:
                if families is not None and grain.family not in families:
                    continue
                now = self._versions(grain).current()
                if now is None or now.get("input") != of_input:
                    single = "customer" in grain.dimensions and self._single_customers()
                    write_table(self._derived(grain), path=f"{self._root}/{grain.name}", told={"input": of_input, "single": single})
                    written.append(grain.name)
                    now = self._versions(grain).current()
                self._rows[grain], self._single[grain] = now["rows"], now["single"]
        finally:
            if self._lines_summed is not None:
                self._lines_summed.unpersist()
                self._lines_summed = None
        return written

    def _derived(self, grain: Grain) -> DataFrame:
        """The rows of a grain. Summed lines are kept from the first of their grains to the second."""
        if grain.family == "insured":
            if self._lines_summed is None:
                self._lines_summed = self._summed_lines().persist(StorageLevel.MEMORY_AND_DISK)
            return self._insured(self._lines_summed, "brand" if "brand" in grain.dimensions else "supplier")
        finest = next(g for g in GRAINS if g.family == grain.family)
        return self.finest(grain.family) if grain is finest else self._coarse(grain, finest)

    def _read(self, grain: Grain) -> DataFrame:
        return self._spark.read.parquet(self._versions(grain).folder())

    def _summed(self, rows: DataFrame, dimensions: frozenset[str], family: str) -> DataFrame:
        return rows.groupBy(*sorted(dimensions), *schemas.PERIOD).agg(*(F.sum(m).alias(m) for m in MEASURES[family]))

    def _holds(self, grain: Grain, dimensions: frozenset[str]) -> bool:
        """Whether the rows of a grain are those by the dimensions, and are not summed again."""
        return grain.dimensions == dimensions or (self._single[grain] and "customer" in dimensions)

    def placed(self) -> list[str]:
        """Tables whose rows are read from a stored grain by year and quarter, and not moved."""
        found = []
        for name, wanted in WANTED.items():
            dimensions = frozenset({"nation", *wanted.columns})
            # The shares of agg_user take a window.
            if name != "agg_user" and any(g.family == wanted.family for g in self._rows):
                if self._holds(smallest(self._rows, wanted.family, dimensions), dimensions):
                    found.append(name)
        return found

    def table(self, name: str, years: tuple[int, int] | None = None, quarter: int | None = None) -> DataFrame:
        wanted = WANTED[name]
        dimensions = frozenset({"nation", *wanted.columns})
        grain = smallest(self._rows, wanted.family, dimensions)
        rows = slice_period(self._read(grain), years, quarter)
        if not self._holds(grain, dimensions):
            rows = self._summed(rows, dimensions, wanted.family)
        rows = rows.where(wanted.only)
        for dimension, column in wanted.columns.items():
            rows = rows.withColumn(column, _pincode(dimension) if column == "Pincode" else F.col(dimension))
        rows = rows.withColumns({column: F.expr(measure) for column, measure in wanted.measures.items()})
        if name == "agg_user":
            # A row per brand is left of each state and quarter.
            whole = F.sum("User_count").over(W.partitionBy("nation", *schemas.PERIOD))
            rows = rows.withColumn("Percentage_of_users", F.col("User_count") / whole)
        return self._star._named(rows, "nation").select(*schemas.column_names(name))


def grained_model(spark: SparkSession, folder: str, root: str, families: Collection[str] | None = None) -> FactModel:
    """The nine tables, or those of some families, over stored grains, which are brought up to date first."""
    grains = StarGrains(spark, folder, root)
    grains.store(families)
    return FactModel(grains.table, grains.placed())
