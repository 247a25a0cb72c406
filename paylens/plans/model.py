"""The nine-table model as the plans see it, whatever its storage."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from paylens import schemas
from paylens.operators.cleaning import clean_table
from paylens.sinks import write_table
from paylens.sinks.versions import Versions
from paylens.sources import json_drops, tables

Loader = Callable[[str, "tuple[int, int] | None", "int | None"], DataFrame]


class FactModel:
    """Tables by name, each optionally narrowed to a span of years and a quarter.

    The narrowing goes to the loader, which can turn it into partition pruning or
    a date range on its scan. ``placed`` names tables whose rows the loader reads
    from files by year and quarter, and does not move.
    """

    def __init__(self, loader: Loader, placed: Collection[str] = ()):
        self._loader, self.placed = loader, frozenset(placed)
        self._cached: dict[str, DataFrame] = {}

    def table(
        self, name: str, years: tuple[int, int] | None = None, quarter: int | None = None
    ) -> DataFrame:
        if name not in schemas.TABLES:
            raise ValueError(f"unknown table: {name}")
        if name in self._cached:
            return tables.slice_period(self._cached[name], years, quarter)
        return self._loader(name, years, quarter)

    def all_tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in schemas.TABLES}

    def cache(self, *names: str) -> FactModel:
        """Keep tables that several reports share; partitions that do not fit go to disk."""
        for name in names:
            if name not in self._cached:
                self._cached[name] = self.table(name).persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def stored(self, root: str, *names: str, of_input: str | None = None) -> FactModel:
        """Write tables once and go on from there; the rest stays as it is.

        Reports that share a table then read its rows instead of deriving them
        again, prune by year and quarter, and lose nothing with an executor.
        ``of_input`` tells the input (``sources.inputs.fingerprint``): a table that
        was stored from the same one is used as it is.
        """
        sessions = {}
        for name in names:
            df = self.table(name)
            sessions[name] = df.sparkSession
            path = f"{root.rstrip('/')}/{name}"
            now = Versions(df.sparkSession, path).current() if of_input is not None else None
            if now is None or now.get("input") != of_input:
                write_table(df, path=path, told=None if of_input is None else {"input": of_input})

        def load(name, years, quarter):
            if name not in sessions:
                return self.table(name, years, quarter)
            path = f"{root.rstrip('/')}/{name}"
            stored = tables.read_parquet_table(sessions[name], path, name)
            return tables.slice_period(stored, years, quarter)

        return FactModel(load)

    def uncache(self) -> None:
        for df in self._cached.values():
            df.unpersist()
        self._cached.clear()

    @classmethod
    def of(cls, read: Callable[[str], DataFrame]) -> FactModel:
        """A model over any reader of whole tables."""
        return cls(lambda name, years, quarter: tables.slice_period(read(name), years, quarter))

    @classmethod
    def from_frames(cls, frames: Mapping[str, DataFrame]) -> FactModel:
        return cls.of(frames.__getitem__)

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> FactModel:
        return cls.of(lambda n: tables.read_parquet_table(spark, f"{root.rstrip('/')}/{n}", n))

    @classmethod
    def from_csv(cls, spark: SparkSession, root: str) -> FactModel:
        return cls.of(lambda n: tables.read_csv_table(spark, f"{root.rstrip('/')}/{n}", n))

    @classmethod
    def from_catalog(cls, spark: SparkSession) -> FactModel:
        return cls.of(lambda n: tables.scan_table(spark, n))

    @classmethod
    def from_drop(cls, spark: SparkSession, drop_root: str) -> FactModel:
        """Cleaned tables straight from a JSON drop."""
        return cls.of(lambda n: clean_table(json_drops.read_drop_table(spark, drop_root, n), n))
