"""From a JSON drop to cleaned, stored tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from paylens.plans.model import FactModel
from paylens.sinks import load_tables, write_csv


def load_drop(
    spark: SparkSession, drop_root: str, target_root: str, *, report: bool = False
) -> dict[str, str | None]:
    """Read, clean and store all nine tables as partitioned Parquet.

    All tables are tried. If any failed, that raises with each one's error, or
    with ``report`` they are returned.

    Run this once per drop: it also compacts one small file per state and
    quarter into few large ones.
    """
    tables = FactModel.from_drop(spark, drop_root).all_tables()
    return load_tables(tables, root=target_root, report=report)


def export_csv(model: FactModel, target_root: str) -> None:
    for name, df in model.all_tables().items():
        write_csv(df, f"{target_root.rstrip('/')}/{name}")
