"""Load only the documents that are new or revised since the last run.

A ledger names each loaded document by path, modification time and length. A
run lists the drop, takes what the ledger does not hold, however old, replaces
the rows of those states and quarters, and then adds to the ledger. A run that is
cut short before that is done again from the same listing; replacing twice
changes nothing. Documents that vanish keep their rows.

The listing is a table from beginning to end. The driver sees only the distinct
years and quarters of new documents; they prune the files that are read, and a
join with the listing takes the new ones of them.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens import schemas
from paylens.functions import title_case
from paylens.operators.cleaning import clean_table
from paylens.session import shared_folder
from paylens.sinks.versions import removed, resolved
from paylens.sources.json_drops import PARSERS, documents, period_keys, table_root

_LEDGER = "path string, modificationTime timestamp, length bigint"


def listed_documents(spark: SparkSession, root: str) -> DataFrame:
    """Path, modification time, length and URI of each document; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return files.option("pathGlobFilter", "*.json").load(root).select(
        "path", "modificationTime", "length", F.col("_metadata.file_path").alias("uri")
    )


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not be there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def load_new_documents(
    spark: SparkSession, drop_root: str, name: str, target_root: str, ledger_root: str
) -> int:
    """Bring one stored table up to date; returns how many documents were loaded."""
    target, ledger = (f"{root.rstrip('/')}/{name}" for root in (target_root, ledger_root))
    target = resolved(spark, target)
    known = _stored(spark, ledger, _LEDGER)
    # Written once, so that what is read and what the ledger gets are the same listing.
    listing = f"{shared_folder(spark)}/listings/{uuid.uuid4().hex}"
    listed_documents(spark, table_root(drop_root, name)).join(
        known, ["path", "modificationTime", "length"], "left_anti"
    ).write.parquet(listing)
    new = spark.read.schema(f"{_LEDGER}, uri string").parquet(listing)
    count = new.count()
    try:
        if count:
            _replace(spark, table_root(drop_root, name), name, new, target)
            new.select("path", "modificationTime", "length").write.mode("append").parquet(ledger)
    finally:
        removed(spark, listing)
    return count


def new_texts(spark: SparkSession, root: str, new: DataFrame) -> DataFrame:
    """(path, value) of the new documents. Files of years and quarters without any are never opened."""
    periods = new.select(*period_keys(F.col("uri"))).select(*schemas.PERIOD).distinct().collect()
    docs = documents(spark, root)
    state, year, quarter = period_keys(F.col("path"))
    of_period = [(year.eqNullSafe(p["Year"])) & (quarter.eqNullSafe(p["Quarter"])) for p in periods]
    chosen = docs.where(reduce(or_, of_period, F.lit(False)))
    return chosen.join(new.select(F.col("uri").alias("path")), "path", "left_semi")


def _replace(spark: SparkSession, root: str, name: str, new: DataFrame, target: str) -> None:
    """Take the new documents' rows in place of those of their states and quarters."""
    rows = clean_table(PARSERS[name](new_texts(spark, root, new)), name)
    keys = new.select(*period_keys(F.col("uri"))).withColumn("State", title_case(F.col("State"))).distinct()
    table = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.TABLES[name].fields)
    # Other states' rows of the quarters concerned stay; whole quarters are written anew.
    kept = (
        _stored(spark, target, table)
        .join(keys.select(*schemas.PERIOD).distinct(), list(schemas.PERIOD), "left_semi")
        .join(keys, ["State", *schemas.PERIOD], "left_anti")
    )
    columns = schemas.column_names(name)
    merged = kept.select(*columns).unionByName(rows.select(*columns))
    (
        merged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*schemas.PERIOD)
        .parquet(target)
    )
