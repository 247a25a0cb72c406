"""All queries by name, each a function of the session and the folder of the tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.documents import documents_of, feature_documents
from paylens import schemas
from paylens.operators import cleaning, quality, ranking, rollup
from paylens.plans import cases, explorer
from paylens.plans.cases import CASES, QUERIES, CaseYears, run_case
from paylens.plans.load import export_csv
from paylens.plans.model import FactModel
from paylens.session import shared_folder
from paylens.sinks import load_tables, register_views, stored_dimensions, stored_profile, write_bucketed, write_csv, write_table
from paylens.sources import geo, tables
from paylens.sources.grains import grained_model
from paylens.sources.inputs import fingerprint
from paylens.sources.json_drops import PARSERS, documents
from paylens.sources.star_schema import COLUMNS, read_star_table, star_model

# The tables cover 1995 to 2001, the last year up to its third quarter.
YEARS = CaseYears(base=1995, since=1996, window=(1997, 2001), span=(1995, 2001), target=2000)
# The same, for the screening of whole years only.
WHOLE_YEARS = replace(YEARS, until=2000)
YEAR, QUARTER = 2000, 1
PAIR = ("NATION_3", "NATION_7")
LEFT_OUT_REGION = 4
BUCKETS = 16
# Fixed value: where Spark's partition folders tell state, year and quarter.
_PARTITION_KEYS = r"/state=([^/]+)/year=(\d+)/quarter=(\d+)/"
DISTRICT_RENAMES = {"MACHINERY": "BUILDING"}
CHECKED_DISTRICTS = ("BUILDING", "HOUSEHOLD")

Registered = Callable[[SparkSession, str], DataFrame]


def _case_query(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[name](star_model(spark, folder), YEARS)


def _consistent_growth_of_whole_years(spark: SparkSession, folder: str) -> DataFrame:
    return cases.consistent_growth(star_model(spark, folder), WHOLE_YEARS)


def _case_report(name: str, spark: SparkSession, folder: str) -> DataFrame:
    """All reports of a case in one plan, every measure of them, as long rows."""
    store_at = _scratch(spark, folder, f"case_{name}")
    reports = run_case(star_model(spark, folder), name, YEARS, store_at=store_at, of_input=_input(spark, folder))
    return reduce(DataFrame.unionByName, [_long(df, q) for q, df in reports.items()])


def _long(df: DataFrame, report: str) -> DataFrame:
    """(report, row_key, measure, value): the floating columns of a report by the text of the others.

    A report without floating columns has a measure ``row`` of 1.
    """
    measures = [c for c, t in df.dtypes if t == "double"]
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c, t in df.dtypes if t != "double"]
    keyed = df.select(F.concat_ws("|", *keys).alias("row_key"), *measures, F.lit(1.0).alias("row"))
    rows = keyed.unpivot(["row_key"], [*measures, "row"], "measure", "value")
    return rows.select(F.lit(report).alias("report"), "row_key", "measure", "value")


def _pct_difference(spark: SparkSession, folder: str) -> DataFrame:
    return cases.pct_difference_of_two(star_model(spark, folder), YEARS, *PAIR)


def _raw(model: FactModel, name: str) -> DataFrame:
    return PARSERS[name](documents_of(model, name))


def _read(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return _raw(star_model(spark, folder), name)


def _clean(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.clean_table(_raw(star_model(spark, folder), name), name)


def _scratch(spark: SparkSession, folder: str, name: str) -> str:
    """A shared folder for what a query stores: its own for each input, written over by a second call."""
    of_input = hashlib.sha256(folder.encode()).hexdigest()[:12]
    return f"{shared_folder(spark)}/paylens-{spark.sparkContext.applicationId}/{of_input}/{name}"


def _input(spark: SparkSession, folder: str) -> str:
    """What the stored tables of a folder are recognised by."""
    return fingerprint(spark, [f"{folder.rstrip('/')}/{table}.parquet" for table in COLUMNS])


def _grained(spark: SparkSession, folder: str, *families: str) -> FactModel:
    return grained_model(spark, folder, _scratch(spark, folder, "grains"), families or None)


def _sliced(spark: SparkSession, folder: str, dataset: str | None = None) -> FactModel:
    """The model for one quarter. Active customers come from their grain: from the facts, a quarter of them takes all lineitems."""
    return _grained(spark, folder, "actives") if dataset == "users" else star_model(spark, folder)


def _csv_table(spark: SparkSession, folder: str) -> DataFrame:
    path = _scratch(spark, folder, "csv_table")
    write_csv(star_model(spark, folder).table("agg_ins"), path)
    return tables.read_csv_table(spark, path, "agg_ins")


def _parquet_table(spark: SparkSession, folder: str) -> DataFrame:
    path = _scratch(spark, folder, "parquet_table")
    write_table(star_model(spark, folder).table("map_ins"), path=path)
    return tables.read_parquet_table(spark, path, "map_ins")


def _summed_up(model: FactModel, names: Sequence[str]) -> DataFrame:
    """(table_name, row_count, measure, total, keys): each measure's sum, and a check sum of the other columns."""
    parts = []
    for name in names:
        df = model.table(name)
        kinds = dict(df.dtypes)
        measures = [c for c in df.columns if c not in schemas.natural_key(name) and kinds[c] != "string"]
        keys = F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns if c not in measures])
        summed = df.agg(
            F.count("*").alias("row_count"),
            F.sum(F.conv(F.substring(F.md5(keys), 1, 8), 16, 10).cast("bigint")).alias("keys"),
            *[F.round(F.sum(F.col(c).cast("double")), 2).alias(c) for c in measures],
        )
        long = summed.unpivot(["row_count", "keys"], measures, "measure", "total")
        parts.append(long.select(F.lit(name).alias("table_name"), "row_count", "measure", "total", "keys"))
    return reduce(DataFrame.unionByName, parts)


def _stored_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Load all nine, find them by name and sum up what was stored."""
    root = _scratch(spark, folder, "stored_tables")
    model = _grained(spark, folder)
    load_tables(model.all_tables(), root=root, as_they_lie=model.placed)
    stored = FactModel.from_parquet(spark, root)
    prefix = "stored_tables_"
    listed = register_views(stored.all_tables(), prefix)
    seen = FactModel.of(lambda name: tables.scan_table(spark, name, prefix + name))
    summed = _summed_up(seen, [name.removeprefix(prefix) for name in listed])
    for name in listed:
        spark.catalog.dropTempView(name)
    return summed


def _exported_tables(spark: SparkSession, folder: str) -> DataFrame:
    """All nine as CSV and back."""
    root = _scratch(spark, folder, "exported_tables")
    export_csv(_grained(spark, folder), root)
    return _summed_up(FactModel.from_csv(spark, root), list(schemas.TABLES))


def _catalog_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables of the catalog, in a database of this session's and input's own."""
    session = spark.sparkContext.applicationId.replace("-", "_")
    database = f"paylens_{session}_{hashlib.sha256(folder.encode()).hexdigest()[:12]}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    model = _grained(spark, folder)
    load_tables(model.all_tables(), database=database, as_they_lie=model.placed)
    return _summed_up(FactModel.of(lambda name: tables.scan_table(spark, name, f"{database}.{name}")), list(schemas.TABLES))


def _loaded(report: Callable[..., DataFrame], spark: SparkSession, folder: str) -> DataFrame:
    """What a load of all nine has counted while it wrote them."""
    root = _scratch(spark, folder, f"loaded_{report.__name__}")
    model = _grained(spark, folder)
    load_tables(model.all_tables(), root=root, as_they_lie=model.placed)
    return report(spark, {name: f"{root}/{name}" for name in schemas.TABLES})


def _document_files(name: str, spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of a drop, one for each state and quarter, read back from there."""
    docs = documents_of(star_model(spark, folder), name)
    parts = docs.select(
        "value",
        F.regexp_extract("path", r"/([^/]+)/\d+/\d+\.json$", 1).alias("state"),
        F.regexp_extract("path", r"/(\d+)/\d+\.json$", 1).alias("year"),
        F.regexp_extract("path", r"/(\d+)\.json$", 1).alias("quarter"),
    )
    root = _scratch(spark, folder, f"files_{name}")
    parts.hint("rebalance", "state", "year", "quarter").write.mode("overwrite").partitionBy("state", "year", "quarter").text(root)
    found = documents(spark, root, file_filter="*.txt", key_pattern=_PARTITION_KEYS)
    return PARSERS[name](found)


def _explored(dataset: str, spark: SparkSession, folder: str) -> DataFrame:
    """Every report of the explorer's first view of a dataset, from stored tables, as long rows."""
    store_at = _scratch(spark, folder, f"explore_{dataset}")
    reports = explorer.explore(star_model(spark, folder), dataset, store_at=store_at, of_input=_input(spark, folder))
    reports.pop("color_bounds")  # a row without a key, compared on its own
    return reduce(DataFrame.unionByName, [_long(_rounded(df), r) for r, df in sorted(reports.items())])


def _rounded(df: DataFrame) -> DataFrame:
    """Means to a ten-thousandth: engines add quotients in different orders, so halves are lifted first."""
    if "average_value" not in df.columns:
        return df
    return df.withColumn("average_value", F.round(F.col("average_value") + 1e-7, 4))


def _read_table(spark: SparkSession, folder: str) -> DataFrame:
    view = "read_table_map_trans"
    star_model(spark, folder).table("map_trans").createOrReplaceTempView(view)
    found = tables.scan_table(spark, "map_trans", view)
    spark.catalog.dropTempView(view)
    return found


def _read_slice(spark: SparkSession, folder: str) -> DataFrame:
    view = "read_slice_map_trans"
    star_model(spark, folder).table("map_trans").createOrReplaceTempView(view)
    found = tables.read_slice(spark, "map_trans", YEAR, QUARTER, view)
    spark.catalog.dropTempView(view)
    return found


def _null_profile(spark: SparkSession, folder: str) -> DataFrame:
    model = _grained(spark, folder)
    frames = {**model.all_tables(), "map_ins": _raw(model, "map_ins")}
    return quality.null_profiles(frames)


def _table_dimensions(spark: SparkSession, folder: str) -> DataFrame:
    return quality.dimensions(_grained(spark, folder).all_tables())


def _standardised(spark: SparkSession, folder: str) -> DataFrame:
    rows = star_model(spark, folder).table("map_trans")
    return cleaning.standardise(rows, "District_name", DISTRICT_RENAMES)


def _standardised_from(spark: SparkSession, folder: str) -> DataFrame:
    """Aliases from a table: each nation by the name of its region."""
    nations = read_star_table(spark, folder, "nation")
    regions = read_star_table(spark, folder, "region")
    aliases = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("alias"), F.col("r_name").alias("name")
    )
    rows = star_model(spark, folder).table("agg_trans")
    return cleaning.standardise_from(rows, "State", aliases)


def _members(spark: SparkSession, folder: str) -> DataFrame:
    rows = star_model(spark, folder).table("map_trans")
    return quality.members(rows, "District_name", CHECKED_DISTRICTS)


def _preview(spark: SparkSession, folder: str) -> DataFrame:
    rows = star_model(spark, folder).table("map_trans")
    return quality.preview(rows, 5, schemas.natural_key("map_trans"))


def _random_preview(spark: SparkSession, folder: str) -> DataFrame:
    rows = star_model(spark, folder).table("map_trans")
    return quality.random_preview(rows, 5, seed=7, key=schemas.natural_key("map_trans"))


def _brands_in_any_case(spark: SparkSession, folder: str) -> DataFrame:
    """Brand names shouted in the states of even name length, and counted as one."""
    rows = star_model(spark, folder).table("agg_user")
    shouted = F.when(F.length("State") % 2 == 0, F.upper("Brand_name")).otherwise(
        F.col("Brand_name")
    )
    brands = cleaning.collated(rows.withColumn("Brand_name", shouted), ["Brand_name"])
    ranked = ranking.top_bottom(brands, "Brand_name", "User_count", 3, name="total_users")
    return ranked.withColumn("Brand_name", F.lower(F.col("Brand_name").cast("string")))


def _canonical_pincodes(spark: SparkSession, folder: str) -> DataFrame:
    rows = star_model(spark, folder).table("top_trans")
    decimal_text = rows.withColumn("Pincode", F.concat("Pincode", F.lit(".0")))
    return cleaning.canonical_pincodes(decimal_text)


def _explorer(report: Callable[..., DataFrame], *dataset: str) -> Registered:
    return lambda spark, folder: report(_sliced(spark, folder, *dataset), *dataset, YEAR, QUARTER)


def _domain(report: Callable[..., DataFrame], dataset: str) -> Registered:
    return lambda spark, folder: report(star_model(spark, folder), dataset)


def _state_metrics(dataset: str) -> Registered:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _rounded(explorer.state_metrics(_sliced(spark, folder, dataset), dataset, YEAR, QUARTER))

    return run


def _color_bounds(dataset: str) -> Registered:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        bounds = explorer.color_bounds(_sliced(spark, folder, dataset), dataset, YEAR, QUARTER)
        return bounds.select(F.round("vmin", 4).alias("vmin"), F.round("vmax", 4).alias("vmax"))

    return run


def _over_all(report: Callable[..., DataFrame], by: str) -> Registered:
    return lambda spark, folder: report(star_model(spark, folder), "transactions", by)


def _bucketed(spark: SparkSession, folder: str) -> DataFrame:
    """Yearly growth of pincodes over a stored table of buckets, in a database of this session's and input's own."""
    of_input = hashlib.sha256(f"{spark.sparkContext.applicationId} {folder}".encode()).hexdigest()[:12]
    database = f"paylens_buckets_{of_input}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    write_bucketed(star_model(spark, folder).table("top_ins"), f"{database}.top_ins", "Pincode", BUCKETS)
    model = FactModel.of(lambda name: tables.scan_table(spark, name, f"{database}.{name}"))
    return QUERIES["pincode_growth"](model, YEARS)


def _geo(report: Callable[..., DataFrame]) -> Registered:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        docs = feature_documents(
            read_star_table(spark, folder, "nation"),
            read_star_table(spark, folder, "region"),
            LEFT_OUT_REGION,
        )
        metrics = explorer.state_metrics(_sliced(spark, folder, "users"), "users", YEAR, QUARTER)
        return report(metrics, geo.parse_features(docs), "State")

    return run


def all_queries() -> dict[str, Registered]:
    registered: dict[str, Registered] = {}
    for name in QUERIES:
        registered[name] = partial(_case_query, name)
    registered["consistent_growth_of_whole_years"] = _consistent_growth_of_whole_years
    registered["pct_difference_of_two"] = _pct_difference
    for name in CASES:
        registered[f"case_{name}"] = partial(_case_report, name)

    registered["distinct_years"] = _domain(explorer.years, "transactions")
    registered["distinct_quarters"] = _domain(explorer.quarters, "transactions")
    registered["kpi_transactions"] = _explorer(explorer.kpis, "transactions")
    registered["kpi_insurance"] = _explorer(explorer.kpis, "insurance")
    registered["kpi_users"] = _explorer(explorer.kpis, "users")
    registered["payment_categories"] = _explorer(explorer.payment_categories)
    registered["top10_districts"] = _explorer(explorer.top_districts, "transactions")
    registered["top10_districts_insurance"] = _explorer(explorer.top_districts, "insurance")
    registered["top10_districts_users"] = _explorer(explorer.top_districts, "users")
    registered["top10_districts_by_state"] = _explorer(
        partial(explorer.top_districts, qualify_by_state=True), "transactions"
    )
    registered["top10_pincodes"] = _explorer(explorer.top_pincodes, "transactions")
    registered["top10_pincodes_insurance"] = _explorer(explorer.top_pincodes, "insurance")
    for dataset, short in (("transactions", "trans"), ("insurance", "ins"), ("users", "users")):
        registered[f"state_metrics_{short}"] = _state_metrics(dataset)
        registered[f"color_bounds_{short}"] = _color_bounds(dataset)
    for by in ("districts", "pincodes"):
        registered[f"value_bounds_{by}"] = _over_all(explorer.value_bounds, by)
        registered[f"places_of_{by}"] = _over_all(explorer.places, by)
    registered["bucketed_pincode_growth"] = _bucketed
    registered["geo_coverage"] = _geo(rollup.geo_coverage)
    registered["geo_unmatched"] = _geo(rollup.geo_unmatched)

    for name in schemas.TABLES:
        registered[f"read_{name}"] = partial(_read, name)
        registered[f"clean_{name}"] = partial(_clean, name)
    registered["read_csv_table"] = _csv_table
    registered["read_parquet_table"] = _parquet_table
    registered["read_table"] = _read_table
    registered["read_slice"] = _read_slice
    registered["stored_tables"] = _stored_tables
    registered["exported_tables"] = _exported_tables
    registered["catalog_tables"] = _catalog_tables
    registered["loaded_null_profile"] = partial(_loaded, stored_profile)
    registered["loaded_dimensions"] = partial(_loaded, stored_dimensions)
    # The documents by pincode come in several for a state and quarter, which is no drop's layout.
    for name in ("agg_trans", "agg_user", "map_ins", "map_user"):
        registered[f"document_files_{name}"] = partial(_document_files, name)
    for dataset in explorer.DATASETS:
        registered[f"explore_{dataset}"] = partial(_explored, dataset)
    registered["null_profile"] = _null_profile
    registered["table_dimensions"] = _table_dimensions
    registered["standardise_districts"] = _standardised
    registered["standardise_from_table"] = _standardised_from
    registered["membership_check"] = _members
    registered["preview"] = _preview
    registered["random_preview"] = _random_preview
    registered["brands_in_any_case"] = _brands_in_any_case
    registered["canonical_pincodes"] = _canonical_pincodes
    return registered
