"""The explorer: one dataset, one year, one quarter."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.operators import cleaning, ordered, ranking, rollup
from paylens.operators.common import totals
from paylens.plans.model import FactModel
from paylens.session import checkpointed


@dataclass(frozen=True)
class Dataset:
    """Which tables and columns a dataset is explored by."""

    map_table: str
    top_table: str | None
    category_table: str | None
    value: str
    count: str | None
    truncate_crore: bool = False


DATASETS = {
    "transactions": Dataset(
        "map_trans", "top_trans", "agg_trans", "Transaction_amount", "Transaction_count", True
    ),
    "insurance": Dataset("map_ins", "top_ins", None, "Insurance_amount", "Insurance_count"),
    "users": Dataset("map_user", None, None, "Registered_users", None),
}


def years(model: FactModel, dataset: str) -> DataFrame:
    return rollup.distinct_values(model.table(DATASETS[dataset].map_table), "Year")


def quarters(model: FactModel, dataset: str) -> DataFrame:
    return rollup.distinct_values(model.table(DATASETS[dataset].map_table), "Quarter")


def default_selection(model: FactModel, dataset: str) -> tuple[int, int]:
    """The last year and the first quarter on record."""
    bounds = model.table(DATASETS[dataset].map_table).agg(F.max("Year"), F.min("Quarter")).first()
    return bounds[0], bounds[1]


def kpis(model: FactModel, dataset: str, year: int, quarter: int) -> DataFrame:
    d = DATASETS[dataset]
    rows = model.table(d.map_table, years=(year, year), quarter=quarter)
    if d.count is None:
        return rollup.sum_kpis(
            rows,
            {"Registered_users": "registered_users", "Number_of_app_opens": "app_opens"},
        )
    return rollup.count_amount_kpis(rows, d.count, d.value, truncate_crore=d.truncate_crore)


def payment_categories(model: FactModel, year: int, quarter: int) -> DataFrame:
    d = DATASETS["transactions"]
    rows = model.table(d.category_table, years=(year, year), quarter=quarter)
    return rollup.category_totals(rows, "Transaction_type", d.value, name="total_value")


def top_districts(
    model: FactModel,
    dataset: str,
    year: int,
    quarter: int,
    *,
    n: int = 10,
    qualify_by_state: bool = False,
) -> DataFrame:
    """Largest districts; equal names in several states count as one unless qualified."""
    d = DATASETS[dataset]
    rows = model.table(d.map_table, years=(year, year), quarter=quarter)
    key = ["State", "District_name"] if qualify_by_state else ["District_name"]
    return ranking.topk_sum(rows, key, d.value, n, name="total_value", whole=True)


def top_pincodes(
    model: FactModel,
    dataset: str,
    year: int,
    quarter: int,
    *,
    n: int = 10,
    qualify_by_state: bool = False,
) -> DataFrame:
    d = DATASETS[dataset]
    if d.top_table is None:
        raise ValueError(f"dataset {dataset} has no table by pincode")
    rows = model.table(d.top_table, years=(year, year), quarter=quarter)
    key = ["State", "Pincode"] if qualify_by_state else ["Pincode"]
    best = ranking.topk_sum(rows, key, d.value, n, name="total_value", whole=True)
    return cleaning.canonical_pincodes(best)


def _key_totals(model: FactModel, dataset: str, by: str) -> tuple[DataFrame, str]:
    """Total value of each district or pincode over all periods, and the key's name."""
    d = DATASETS[dataset]
    table, key = {"districts": (d.map_table, "District_name"), "pincodes": (d.top_table, "Pincode")}[by]
    if table is None:
        raise ValueError(f"dataset {dataset} has no table by {by}")
    return totals(model.table(table), [key], {d.value: "total_value"}), key


def value_bounds(
    model: FactModel, dataset: str, by: str, shares: Sequence[float] = (0.05, 0.5, 0.95)
) -> DataFrame:
    """Ends of a scale over all districts or pincodes: (share, value)."""
    summed, _ = _key_totals(model, dataset, by)
    return rollup.value_bounds(summed, "total_value", shares)


def places(model: FactModel, dataset: str, by: str) -> DataFrame:
    """Every district or pincode with its rank by total value, and the value of the one before it.

    Equal totals share a rank; the one before is then that of the key before. No
    task sees all keys.
    """
    summed, key = _key_totals(model, dataset, by)
    order = [F.col("total_value").desc_nulls_last(), F.col(key).asc_nulls_first()]
    following = ordered.lagged(checkpointed(summed), order, {"total_value": "value_before"})
    return ordered.ranked(checkpointed(following), "total_value", "place")


def state_metrics(model: FactModel, dataset: str, year: int, quarter: int) -> DataFrame:
    return _state_metrics(model, dataset, year, quarter).orderBy("State")


def _state_metrics(model: FactModel, dataset: str, year: int, quarter: int) -> DataFrame:
    """The report before it is put in order."""
    d = DATASETS[dataset]
    rows = model.table(d.map_table, years=(year, year), quarter=quarter)
    if d.count is None:
        return rollup.state_metrics(rows, "State", ["Registered_users", "Number_of_app_opens"])
    return rollup.state_metrics(rows, "State", [d.value, d.count], mean_of=(d.value, d.count))


def color_bounds(model: FactModel, dataset: str, year: int, quarter: int) -> DataFrame:
    metrics = _state_metrics(model, dataset, year, quarter)
    return rollup.color_bounds(metrics, DATASETS[dataset].value)


def explore(
    model: FactModel,
    dataset: str,
    year: int | None = None,
    quarter: int | None = None,
    *,
    features: DataFrame | None = None,
    store_at: str | None = None,
    of_input: str | None = None,
) -> dict[str, DataFrame]:
    """Every report of one slice, lazily; ``features`` adds the map coverage.

    With ``store_at`` the dataset's tables are first written there, once, by year
    and quarter (with ``of_input`` only if they were not stored from the same input
    before); every report then reads one partition of them. Without a year
    or quarter, one small query finds the latest.
    """
    d = DATASETS[dataset]
    if store_at is not None:
        model = model.stored(store_at, *[t for t in (d.map_table, d.top_table, d.category_table) if t], of_input=of_input)
    if year is None or quarter is None:
        last_year, first_quarter = default_selection(model, dataset)
        year = last_year if year is None else year
        quarter = first_quarter if quarter is None else quarter
    reports = {
        "kpis": kpis(model, dataset, year, quarter),
        "top_districts": top_districts(model, dataset, year, quarter),
        "state_metrics": state_metrics(model, dataset, year, quarter),
        "color_bounds": color_bounds(model, dataset, year, quarter),
    }
    if d.category_table is not None:
        reports["payment_categories"] = payment_categories(model, year, quarter)
    if d.top_table is not None:
        reports["top_pincodes"] = top_pincodes(model, dataset, year, quarter)
    if features is not None:
        metrics = _state_metrics(model, dataset, year, quarter)
        reports["geo_coverage"] = rollup.geo_coverage(metrics, features, "State")
        reports["geo_unmatched"] = rollup.geo_unmatched(metrics, features, "State")
    return reports
