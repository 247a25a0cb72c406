"""The seventeen business questions and the five case reports that group them.

Each question is one lazy DataFrame over a ``FactModel``; years are parameters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.functions import canonical_pincode
from paylens.operators import growth, ranking, shares
from paylens.operators.rollup import CRORE
from paylens.plans.model import FactModel


@dataclass(frozen=True)
class CaseYears:
    """The years the questions refer to. Defaults are those of the original reports."""

    base: int = 2018
    """First year on record: no growth is known for it."""
    since: int = 2019
    """First year counted in mean growth."""
    window: tuple[int, int] = (2020, 2024)
    """Years of the trend and of the insurance series."""
    span: tuple[int, int] = (2018, 2024)
    """Years searched for quarterly spikes."""
    target: int = 2024
    """The year of single-year reports."""
    until: int | None = None
    """Last year of the consistent-growth screening, if it is to stop early."""


def yearly_growth_totals(model: FactModel, years: CaseYears) -> DataFrame:
    measures = {
        "Transaction_count": "total_transactions",
        "Transaction_amount": "transaction_amount",
    }
    return growth.growth(model.table("agg_trans"), "Year", measures, base_period=years.base)


def avg_yoy_growth_extremes(model: FactModel, years: CaseYears) -> DataFrame:
    return growth.avg_growth_of_extremes(
        model.table("agg_trans"), "State", "Year", "Transaction_count", k=3, since=years.since, n=5
    )


def declining_growth_trend(model: FactModel, years: CaseYears) -> DataFrame:
    return growth.declining_trend(
        model.table("agg_trans", years=years.window),
        "State",
        "Year",
        "Transaction_count",
        window=years.window,
        target=years.target,
        n=5,
    )


def peak_quarter_spike(model: FactModel, years: CaseYears) -> DataFrame:
    return growth.peak_period_spike(
        model.table("agg_trans", years=years.span),
        "Year",
        "Quarter",
        "Transaction_count",
        window=years.span,
    )


def avg_type_share(model: FactModel, years: CaseYears) -> DataFrame:
    return shares.avg_share(
        model.table("agg_trans"),
        "Year",
        "Transaction_type",
        "Transaction_amount",
        name="average_share_pct",
    )


def brand_top_bottom(model: FactModel, years: CaseYears) -> DataFrame:
    return ranking.top_bottom(
        model.table("agg_user"), "Brand_name", "User_count", 3, name="total_users"
    )


def engagement_top_bottom(model: FactModel, years: CaseYears) -> DataFrame:
    return ranking.ratio_top_bottom(
        model.table("map_user"),
        "State",
        "Number_of_app_opens",
        "Registered_users",
        3,
        name="engagement_rate",
    )


def quarterly_engagement_extremes(model: FactModel, years: CaseYears) -> DataFrame:
    return ranking.period_extremes(
        model.table("map_user"),
        "Year",
        "Quarter",
        "Number_of_app_opens",
        "Registered_users",
        name="engagement_rate",
        base_period=years.base,
    )


def insurance_yearly_growth(model: FactModel, years: CaseYears) -> DataFrame:
    return growth.growth(
        model.table("agg_ins", years=years.window),
        "Year",
        {"Insurance_count": "insurance_count", "Insurance_amount": "insurance_amount"},
        digits=2,
        require_previous=True,
    )


def insurance_value_range(model: FactModel, years: CaseYears) -> DataFrame:
    return ranking.range_topk(
        model.table("agg_ins"),
        "State",
        "Year",
        "Insurance_amount",
        5,
        name="insurance_value_crore",
        scale=CRORE,
    )


def insurance_penetration(model: FactModel, years: CaseYears) -> DataFrame:
    rated = shares.penetration(
        model.table("agg_trans"),
        model.table("agg_ins"),
        "State",
        base_count="Transaction_count",
        base_amount="Transaction_amount",
        part_count="Insurance_count",
        part_amount="Insurance_amount",
        n=5,
    )
    return rated.withColumnsRenamed(
        {
            "base_count": "total_transactions",
            "base_amount": "transaction_amount",
            "part_count": "total_insurances",
            "part_amount": "insurance_amount",
        }
    )


def consistent_growth(model: FactModel, years: CaseYears) -> DataFrame:
    span = None if years.until is None else (years.base, years.until)
    return growth.consistent_growth(
        model.table("map_user", years=span),
        model.table("agg_trans", years=span),
        "State",
        "Year",
        left_measure="Registered_users",
        right_measure="Transaction_count",
        left_name="avg_user_growth_pct",
        right_name="avg_txn_growth_pct",
        n=10,
    )


def district_share_top_states(model: FactModel, years: CaseYears) -> DataFrame:
    return ranking.nested_topk_share(
        model.table("map_user"),
        "State",
        "District_name",
        rank_by="Registered_users",
        share_of="Number_of_app_opens",
        k_outer=3,
        k_inner=5,
        total_name="total_app_opens",
        share_name="app_open_share_pct",
    )


def top_states_insurance(model: FactModel, years: CaseYears) -> DataFrame:
    return ranking.topk_sum(
        model.table("top_ins", years=(years.target, years.target)),
        "State",
        "Insurance_amount",
        3,
        name="total_insurance_amount",
        digits=2,
    )


def peak_quarter_value(model: FactModel, years: CaseYears) -> DataFrame:
    return ranking.peak_period(
        model.table("top_ins"), "Year", "Quarter", "Insurance_amount", name="total_insurance_amount"
    )


def top_districts_insurance(model: FactModel, years: CaseYears) -> DataFrame:
    return ranking.topk_sum(
        model.table("map_ins", years=(years.target, years.target)),
        "District_name",
        "Insurance_amount",
        5,
        name="total_insurance_amount",
    )


def pincode_growth(model: FactModel, years: CaseYears) -> DataFrame:
    rises = growth.adjacent_period_delta(
        model.table("top_ins", years=(years.target - 1, years.target)),
        "Pincode",
        "Year",
        "Insurance_count",
        target=years.target,
        n=5,
    )
    return rises.withColumn("Pincode", canonical_pincode(F.col("Pincode")))


def pct_difference_of_two(
    model: FactModel, years: CaseYears, first: str = "Karnataka", second: str = "Kerala"
) -> DataFrame:
    """How far one state's insurance range lies above another's."""
    ranges = ranking.spread_of_totals(
        model.table("agg_ins"),
        "State",
        "Year",
        "Insurance_amount",
        name="insurance_value_crore",
        scale=CRORE,
    )
    return shares.pct_difference(
        ranges, "State", first, second, "insurance_value_crore", name="pct_difference"
    )


Query = Callable[[FactModel, CaseYears], DataFrame]

QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        yearly_growth_totals,
        avg_yoy_growth_extremes,
        declining_growth_trend,
        peak_quarter_spike,
        avg_type_share,
        brand_top_bottom,
        engagement_top_bottom,
        quarterly_engagement_extremes,
        insurance_yearly_growth,
        insurance_value_range,
        insurance_penetration,
        consistent_growth,
        district_share_top_states,
        top_states_insurance,
        peak_quarter_value,
        top_districts_insurance,
        pincode_growth,
    )
}

CASES: dict[str, list[str]] = {
    "transaction_dynamics": [
        "yearly_growth_totals",
        "avg_yoy_growth_extremes",
        "declining_growth_trend",
        "peak_quarter_spike",
        "avg_type_share",
    ],
    "device_engagement": [
        "brand_top_bottom",
        "engagement_top_bottom",
        "quarterly_engagement_extremes",
    ],
    "insurance_penetration": [
        "insurance_yearly_growth",
        "insurance_value_range",
        "insurance_penetration",
    ],
    "user_growth": ["consistent_growth", "district_share_top_states"],
    "insurance_transactions": [
        "top_states_insurance",
        "peak_quarter_value",
        "top_districts_insurance",
        "pincode_growth",
    ],
}

# The tables that several questions of a case read.
SHARED: dict[str, list[str]] = {
    "transaction_dynamics": ["agg_trans"],
    "device_engagement": ["map_user"],
    "insurance_penetration": ["agg_ins"],
    "user_growth": ["map_user"],
    "insurance_transactions": ["top_ins"],
}


def run_case(
    model: FactModel,
    name: str,
    years: CaseYears | None = None,
    *,
    store_at: str | None = None,
    of_input: str | None = None,
) -> dict[str, DataFrame]:
    """All reports of one case.

    With ``store_at`` the tables they share are first written there, once; with
    ``of_input`` only if they were not stored from the same input before.
    """
    if store_at is not None:
        model = model.stored(store_at, *SHARED[name], of_input=of_input)
    return {q: QUERIES[q](model, years or CaseYears()) for q in CASES[name]}
