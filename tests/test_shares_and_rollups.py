from paylens.operators.rollup import (
    category_totals,
    color_bounds,
    count_amount_kpis,
    distinct_values,
    geo_coverage,
    geo_unmatched,
    state_metrics,
    sum_kpis,
)
from paylens.operators.shares import avg_share, pct_difference, penetration

PAID = "State string, n bigint, v double"


def test_shares_are_averaged_over_years_without_weights(spark, rows):
    df = spark.createDataFrame(
        [(2018, "p", 1.0), (2018, "q", 3.0), (2019, "p", 100.0)], "Year int, kind string, v double"
    )
    # p: 25 % of a small year and 100 % of a large one; q is absent in 2019.
    assert rows(avg_share(df, "Year", "kind", "v", name="s")) == [("p", 62.5), ("q", 75.0)]


def test_shares_of_complete_years_add_up(spark, rows):
    df = spark.createDataFrame(
        [(y, k, float(y * i + 7)) for y in (1, 2, 3) for i, k in enumerate("abcd")],
        "Year int, kind string, v double",
    )
    assert abs(sum(s for _, s in rows(avg_share(df, "Year", "kind", "v", name="s"))) - 100) < 0.05


def test_a_year_without_any_amount_has_no_shares(spark, rows):
    df = spark.createDataFrame([(2018, "p", 0.0)], "Year int, kind string, v double")
    assert rows(avg_share(df, "Year", "kind", "v", name="s")) == [("p", None)]


def test_penetration_is_a_percentage_and_drops_unknown_states(spark, rows):
    base = spark.createDataFrame(
        [("a", 200, 10.0), ("b", 1000, 10.0), ("none", 5, 1.0), ("zero", 0, 0.0)], PAID
    )
    part = spark.createDataFrame(
        [("a", 1, 5.0), ("b", 1, 1.0), ("zero", 3, 1.0), ("elsewhere", 1, 1.0)], PAID
    )
    result = penetration(
        base, part, "State", base_count="n", base_amount="v", part_count="n", part_amount="v", n=5
    )
    assert rows(result) == [("b", 1000, 10.0, 1, 1.0, 0.1, 10.0), ("a", 200, 10.0, 1, 5.0, 0.5, 50.0)]


def test_difference_of_two_states(spark, rows):
    df = spark.createDataFrame([("a", 105.0), ("b", 50.0), ("c", 1.0)], "State string, v double")
    assert rows(pct_difference(df, "State", "a", "b", "v", name="d")) == [(110.0,)]
    assert rows(pct_difference(df, "State", "a", "missing", "v", name="d")) == [(None,)]


def test_kpis_of_an_empty_slice_are_zero(spark, rows):
    df = spark.createDataFrame([], PAID)
    assert rows(count_amount_kpis(df, "n", "v", truncate_crore=True)) == [(0, 0.0, 0.0, 0)]
    assert rows(sum_kpis(df, {"n": "users"})) == [(0,)]


def test_crore_is_truncated_or_rounded(spark, rows):
    df = spark.createDataFrame([("a", 4, 1.97e7)], PAID)
    assert rows(count_amount_kpis(df, "n", "v", truncate_crore=True)) == [(4, 1.97e7, 4925000.0, 1)]
    assert rows(count_amount_kpis(df, "n", "v", truncate_crore=False))[0][3] == 2
    half = spark.createDataFrame([("a", 4, 2.5e7)], PAID)
    assert rows(count_amount_kpis(half, "n", "v", truncate_crore=False))[0][3] == 2


def test_mean_of_quotients_is_not_the_quotient_of_totals(spark, rows):
    df = spark.createDataFrame([("s", 1, 10.0), ("s", 9, 18.0), ("s", 0, 5.0)], PAID)
    assert rows(state_metrics(df, "State", ["v", "n"], mean_of=("v", "n"))) == [("s", 33.0, 10, 6.0)]
    assert rows(count_amount_kpis(df, "n", "v", truncate_crore=True))[0][2] == 3.3


def test_categories_become_whole_numbers_largest_first(spark, rows):
    df = spark.createDataFrame([("a", 1.5), ("b", 0.6), ("b", 5.0)], "kind string, v double")
    assert rows(category_totals(df, "kind", "v", name="t")) == [("b", 6), ("a", 2)]


def test_color_bounds_interpolate(spark, rows):
    df = spark.createDataFrame([(4.0,), (5.0,), (10.0,), (20.0,), (50.0,)], "v double")
    low, high = rows(color_bounds(df, "v"))[0]
    assert abs(low - 4.2) < 1e-9 and abs(high - 44.0) < 1e-9


def test_distinct_values_are_sorted(spark, rows):
    df = spark.createDataFrame([(3,), (1,), (3,)], "Year int")
    assert rows(distinct_values(df, "Year")) == [(1,), (3,)]


def test_geo_coverage_reports_both_sides(spark, rows):
    metrics = spark.createDataFrame([("a", 1), ("b", 2)], "State string, n bigint")
    features = spark.createDataFrame([("a",), ("a",), ("z",)], "State string")
    assert rows(geo_coverage(metrics, features, "State")) == [("a", 1, True), ("b", 2, False)]
    assert rows(geo_unmatched(metrics, features, "State")) == [("b", "features"), ("z", "metrics")]
