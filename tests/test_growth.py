from paylens.operators.growth import (
    adjacent_period_delta,
    avg_growth_of_extremes,
    consistent_growth,
    declining_trend,
    growth,
    peak_period_spike,
)

YEARLY = "State string, Year int, n bigint"
QUARTERLY = "Year int, Quarter int, n bigint"


def test_growth_is_taken_before_the_base_year_goes(spark, rows):
    df = spark.createDataFrame(
        [(2018, 10, 1.0), (2019, 15, 1.5), (2019, 5, 0.5), (2020, 10, 2.0)],
        "Year int, n bigint, v double",
    )
    result = growth(df, "Year", {"n": "count", "v": "amount"}, base_period=2018)
    assert result.columns == ["Year", "count", "amount", "count_growth_pct", "amount_growth_pct"]
    assert rows(result) == [(2019, 20, 2.0, 100.0, 100.0), (2020, 10, 2.0, -50.0, 0.0)]


def test_growth_over_a_zero_year_is_null(spark, rows):
    df = spark.createDataFrame([(2018, 0), (2019, 5), (2020, 6)], "Year int, n bigint")
    assert rows(growth(df, "Year", {"n": "t"})) == [
        (2018, 0, None), (2019, 5, None), (2020, 6, (6 / 5 - 1.0) * 100.0),
    ]


def test_insurance_series_of_the_original_reports(spark, rows):
    # Yearly totals and the growth the original reports print.
    df = spark.createDataFrame(
        [
            (2020, 788258, 294207175.0),
            (2021, 1583282, 1499170038.0),
            (2022, 3090116, 4238843431.0),
            (2023, 3986187, 6056606058.0),
            (2024, 5067844, 7926751682.0),
        ],
        "Year int, n bigint, v double",
    )
    result = growth(df, "Year", {"n": "n", "v": "v"}, digits=2, require_previous=True)
    assert [(r[0], r[3], r[4]) for r in rows(result)] == [
        (2021, 100.86, 409.56),
        (2022, 95.17, 182.75),
        (2023, 29.0, 42.88),
        (2024, 27.14, 30.88),
    ]


def test_growth_undone_gives_the_input_back(spark, rows):
    totals = {2018: 40, 2019: 50, 2020: 75, 2021: 30}
    df = spark.createDataFrame(list(totals.items()), "Year int, n bigint")
    for year, total, pct in rows(growth(df, "Year", {"n": "t"}))[1:]:
        assert round(total / (1 + pct / 100)) == totals[year - 1]


def test_only_states_ever_extreme_are_averaged(spark, rows):
    # Growth per year: a 100, b 50, c 10, d -50; with k=1, b and c are never extreme.
    growths = {"a": 2.0, "b": 1.5, "c": 1.1, "d": 0.5}
    data = [
        (s, y, int(1000 * f ** (y - 2018))) for s, f in growths.items() for y in (2018, 2019, 2020)
    ]
    df = spark.createDataFrame(data, YEARLY)
    result = avg_growth_of_extremes(df, "State", "Year", "n", k=1, since=2019, n=5)
    assert rows(result) == [("a", 100.0), ("d", -50.0)]


def test_mean_growth_uses_rounded_years_and_skips_unknown_ones(spark, rows):
    df = spark.createDataFrame(
        [("a", 2018, 3), ("a", 2019, 4), ("a", 2020, 5), ("b", 2019, 0), ("b", 2020, 9)], YEARLY
    )
    result = avg_growth_of_extremes(df, "State", "Year", "n", k=3, since=2018, n=5)
    # 33.33 and 25.00, not the exact 33.333...; b has no growth over a zero year.
    assert rows(result) == [("a", 29.165)]


def test_an_unknown_mean_counts_as_zero(spark, rows):
    df = spark.createDataFrame([("a", 2018, 3), ("a", 2019, 4), ("b", 2018, 5)], YEARLY)
    result = avg_growth_of_extremes(df, "State", "Year", "n", k=3, since=2020, n=5)
    assert rows(result) == []
    df = spark.createDataFrame(
        [("a", 2018, 3), ("a", 2019, 4), ("a", 2020, 0), ("a", 2021, 6)], YEARLY
    )
    result = avg_growth_of_extremes(df, "State", "Year", "n", k=3, since=2021, n=5)
    assert rows(result) == [("a", 0.0)]


def test_lowest_growth_of_the_target_year_picks_the_series(spark, rows):
    df = spark.createDataFrame(
        [
            ("a", 2019, 1), ("a", 2020, 100), ("a", 2021, 200), ("a", 2022, 202),
            ("b", 2020, 100), ("b", 2021, 50), ("b", 2022, 60),
            ("c", 2022, 5),
        ],
        YEARLY,
    )
    result = declining_trend(df, "State", "Year", "n", window=(2020, 2022), target=2022, n=1)
    # b shrank in 2021, but a grew least in 2022; 2019 lies outside the window.
    assert rows(result) == [("a", 2021, 100.0), ("a", 2022, 1.0)]


def test_lag_pairs_with_the_previous_existing_year(spark, rows):
    df = spark.createDataFrame([("a", 2018, 10), ("a", 2020, 15)], YEARLY)
    trend = declining_trend(df, "State", "Year", "n", window=(2018, 2020), target=2020, n=5)
    assert rows(trend) == [("a", 2020, 50.0)]


def test_adjacent_delta_needs_both_years(spark, rows):
    df = spark.createDataFrame(
        [
            ("a", 2018, 10), ("a", 2020, 15),
            ("b", 2019, 4), ("b", 2020, 5), ("b", 2020, 2),
            ("c", 2019, 9),
            ("d", 2019, 2), ("d", 2020, 5),
        ],
        YEARLY,
    )
    result = adjacent_period_delta(df, "State", "Year", "n", target=2020, n=5)
    assert rows(result) == [("b", 3), ("d", 3)]


def test_adjacent_delta_by_several_keys(spark, rows):
    df = spark.createDataFrame(
        [("x", "p", 2019, 1), ("x", "p", 2020, 2), ("y", "p", 2019, 1), ("y", "p", 2020, 9)],
        "State string, Pincode string, Year int, n bigint",
    )
    merged = adjacent_period_delta(df, "Pincode", "Year", "n", target=2020, n=5)
    assert rows(merged) == [("p", 9)]
    apart = adjacent_period_delta(df, ["State", "Pincode"], "Year", "n", target=2020, n=5)
    assert rows(apart) == [("y", "p", 8), ("x", "p", 1)]


def test_spike_crosses_years_and_puts_unknown_last(spark, rows):
    df = spark.createDataFrame(
        [(2018, 1, 0), (2018, 2, 10), (2018, 3, 11), (2019, 1, 22), (2019, 2, 23), (2020, 1, 5)],
        QUARTERLY,
    )
    result = peak_period_spike(df, "Year", "Quarter", "n", window=(2018, 2019))
    # 2018: the first quarter has no predecessor and the second grew from zero.
    assert rows(result) == [(2018, 3, 11, 10, 10.0), (2019, 1, 22, 11, 100.0)]
    only_first = df.filter("Year = 2018 AND Quarter = 1")
    assert rows(peak_period_spike(only_first, "Year", "Quarter", "n", window=(2018, 2019))) == [
        (2018, 1, 0, None, None)
    ]


def test_consistent_growth_wants_both_means_positive(spark, rows):
    users = spark.createDataFrame(
        [("a", 2018, 10), ("a", 2019, 20), ("b", 2018, 10), ("b", 2019, 5),
         ("c", 2018, 10), ("c", 2019, 11), ("d", 2018, 1), ("d", 2019, 2)],
        YEARLY,
    )
    payments = spark.createDataFrame(
        [("a", 2018, 10), ("a", 2019, 11), ("b", 2018, 10), ("b", 2019, 50),
         ("c", 2018, 10), ("c", 2019, 30), ("d", 2018, 9), ("d", 2019, 9)],
        YEARLY,
    )
    result = consistent_growth(
        users, payments, "State", "Year", left_measure="n", right_measure="n",
        left_name="u", right_name="t", n=10,
    )
    assert rows(result) == [("c", 10.0, 200.0), ("a", 100.0, 10.0)]
