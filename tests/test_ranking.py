from pyspark.sql import functions as F

from paylens.operators.cleaning import collated
from paylens.operators.ranking import (
    nested_topk_share,
    peak_period,
    period_extremes,
    range_topk,
    ratio_top_bottom,
    shuffled,
    top_bottom,
    topk_sum,
)


def test_top_k_breaks_ties_by_key(spark, rows):
    df = spark.createDataFrame([("c", 5), ("b", 5), ("a", 5), ("d", 9)], "k string, n bigint")
    assert rows(topk_sum(df, "k", "n", 2, name="t")) == [("d", 9), ("a", 5)]


def test_top_k_filters_first_and_rounds_last(spark, rows):
    df = spark.createDataFrame(
        [("a", 2023, 99.0), ("a", 2024, 1.234), ("b", 2024, 1.231), ("c", 2024, 0.5)],
        "k string, Year int, v double",
    )
    picked = topk_sum(df, "k", "v", 2, name="t", where=F.col("Year") == 2024, digits=2)
    assert rows(picked) == [("a", 1.23), ("b", 1.23)]
    assert rows(topk_sum(df, "k", "v", 3, name="t", whole=True))[0] == ("a", 100)


def test_equal_district_names_merge_unless_qualified(spark, rows):
    df = spark.createDataFrame(
        [("s", "x", 3), ("t", "x", 4), ("t", "y", 5)], "State string, District_name string, n bigint"
    )
    assert rows(topk_sum(df, "District_name", "n", 5, name="t")) == [("x", 7), ("y", 5)]
    assert rows(topk_sum(df, ["State", "District_name"], "n", 5, name="t")) == [
        ("t", "y", 5), ("t", "x", 4), ("s", "x", 3),
    ]


def test_top_bottom_keeps_ties_and_each_key_once(spark, rows):
    few = spark.createDataFrame([("a", 4), ("b", 3), ("c", 2), ("d", 1)], "k string, n bigint")
    assert rows(top_bottom(few, "k", "n", 3, name="t")) == [
        ("a", 4, "top"), ("b", 3, "top"), ("c", 2, "top"), ("d", 1, "bottom"),
    ]
    tied = spark.createDataFrame(
        [("a", 9), ("b", 9), ("c", 8), ("d", 5), ("e", 1), ("f", 1)], "k string, n bigint"
    )
    assert rows(top_bottom(tied, "k", "n", 1, name="t")) == [
        ("a", 9, "top"), ("b", 9, "top"), ("e", 1, "bottom"), ("f", 1, "bottom"),
    ]


def test_brands_differing_in_case_stay_apart_unless_collated(spark, rows):
    df = spark.createDataFrame([("COOLPAD", 2), ("Coolpad", 1)], "k string, n bigint")
    assert len(rows(top_bottom(df, "k", "n", 3, name="t"))) == 2
    merged = rows(top_bottom(collated(df, ["k"]), "k", "n", 3, name="t"))
    assert [(k.lower(), t, side) for k, t, side in merged] == [("coolpad", 3, "top")]


def test_ratio_top_bottom_repeats_keys_when_there_are_few(spark, rows):
    df = spark.createDataFrame(
        [("a", 10, 2), ("a", 20, 4), ("b", 9, 3), ("z", 1, 0)],
        "State string, opens bigint, users bigint",
    )
    result = rows(ratio_top_bottom(df, "State", "opens", "users", 3, name="rate"))
    assert result == [
        ("a", 5.0, "top"), ("a", 5.0, "bottom"), ("b", 3.0, "top"), ("b", 3.0, "bottom"),
        ("z", None, "top"), ("z", None, "bottom"),
    ]


def test_ratio_of_means_rounds_each_step(spark, rows):
    df = spark.createDataFrame(
        [("a", 1, 1), ("a", 1, 1), ("a", 2, 1)], "State string, opens bigint, users bigint"
    )
    # 4/3 rounds to 1.33 before the division.
    assert rows(ratio_top_bottom(df, "State", "opens", "users", 1, name="rate"))[0][1] == 1.33


def test_period_extremes_keep_ties_and_drop_the_base_year(spark, rows):
    df = spark.createDataFrame(
        [(2018, 1, 9, 1), (2019, 1, 6, 2), (2019, 2, 3, 1), (2019, 3, 2, 1), (2019, 4, 1, 1),
         (2020, 1, 5, 1)],
        "Year int, Quarter int, opens bigint, users bigint",
    )
    result = period_extremes(
        df, "Year", "Quarter", "opens", "users", name="rate", base_period=2018
    )
    assert rows(result) == [(2019, 4, 1.0), (2019, 1, 3.0), (2019, 2, 3.0), (2020, 1, 5.0)]


def test_peak_period_keeps_ties(spark, rows):
    df = spark.createDataFrame(
        [(2020, 1, 5.0), (2020, 2, 2.5), (2020, 2, 2.5), (2020, 3, 1.0)],
        "Year int, Quarter int, v double",
    )
    assert rows(peak_period(df, "Year", "Quarter", "v", name="t")) == [(2020, 1, 5.0), (2020, 2, 5.0)]


def test_value_range_of_the_original_reports(spark, rows):
    # Yearly insurance amounts, 2020 to 2024, and the printed ranges in crore.
    amounts = {
        "Karnataka": [44016512.0, 208485985.0, 583631283.0, 809752288.0, 1097268779.0],
        "Maharashtra": [53223687.0, 214476390.0, 510766718.0, 692728643.0, 891933098.0],
        "Uttar Pradesh": [20529652.0, 135461213.0, 354909247.0, 536625998.0, 692820385.0],
        "Tamil Nadu": [12326500.0, 93212401.0, 353009475.0, 476097802.0, 620861075.0],
        "Kerala": [7636102.0, 59233059.0, 313466314.0, 434334060.0, 499048972.0],
        "Rajasthan": [11326033.0, 59680794.0, 171684245.0, 281772935.0, 435189853.0],
    }
    data = [(s, 2020 + i, v) for s, series in amounts.items() for i, v in enumerate(series)]
    df = spark.createDataFrame(data, "State string, Year int, v double")
    assert rows(range_topk(df, "State", "Year", "v", 5, name="crore", scale=1e7)) == [
        ("Karnataka", 105.3252267),
        ("Maharashtra", 83.8709411),
        ("Uttar Pradesh", 67.2290733),
        ("Tamil Nadu", 60.8534575),
        ("Kerala", 49.141287),
    ]


def test_nested_share_ranks_by_one_measure_and_reports_another(spark, rows):
    df = spark.createDataFrame(
        [("s", "a", 50, 1), ("s", "b", 40, 7), ("s", "c", 1, 2),
         ("t", "d", 30, 5), ("t", "e", 20, 0),
         ("u", "f", 9, 900)],
        "State string, District_name string, users bigint, opens bigint",
    )
    result = nested_topk_share(
        df, "State", "District_name", rank_by="users", share_of="opens",
        k_outer=2, k_inner=2, total_name="t", share_name="p",
    )
    # Shares are of the whole state, not of the districts shown.
    assert rows(result) == [
        ("s", "a", 1, 10.0, 1), ("s", "b", 7, 70.0, 2), ("t", "d", 5, 100.0, 1), ("t", "e", 0, 0.0, 2),
    ]


def test_nested_share_of_nothing_is_null(spark, rows):
    df = spark.createDataFrame(
        [("s", "a", 5, 0)], "State string, District_name string, users bigint, opens bigint"
    )
    result = nested_topk_share(
        df, "State", "District_name", rank_by="users", share_of="opens",
        k_outer=3, k_inner=5, total_name="t", share_name="p",
    )
    assert rows(result) == [("s", "a", 0, None, 1)]


def test_shuffle_is_a_reproducible_permutation(spark, rows):
    df = spark.range(20).coalesce(1)
    once, again = rows(shuffled(df, 5)), rows(shuffled(df.repartition(3), 5))
    assert once == again != rows(df)
    assert sorted(once) == rows(df)
    assert rows(shuffled(df, 6)) != once


def test_top_bottom_of_missing_totals(spark, rows):
    df = spark.createDataFrame([("a", 2), ("b", None), ("c", None), ("d", 1)], "k string, n bigint")
    assert sorted(rows(top_bottom(df, "k", "n", 1, name="t"))) == [
        ("a", 2, "top"), ("b", None, "bottom"), ("c", None, "bottom"),
    ]
    assert sorted(rows(top_bottom(df.where("n is null"), "k", "n", 1, name="t"))) == [
        ("b", None, "top"), ("c", None, "top"),
    ]


def test_many_tied_keys_need_no_common_window(spark):
    df = spark.range(1000).selectExpr("cast(id as string) as k", "1 as n")
    result = top_bottom(df, "k", "n", 3, name="t")
    assert result.count() == 1000
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
