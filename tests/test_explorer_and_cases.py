import pytest

from paylens.plans import explorer
from paylens.plans.cases import CASES, QUERIES, SHARED, CaseYears, run_case
from paylens.plans.model import FactModel
from paylens.sources.geo import read_geo_features
from paylens.sources.star_schema import star_model

MAP = "State string, Year int, Quarter int, District_name string, "


@pytest.fixture(scope="module")
def model(spark):
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    return FactModel.from_frames({
        "map_trans": frame(
            [
                ("s", 2023, 2, "x", 1, 1.0),
                ("s", 2024, 1, "x", 2, 3.0e7),
                ("s", 2024, 1, "y", 1, 1.5),
                ("t", 2024, 1, "x", 1, 5.0),
                ("t", 2024, 3, "x", 7, 7.0),
            ],
            MAP + "Transaction_count bigint, Transaction_amount double",
        ),
        "agg_trans": frame(
            [("s", 2024, 1, "p", 1, 10.4), ("t", 2024, 1, "q", 1, 9.0), ("t", 2024, 1, "q", 1, 9.6)],
            "State string, Year int, Quarter int, Transaction_type string, "
            "Transaction_count bigint, Transaction_amount double",
        ),
        "top_trans": frame(
            [("s", "600001.0", 2024, 1, 1, 2.0), ("t", "600001.0", 2024, 1, 1, 2.0),
             ("t", "600002", 2024, 1, 1, 3.0)],
            "State string, Pincode string, Year int, Quarter int, "
            "Transaction_count bigint, Transaction_amount double",
        ),
        "map_ins": frame(
            [("s", 2020, 2, None, None, None)],
            MAP + "Insurance_count bigint, Insurance_amount double",
        ),
        "top_ins": frame(
            [], "State string, Pincode string, Year int, Quarter int, "
            "Insurance_count bigint, Insurance_amount double",
        ),
        "map_user": frame(
            [("s", 2024, 4, "x", 7, 70), ("t", 2024, 4, "x", 8, 0)],
            MAP + "Registered_users bigint, Number_of_app_opens bigint",
        ),
    })


def test_defaults_are_the_last_year_and_the_first_quarter(model):
    assert explorer.default_selection(model, "transactions") == (2024, 1)
    assert explorer.default_selection(model, "users") == (2024, 4)


def test_domains(model, rows):
    assert rows(explorer.years(model, "transactions")) == [(2023,), (2024,)]
    assert rows(explorer.quarters(model, "transactions")) == [(1,), (2,), (3,)]


def test_transactions_have_every_report(model, rows):
    reports = explorer.explore(model, "transactions")
    assert set(reports) == {
        "kpis", "payment_categories", "top_districts", "top_pincodes", "state_metrics",
        "color_bounds",
    }
    assert rows(reports["kpis"]) == [(4, 30000006.5, 7500001.625, 3)]
    assert rows(reports["payment_categories"]) == [("q", 19), ("p", 10)]
    assert rows(reports["top_districts"]) == [("x", 30000005), ("y", 2)]
    assert rows(reports["top_pincodes"]) == [("600001", 4), ("600002", 3)]
    assert rows(reports["state_metrics"]) == [
        ("s", 30000001.5, 3, 7500000.75), ("t", 5.0, 1, 5.0),
    ]


def test_insurance_without_figures(model, rows):
    reports = explorer.explore(model, "insurance", 2020, 2)
    assert "payment_categories" not in reports
    assert rows(reports["kpis"]) == [(0, 0.0, 0.0, 0)]
    assert rows(reports["top_districts"]) == [(None, None)]
    assert rows(reports["top_pincodes"]) == []
    assert rows(reports["state_metrics"]) == [("s", None, None, None)]
    assert rows(reports["color_bounds"]) == [(None, None)]


def test_users_have_no_pincodes(model, rows):
    reports = explorer.explore(model, "users")
    assert set(reports) == {"kpis", "top_districts", "state_metrics", "color_bounds"}
    assert rows(reports["kpis"]) == [(15, 70)]
    assert rows(reports["top_districts"]) == [("x", 15)]
    with pytest.raises(ValueError):
        explorer.top_pincodes(model, "users", 2024, 4)


def test_equal_names_can_be_kept_apart(model, rows):
    apart = explorer.top_districts(model, "users", 2024, 4, qualify_by_state=True)
    assert rows(apart) == [("t", "x", 8), ("s", "x", 7)]
    apart = explorer.top_pincodes(model, "transactions", 2024, 1, qualify_by_state=True)
    assert [r[:2] for r in rows(apart)] == [("t", "600002"), ("s", "600001"), ("t", "600001")]


def test_map_features_from_a_file(spark, model, rows, tmp_path):
    path = tmp_path / "states.geojson"
    path.write_text("""{"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"ST_NM": "s", "cartodb_id": 3},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 1], [1.5, 2]]]}},
        {"type": "Feature", "properties": {"ST_NM": "z"}, "geometry": null}]}""")
    features = read_geo_features(spark, str(path))
    assert rows(features) == [("s",), ("z",)]
    reports = explorer.explore(model, "users", features=features)
    assert [(r.State, r.has_feature) for r in reports["geo_coverage"].collect()] == [
        ("s", True), ("t", False),
    ]
    assert rows(reports["geo_unmatched"]) == [("t", "features"), ("z", "metrics")]


def test_cases_cover_every_question_once():
    assert sorted(q for group in CASES.values() for q in group) == sorted(QUERIES)
    assert len(QUERIES) == 17 and set(SHARED) == set(CASES)


YEARS = CaseYears(base=1995, since=1996, window=(1997, 2001), span=(1995, 2001), target=2000)


@pytest.mark.parametrize("case", CASES)
def test_stored_tables_do_not_change_a_case(spark, star, case, tmp_path):
    direct = run_case(star_model(spark, star), case, YEARS)
    stored = run_case(star_model(spark, star), case, YEARS, store_at=str(tmp_path))
    assert list(direct) == list(stored) == CASES[case]
    for name in direct:
        assert direct[name].collect() == stored[name].collect()


def test_question_years_default_to_the_original_reports():
    years = CaseYears()
    assert (years.base, years.since, years.window, years.target) == (2018, 2019, (2020, 2024), 2024)


def test_a_partial_last_year_is_reported_as_it_is(spark, star, rows):
    years = CaseYears(base=1995, since=1996, window=(1997, 2001), span=(1995, 2001), target=2001)
    model = star_model(spark, star)
    trend = rows(QUERIES["declining_growth_trend"](model, years))
    assert {r[1] for r in trend} == {1998, 1999, 2000, 2001}
    # Three quarters against four: every one of the weakest states shrank.
    assert all(pct < 0 for _, year, pct in trend if year == 2001)
