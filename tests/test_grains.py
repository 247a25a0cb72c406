"""The nine tables from stored grains: equal to those from the facts, few scans, recognised input."""

import shutil

import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row

from paylens import schemas
from paylens.plans.cases import run_case
from paylens.plans.model import FactModel
from paylens.sinks import load_tables
from paylens.sinks.versions import Versions
from paylens.sources.grains import GRAINS, WANTED, Grain, StarGrains, grained_model, smallest
from paylens.sources.inputs import fingerprint
from paylens.sources.star_schema import COLUMNS, star_model


@pytest.fixture(scope="module")
def copy(tmp_path_factory):
    folder = tmp_path_factory.mktemp("star")
    for table in ("nation", "region", "customer", "supplier", "part", "orders", "lineitem"):
        shutil.copy(f"/root/testdata/sf0.001/{table}.parquet", folder)
    return str(folder)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_tables_equal_those_from_the_facts(spark, star, tmp_path):
    grained, plain = grained_model(spark, star, str(tmp_path)), star_model(spark, star)
    for name in schemas.TABLES:
        a, b = grained.table(name), plain.table(name)
        assert a.schema.simpleString() == b.schema.simpleString(), name
        assert rows(a) == rows(b), name
        assert rows(grained.table(name, (1997, 1999), 2)) == rows(plain.table(name, (1997, 1999), 2)), name
    pruned = str(grained.table("map_trans", (2000, 2000), 1)._jdf.queryExecution().executedPlan())
    assert "PartitionFilters: [isnotnull(Year" in pruned


def test_each_family_scans_its_facts_once(spark, star, tmp_path):
    grains = StarGrains(spark, star, str(tmp_path))
    told = {family: str(grains.finest(family)._jdf.queryExecution().executedPlan()) for family in ("payments", "insured", "actives")}

    def count(fact):
        return {family: plan.count(f"{fact}.parquet") for family, plan in told.items()}

    assert count("lineitem") == {"payments": 0, "insured": 1, "actives": 1}
    assert count("orders") == {"payments": 1, "insured": 0, "actives": 1}
    grains.store()
    for name in schemas.TABLES:
        plan = str(grains.table(name)._jdf.queryExecution().executedPlan())
        assert "lineitem.parquet" not in plan and "orders.parquet" not in plan and "customer.parquet" not in plan


def test_the_smallest_grain_that_covers_is_taken():
    fine, small = GRAINS[0], GRAINS[1]
    assert smallest({fine: 100, small: 10}, "payments", frozenset({"nation", "priority"})) == small
    assert smallest({fine: 100, small: 10}, "payments", frozenset({"nation", "customer"})) == fine
    assert smallest({fine: 5, small: 10}, "payments", frozenset({"nation"})) == fine
    with pytest.raises(ValueError, match="no grain"):
        smallest({fine: 5}, "payments", frozenset({"brand"}))
    assert all(any(frozenset({"nation", *w.columns}) <= g.dimensions for g in GRAINS if g.family == w.family) for w in WANTED.values())
    assert len({g.name for g in GRAINS}) == len(GRAINS) and Grain("a", frozenset("cb")).name == "a-b-c"


def test_same_input_is_used_again_and_a_changed_file_is_not(spark, copy, tmp_path):
    grains = StarGrains(spark, copy, str(tmp_path / "grains"))
    assert grains.store() == [g.name for g in GRAINS]
    assert StarGrains(spark, copy, str(tmp_path / "grains")).store() == []
    before = fingerprint(spark, [copy], 1)
    assert before == fingerprint(spark, [copy], 1) != fingerprint(spark, [copy], 2)
    orders = pq.read_table(f"{copy}/orders.parquet")
    pq.write_table(orders.slice(0, len(orders) // 2), f"{copy}/orders.parquet")
    spark.catalog.clearCache()
    spark.catalog.refreshByPath(copy)
    assert fingerprint(spark, [copy], 1) != before
    again = StarGrains(spark, copy, str(tmp_path / "grains"))
    assert again.store() == [g.name for g in GRAINS]
    assert rows(again.table("agg_trans")) == rows(star_model(spark, copy).table("agg_trans"))


def test_a_second_case_over_the_same_input_derives_nothing(spark, star, tmp_path):
    plain = star_model(spark, star)
    store, known = str(tmp_path), fingerprint(spark, [star])
    first = {q: rows(df) for q, df in run_case(plain, "insurance_transactions", store_at=store, of_input=known).items()}
    version = Versions(spark, f"{store}/top_ins").current()["folder"]
    second = run_case(plain, "insurance_transactions", store_at=store, of_input=known)
    assert {q: rows(df) for q, df in second.items()} == first
    assert Versions(spark, f"{store}/top_ins").current()["folder"] == version
    plan = str(second["pincode_growth"]._jdf.queryExecution().executedPlan())
    assert "lineitem.parquet" not in plan
    run_case(plain, "insurance_transactions", store_at=store, of_input="other")
    assert Versions(spark, f"{store}/top_ins").current()["folder"] != version


def test_users_of_a_quarter_read_one_partition(spark, star, tmp_path):
    model = grained_model(spark, star, str(tmp_path), ["actives"])
    plan = str(model.table("map_user", (2000, 2000), 1)._jdf.queryExecution().executedPlan())
    assert "lineitem" not in plan and "PartitionFilters: [isnotnull(Year" in plan
    with pytest.raises(ValueError, match="no grain"):
        model.table("agg_trans")


def small_star(spark, folder, customers):
    day = "timestamp_ntz'2000-02-03 00:00:00'"
    sql = {
        "nation": "SELECT 0 n_nationkey, 'N' n_name, 0 n_regionkey",
        "region": "SELECT 0 r_regionkey, 'R' r_name",
        "customer": f"SELECT * FROM VALUES {customers} t(c_custkey, c_nationkey, c_mktsegment)",
        "supplier": "SELECT 5L s_suppkey, 0 s_nationkey",
        "part": "SELECT * FROM VALUES (7L, 'x'), (8L, 'y') t(p_partkey, p_brand)",
        "orders": f"SELECT id o_orderkey, 1 + id % 2 o_custkey, 1D o_totalprice, {day} o_orderdate, string(id % 3) o_orderpriority FROM range(12)",
        "lineitem": f"SELECT id % 12 l_orderkey, 7 + id % 2 l_partkey, 5L l_suppkey, 1D l_extendedprice, 'R' l_returnflag, {day} l_shipdate FROM range(24)",
    }
    for table in COLUMNS:
        spark.sql(sql[table]).write.parquet(f"{folder}/{table}.parquet")
    grains = StarGrains(spark, str(folder), f"{folder}/grains")
    grains.store()
    return grains


def test_no_grain_is_as_fine_as_the_facts(spark, tmp_path):
    grains = small_star(spark, tmp_path, "(1L, 0, 'A'), (2L, 0, 'B')")
    for grain in GRAINS:
        assert len(grain.dimensions & {"customer", "supplier", "priority", "brand"}) < 2, grain.name
    # 12 orders of 2 customers, 24 lines of one supplier, all of one quarter.
    assert [grains._rows[g] for g in GRAINS if g.dimensions & {"customer", "supplier"}] == [2, 1, 2]


def test_rows_of_customers_are_summed_again_only_where_a_customer_repeats(spark, tmp_path):
    def top(folder, customers):
        grains = small_star(spark, folder, customers)
        tables = {name: grains.table(name) for name in ("top_trans", "top_user")}
        plans = [str(df._jdf.queryExecution().executedPlan()) for df in tables.values()]
        counts = [sorted((r.Pincode, r[c]) for r in tables[t].collect()) for t, c in (("top_trans", "Transaction_count"), ("top_user", "Registered_users"))]
        return counts, ["hashpartitioning" in p for p in plans]

    assert top(tmp_path / "once", "(1L, 0, 'A'), (2L, 0, 'B')") == ([[("100001", 6), ("100002", 6)]] * 2, [False, False])
    assert top(tmp_path / "twice", "(1L, 0, 'A'), (1L, 0, 'B'), (2L, 0, 'B')") == ([[("100001", 12), ("100002", 6)]] * 2, [True, True])


def test_insured_lines_are_joined_once_for_both_grains(spark, star, tmp_path):
    grains = StarGrains(spark, star, str(tmp_path))
    taken, summed = [], grains._summed_lines
    grains._summed_lines = lambda: taken.append(summed()) or taken[-1]
    grains.store()
    assert len(taken) == 1 and not taken[0].is_cached and grains._lines_summed is None
    plan = str(taken[0]._jdf.queryExecution().executedPlan())
    assert plan.count("lineitem.parquet") == plan.count("part.parquet") == 1
    # What a line carries into the joins: no text, and one number for its quarter.
    assert " AS back#" in plan and " AS period#" in plan and " AS Year#" not in plan


def test_lines_without_date_flag_or_price_and_before_the_common_era(spark, tmp_path):
    small_star(spark, tmp_path / "at", "(1L, 0, 'A')")
    spark.sql(
        "SELECT * FROM VALUES (1L, 7L, 5L, 1.5D, 'R', timestamp_ntz'2000-12-31 23:00:00'), (1L, 8L, 5L, 2D, null, timestamp_ntz'2000-10-01 00:00:00'),"
        " (1L, 7L, 5L, null, 'R', null), (1L, 7L, 5L, 4D, 'A', null), (1L, null, 5L, 8D, 'R', null), (1L, 7L, 5L, 0.5D, 'R', timestamp_ntz'0001-01-01 00:00:00')"
        " t(l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_shipdate)"
    ).write.mode("overwrite").parquet(f"{tmp_path}/at/lineitem.parquet")
    grains = StarGrains(spark, f"{tmp_path}/at", f"{tmp_path}/again")
    grains.store(["insured"])
    by = {next(iter(g.dimensions - {"nation"})): grains._read(g) for g in GRAINS if g.family == "insured"}
    columns = ["Year", "Quarter", "lines", "returned", "cents"]
    assert rows(by["supplier"].select("supplier", *columns)) == sorted(map(repr, [
        Row(supplier=5, Year=2000, Quarter=4, lines=2, returned=1, cents=150), Row(supplier=5, Year=None, Quarter=None, lines=2, returned=1, cents=None),
        Row(supplier=5, Year=1, Quarter=1, lines=1, returned=1, cents=50),
    ]))
    assert rows(by["brand"].select("brand", *columns)) == sorted(map(repr, [
        Row(brand="x", Year=2000, Quarter=4, lines=1, returned=1, cents=150), Row(brand="y", Year=2000, Quarter=4, lines=1, returned=0, cents=None),
        Row(brand="x", Year=None, Quarter=None, lines=2, returned=1, cents=None), Row(brand="x", Year=1, Quarter=1, lines=1, returned=1, cents=50),
    ]))


def test_rows_of_a_grain_are_loaded_as_they_lie(spark, star, tmp_path):
    model = grained_model(spark, star, str(tmp_path / "grains"))
    assert {"top_trans", "top_ins", "top_user"} <= model.placed and "agg_user" not in model.placed and "agg_ins" not in model.placed
    for name in model.placed:
        assert "hashpartitioning" not in str(model.table(name)._jdf.queryExecution().executedPlan()), name
    load_tables(model.all_tables(), root=str(tmp_path / "loaded"), as_they_lie=model.placed)
    stored, plain = FactModel.from_parquet(spark, str(tmp_path / "loaded")), star_model(spark, star)
    for name in schemas.TABLES:
        assert rows(stored.table(name)) == rows(plain.table(name)), name
    moved, lies = ("".join(str(df._jdf.queryExecution().executedPlan())) for df in (model.table("top_ins").hint("rebalance", *schemas.PERIOD), model.table("top_ins")))
    assert "hashpartitioning" in moved and "hashpartitioning" not in lies
