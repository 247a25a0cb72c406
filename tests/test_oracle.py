"""Every registered query against its SQL counterpart, value by value."""

import pytest

import __spark_entry__ as entry
from checks.compare import connect, differences
from checks.oracle import ORACLES
from checks.registry import all_queries
from tests.conftest import STAR

NAMES = sorted(all_queries())


@pytest.fixture(scope="module")
def duck():
    return connect(STAR)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, duck, name):
    assert differences(spark, duck, STAR, name) == []


def test_every_query_has_sql():
    assert set(NAMES) == set(ORACLES)
    assert set(NAMES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_flagship_query(spark):
    result = entry.entry(spark)
    assert result.columns == [
        "State", "District_name", "total_app_opens", "app_open_share_pct", "position",
    ]
    assert 0 < result.count() <= 15
