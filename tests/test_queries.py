"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from check import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry_points.queries())
#: Screens that rightly find nothing on so little data.
MAY_BE_EMPTY = {"dq8_missing_dates", "dq9_missing_sessions"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, message = compare(spark, con, SF, name)
    assert ok or name in MAY_BE_EMPTY and message.startswith("0 vs 0 rows"), message


def test_flagship(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and "cagr_pct" in df.columns


def test_each_twin_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(NAMES)
