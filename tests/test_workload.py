"""Every registered query against its SQL on the smallest scale."""

import pytest

import __spark_entry__ as driver
from csvharbor.workload import QUERIES
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, db, name):
    assert difference(spark, db, SF_DIR, name) is None


def test_driver_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    profile = driver.entry(spark)
    assert profile.columns == ["column_name", "sum", "avg", "min", "max", "count"] and profile.count() == 8
