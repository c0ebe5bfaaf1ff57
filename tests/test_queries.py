"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as driver
from layerscan.plans.queries import QUERIES
from tests.compare import connect, differences


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(driver.queries()) & set(driver.oracle_sql())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    assert differences(driver.queries()[name](spark, sf_dir), db, driver.oracle_sql()[name]) == []


def test_flagship_query(spark):
    assert driver.entry(spark).count() == 14
