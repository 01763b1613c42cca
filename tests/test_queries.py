"""Every query with SQL gives what DuckDB gives; the others give rows."""

import pytest

import __spark_entry__ as entry
from lakelink.plans.queries import ORACLES, QUERIES
from tests.compare import connect, difference


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    assert difference(QUERIES[name](spark, sf), duck, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_rows(spark, sf, name):
    assert len(QUERIES[name](spark, sf).collect()) > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1 and set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
