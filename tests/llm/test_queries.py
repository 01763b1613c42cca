"""The corpus queries that have SQL give what DuckDB gives."""

import pytest

import __spark_entry__ as entry
from lakelink.llm.oracle import ORACLES
from tests.compare import connect, difference


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, name):
    assert difference(entry.queries()[name](spark, sf), connect(sf), entry.oracle_sql()[name]) == ""


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in entry.LLM_QUERIES} == {f"op{k}" for k in range(1, 11)} | {"pipeline"}
