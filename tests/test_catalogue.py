"""Every query with a SQL text agrees with it; every other one runs."""

import pytest

import __spark_entry__ as entry
from queries import load
from queries.compare import compare, connect

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES, SQL = load()


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tables, name):
    found = compare(spark, tables, QUERIES[name], SQL[name], SF)
    if found == "EMPTY":  # the smallest tables have no row that qualifies
        found = compare(spark, connect(LARGER), QUERIES[name], SQL[name], LARGER)
    assert found == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_texts_belong_to_queries():
    assert set(SQL) <= set(QUERIES)
