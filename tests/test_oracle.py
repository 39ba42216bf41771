"""Every registered query with SQL, value by value against DuckDB; the others must return rows."""

import pytest
from oracle_compare import difference, duck

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert difference(got, con.execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_model_queries_return_rows(spark, name):
    assert len(QUERIES[name](spark, SF).take(3)) > 0


def test_entry(spark):
    assert entry(spark).count() > 0
