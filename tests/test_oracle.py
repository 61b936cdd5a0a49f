"""Every query with a SQL twin agrees with DuckDB on the same tables."""

import pytest
from compare import difference, duck
from conftest import SF

from __spark_entry__ import entry
from tallyline.plans.oracle import oracle_sql
from tallyline.plans.queries import all_queries as queries

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.count() == 10
    assert "total_profit" in df.columns


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert difference(queries()[name](spark, SF), con.sql(SQL[name])) is None
