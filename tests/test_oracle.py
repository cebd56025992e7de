"""Every registered query against its DuckDB counterpart."""

import pytest

import __spark_entry__ as contract
from checks.compare import difference
from checks.oracle import SQL
from checks.queries import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, duck_con, sf_dir):
    assert difference(QUERIES[name](spark, sf_dir), duck_con, SQL[name]) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["event", "product", "day", "cum_ppt"] and df.count() > 0
