import pytest

from rainshed.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, duck_con, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck_con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    pick = sorted(got.columns)
    rows = duck_con.sql(f"SELECT {', '.join(pick)} FROM ({SQL[name]}) t").fetchall()
    assert sorted(map(tuple, got.select(*pick).collect()), key=str) == sorted(rows, key=str)
