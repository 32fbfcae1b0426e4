"""Queries on built-in tables give the rows that are written out for them."""

import duckdb
import pytest

from folkmoot import case_queries

SQL = case_queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_case(spark, name):
    df = case_queries.queries()[name](spark, "")
    cur = duckdb.connect().execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*names).collect())
