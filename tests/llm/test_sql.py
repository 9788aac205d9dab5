"""Operators whose results SQL can express, against DuckDB over the driver's whole tables."""

import pytest

from candlewick.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    df, found = queries.queries()[name](spark, data), con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(df.select(columns).collect()) == order(found.select(*columns).fetchall())
