"""The driver's contract: names of queries and SQL, and every query with SQL against DuckDB."""

import subprocess
import sys

import pytest

from candlewick import queries as market


def _normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    text = lambda v: "" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(market.oracle_sql()))
def test_query_equals_sql(spark, data, duck, name):
    df = market.queries()[name](spark, data)
    found = duck.sql(market.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert _normal(df.collect(), df.columns) == _normal(found.fetchall(), found.columns)


def test_entry_names_and_flagship(spark, data):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_library_imports_without_the_training_data_operators():
    code = "import sys; sys.modules['candlewick.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) == len(e._market.queries()); print('fine')"
    assert "fine" in subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0]).stdout
