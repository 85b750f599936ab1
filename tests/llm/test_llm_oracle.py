"""The queries that have SQL against DuckDB, over whole tables."""

import duckdb
import pytest

from tidemark.llm import queries

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    cur = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    df = queries.queries()[name](spark, DIR)
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(cur.fetchall())


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]
