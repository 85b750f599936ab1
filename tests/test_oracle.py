"""Every query of the library against its SQL in DuckDB, on whole tables."""

import datetime
import math

import duckdb
import pytest

from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(cols, found):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def test_every_query_has_sql_or_tests_of_its_own():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"t_inference", "t_inference_patches", "t_training"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    got = rows(df.columns, df.collect())
    cur = duck.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = rows(cols, cur.fetchall())
    assert len(got) == len(want) > 0
    assert got == want
