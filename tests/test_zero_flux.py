"""Queries against their SQL on events some of which have the value 0, whose logarithm is minus infinity."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from test_oracle import rows
from tidemark.operators import series
from tidemark.plans import registry
from tidemark.streaming import adaptive

NAMES = [
    "p_flux_scalars",
    "p_inverse_and_fill",
    "w_interpolation",
    "flagship_daily_class_metrics",
    "j_statistics",
    "a_metrics_report",
    "a_mae_bands",
    "a_log_histogram",
    "a_losses",
    "a_class_errors",
    "w_adaptive_weights",
    "x_train_only_state",
    "x_adaptive_stream",
]


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    """Events of two types and five users; one in forty has the value 0, and those of one user come in twos."""
    at, rng = str(tmp_path_factory.mktemp("zeros")), np.random.default_rng(4)
    value = np.round(10 ** rng.normal(1, 0.8, 1_500), 2)
    value[::40] = 0.0
    value[[100, 105]] = 0.0
    start = dt.datetime(2024, 1, 1)
    held = [(i, start + dt.timedelta(minutes=7 * i, microseconds=i), i % 5, "click" if rng.random() < 0.5 else "view", float(v), f'{{"k": {i % 23}}}') for i, v in enumerate(value)]
    held.append((1_500, start + dt.timedelta(days=20), 9, "click", 0.0, '{"k": 1}'))  # a day's only one
    spark.createDataFrame(held, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{at}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{at}/events.parquet/*.parquet')")
    return at, con


@pytest.mark.parametrize("name", NAMES)
def test_zero_flux(spark, zeros, name):
    at, con = zeros
    df = registry.queries()[name](spark, at)
    cur = con.execute(registry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in cur.description], cur.fetchall())


def test_stream_and_batch_agree_on_odd_errors(spark, tmp_path):
    """Null errors don't count, infinite ones and not-a-number do while they are among the last; zeros alone too."""
    odd = {7: None, 8: None, 9: None, 12: float("inf"), 30: float("nan"), 50: None}
    listed = [("a", b, odd.get(b, 0.1 + (b * 7 % 11) / 11)) for b in range(60)] + [("b", b, 0.0) for b in range(30)]
    df = spark.createDataFrame(listed, "c string, batch long, e double")
    at, batch = str(tmp_path / "cp"), F.col("batch")
    for _ in adaptive.in_ranges(df, str(tmp_path / "in"), "batch", 11):
        stream = adaptive.multipliers(adaptive.files(spark, str(tmp_path / "in"), df.schema), "c", "batch", "e", 15, 3, 4, 0.7, 0.5, 3.0)
        found = adaptive.drained(stream, f"odd{at[-6:]}", at)
    want = {(r.c, r.batch): r.multiplier for r in series.adaptive_multiplier(df, "c", "batch", "e", 15, 3, 4, 0.7, 0.5, 3.0, F.floor(batch / 20), 20).collect()}
    got = {(r.c, r.batch): r.multiplier for r in found.collect()}
    assert got.keys() == want.keys() and got == pytest.approx(want, rel=1e-9)
    assert got["a", 20] == 0.5 and got["a", 32] == 3.0 and got["a", 10] == 1.0 and got["b", 29] == 3.0


NULL_NAMES = ["a_class_errors", "w_adaptive_weights", "x_train_only_state", "x_adaptive_stream"]


@pytest.fixture(scope="module")
def gaps(spark, tmp_path_factory):
    """Events of two types; one in three has no value, so that batches have entries without a class."""
    at, rng = str(tmp_path_factory.mktemp("gaps")), np.random.default_rng(5)
    value = np.round(10 ** rng.normal(1, 0.8, 1_200), 2).tolist()
    start = dt.datetime(2024, 1, 1)
    held = [(i, start + dt.timedelta(minutes=7 * i), i % 5, "click" if rng.random() < 0.5 else "view", None if i % 3 == 1 else v, f'{{"k": {i % 23}}}') for i, v in enumerate(value)]
    spark.createDataFrame(held, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{at}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{at}/events.parquet/*.parquet')")
    return at, con


@pytest.mark.parametrize("name", NULL_NAMES)
def test_events_without_value(spark, gaps, name):
    at, con = gaps
    df = registry.queries()[name](spark, at)
    cur = con.execute(registry.oracle_sql()[name])
    want = rows([c[0] for c in cur.description], cur.fetchall())
    assert any(r[1] is None for r in want) and rows(df.columns, df.collect()) == want
