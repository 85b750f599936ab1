"""Readers, writers and streams, by round trips in temporary folders."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import series
from tidemark.sources import readers, sinks
from tidemark.streaming import adaptive


def test_sensor_csv(spark, tmp_path):
    for name, sat in (("combined_g13_avg1m_a_b.csv", 13), ("combined_g16_avg1m_a_b.csv", 16), ("other.csv", 0)):
        (tmp_path / name).write_text(f"time,xrsa_flux,xrsb_flux,xrsb_flag\n2024-01-01 00:00:00,1e-7,{sat}e-6,0\n")
    got = {r.sat: r.xrsb_flux for r in readers.sensor_csv(spark, str(tmp_path)).collect()}
    assert got == {13: 13e-6, 16: 16e-6}


def test_tensors_skip_sidecars_and_broken_files(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6, dtype=np.float64).reshape(2, 3))
    np.save(tmp_path / "b.npy", np.array([1.5], np.float32))
    (tmp_path / "c.npy").write_bytes(b"broken")
    (tmp_path / "._d.npy").write_bytes(b"sidecar")
    got = {r.name: (r.shape, r["values"]) for r in readers.tensors(spark, str(tmp_path)).collect()}
    assert got == {"a.npy": ([2, 3], [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]), "b.npy": ([1], [1.5])}


def test_config_substitutes_top_level_strings_once():
    got = readers.config("base: /data\nlevel: ${base}/x\nnested:\n  a: ${base}/y\n  b: ['${level}', '${none}', 3]\n")
    assert got["nested"] == {"a": "/data/y", "b": ["${base}/x", "${none}", 3]} and readers.config("") == {}


def test_reports_maps_statistics_and_quarantine(spark, tmp_path):
    rows = spark.createDataFrame([("2024", 1.0, 2.0)], "timestamp string, predictions double, groundtruth double")
    sinks.report_csv(rows, str(tmp_path / "r"))
    assert readers.predictions_csv(spark, str(tmp_path / "r")).collect() == rows.collect()
    grid = spark.createDataFrame([("a", [1.0, 2.0, 3.0, 4.0]), ("b", [1.0, float("nan"), 1.0, 1.0])], "ts string, m array<double>")
    sinks.maps(grid, str(tmp_path / "m"), "ts", "m", 2, "flux")
    assert sorted((r.ts, r.row, r.col, r.value) for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [("a", 0, 0, 1.0), ("a", 0, 1, 2.0), ("a", 1, 0, 3.0), ("a", 1, 1, 4.0)]
    sinks.write_statistics(spark.createDataFrame([(-5.0, 0.5)], "mean double, std double"), str(tmp_path / "s"))
    assert tuple(readers.statistics(spark, str(tmp_path / "s")).first()) == (-5.0, 0.5)
    sinks.quarantine(spark.createDataFrame([(1, True), (2, False)], "i int, quarantined boolean"), str(tmp_path / "g"), str(tmp_path / "b"))
    assert [spark.read.parquet(str(tmp_path / x)).first().i for x in "gb"] == [2, 1]
    sinks.by_partition(spark.createDataFrame([(1, "train"), (2, "val")], "i int, split string"), str(tmp_path / "p"), "split")
    assert {p.name for p in (tmp_path / "p").glob("split=*")} == {"split=train", "split=val"}
    sinks.sensor_csv(spark.createDataFrame([(13, 1.0)], "sat int, x double"), str(tmp_path / "c"))
    assert (tmp_path / "c" / "sat=13").exists()


def test_missing_only_is_idempotent(spark, tmp_path):
    rows = spark.range(5)
    assert sinks.missing_only(rows, str(tmp_path / "o"), "id") == 5
    assert sinks.missing_only(spark.range(8), str(tmp_path / "o"), "id") == 3 and spark.read.parquet(str(tmp_path / "o")).count() == 8


def test_stack_and_catalogue(spark):
    frames = spark.createDataFrame([(1, 94, [1.0]), (1, 131, [2.0]), (2, 94, [3.0])], "k int, ch int, px array<double>")
    assert [tuple(r) for r in readers.stacked(frames, "k", "ch", "px", [131, 94]).collect()] == [(1, [2.0, 1.0])]
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1), 94), (dt.datetime(2024, 1, 2), 94), (dt.datetime(2024, 1, 1), 1)], "ts timestamp_ntz, ch int")
    assert readers.catalogue(rows, "ts", "ch", "2024-01-01", "2024-01-01", [94]).count() == 1


@pytest.mark.parametrize("files", [1, 4])
def test_stream_state_equals_batch(spark, tmp_path, files):
    rng = np.random.default_rng(1)
    rows = [(c, b, float(e)) for c in ("a", "b") for b, e in enumerate(rng.random(40) + 0.1) if (b + len(c)) % 3]
    df = spark.createDataFrame(rows, "c string, batch long, e double")
    edges = np.linspace(0, 40, files + 1)
    for i in range(files):  # one file a trigger, in order
        df.where((F.col("batch") >= edges[i]) & (F.col("batch") < edges[i + 1])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = adaptive.multipliers(adaptive.files(spark, str(tmp_path / "in"), df.schema, 1), "c", "batch", "e", 20, 5, 4, 0.7, 0.5, 3.0)
    got = {(r.c, r.batch): r.multiplier for r in adaptive.drained(stream, f"t{files}", str(tmp_path / "cp")).collect()}
    want = series.adaptive_multiplier(df, "c", "batch", "e", 20, 5, 4, F.lit(0.7), F.lit(0.5), F.lit(3.0)).collect()
    assert got.keys() == {(r.c, r.batch) for r in want} and all(abs(got[r.c, r.batch] - r.multiplier) < 1e-9 for r in want)


def test_ranges_of_a_stream_equal_batch_and_leave_the_driver(spark, tmp_path):
    rows = [(c, b, 0.1 + (b * 7 % 11) / 11) for c in ("a", "b") for b in range(60)]
    df = spark.createDataFrame(rows, "c string, batch long, e double").repartition(5)
    at, seen = str(tmp_path / "cp"), []
    for n in adaptive.in_ranges(df, str(tmp_path / "in"), "batch", 25):
        stream = adaptive.multipliers(adaptive.files(spark, str(tmp_path / "in"), df.schema), "c", "batch", "e", 20, 5, 4, 0.7, 0.5, 3.0)
        found = adaptive.drained(stream, f"ranges{n}", at)
        seen.append((n, found.count()))
        assert not spark.catalog.tableExists(f"ranges{n}") and all(at in f for f in found.inputFiles())
    assert seen == [(0, 50), (1, 100), (2, 120)]
    want = {(r.c, r.batch): r.multiplier for r in series.adaptive_multiplier(df, "c", "batch", "e", 20, 5, 4, F.lit(0.7), F.lit(0.5), F.lit(3.0)).collect()}
    assert all(abs(want[r.c, r.batch] - r.multiplier) < 1e-9 for r in found.collect())
    for n in adaptive.in_ranges(df.limit(0), str(tmp_path / "none"), "batch", 25):
        assert n == 0 and adaptive.drained(adaptive.files(spark, str(tmp_path / "none"), df.schema), "none", str(tmp_path / "cp0")).count() == 0


def test_validation_reads_the_state_and_never_changes_it(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(c, b, float(e), b % 5 < 3) for c in ("a", "b") for b, e in enumerate(rng.random(60) + 0.1)]
    want = {}
    for c in ("a", "b"):
        held = []
        for _, b, e, learns in (r for r in rows if r[0] == c):
            last, whole = held[-5:], held[-20:]
            want[c, b] = 1.0 if len(whole) < 4 else min(max(np.exp(0.7 * (np.mean(last) / np.mean(whole) - 1)), 0.5), 3.0)
            held += [e] if learns else []
    df = spark.createDataFrame(rows, "c string, batch long, e double, learns boolean")
    got = series.learned_multiplier(df, "c", "batch", "e", F.col("learns"), 20, 5, 4, 0.7, 0.5, 3.0).collect()
    assert len(got) == len(want) and all(abs(want[r.c, r.batch] - r.multiplier) < 1e-9 for r in got)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = adaptive.multipliers(adaptive.files(spark, str(tmp_path / "in"), df.schema), "c", "batch", "e", 20, 5, 4, 0.7, 0.5, 3.0, "learns")
    streamed = adaptive.drained(stream, "learns", str(tmp_path / "cp")).collect()
    assert len(streamed) == len(want) and all(abs(want[r.c, r.batch] - r.multiplier) < 1e-9 for r in streamed)


def test_files_go_once_their_rows_are_written(spark, tmp_path):
    import time

    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = adaptive.drained(adaptive.files(spark, str(tmp_path / "in"), "id long", 1, delete=True), "gone", str(tmp_path / "cp"))
    assert sorted(r.id for r in found.collect()) == [*range(30)]
    for _ in range(50):
        if len(left := list((tmp_path / "in").glob("*.parquet"))) < 3:
            break
        time.sleep(0.2)
    assert len(left) < 3  # the last batch's file stays until another batch has come


def test_missing_pairs_and_tensor_files(spark, tmp_path):
    frames = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0]), ("c", None), (None, [5.0, 6.0]), ("d", [1.0])], "k string, v array<double>")
    sinks.missing_pairs(frames, spark.createDataFrame([("a",), ("a",), ("d",)], "k string"), "k", str(tmp_path / "p"), str(tmp_path / "m"))
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "p")).collect()) == ["a", "d"]
    assert sorted(str(r.k) for r in spark.read.parquet(str(tmp_path / "m")).collect()) == ["None", "b", "c"]
    at = str(tmp_path / "npy")
    assert sorted(r.k for r in sinks.tensor_files(frames, at, "k", "v", [1, 2]).collect()) == ["a", "b"]
    assert sinks.tensor_files(frames, at, "k", "v", [1, 2]).collect() == []
    assert {r.name: (r.shape, r["values"]) for r in readers.tensors(spark, at).collect()} == {"a.npy": ([1, 2], [1.0, 2.0]), "b.npy": ([1, 2], [3.0, 4.0])}


def test_throughput_counts_the_rows_of_a_stream(spark, tmp_path):
    import time

    from tidemark.streaming.progress import watched

    spark.range(50).write.parquet(str(tmp_path / "in"))
    seen = []
    listener = watched(spark, 10, lambda run, n: seen.append(n))
    adaptive.drained(adaptive.files(spark, str(tmp_path / "in"), "id long"), "watched", str(tmp_path / "cp"))
    for _ in range(50):
        if listener.ended:
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    (run,) = listener.ended
    assert listener.rows[run] == 50 and listener.rate(run) > 0 and seen
