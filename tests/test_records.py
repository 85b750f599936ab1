"""The scan of sensor files by ranges of records."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from tidemark.sources import records

COLUMNS = "file string, record long, time double, flux float, flag int, pair array<double>, none double, error string"


def sample(n, seed=0):
    rng = np.random.default_rng(seed)
    return {"time": np.arange(n, dtype=np.float64) * 60, "flux": rng.random(n).astype(np.float32), "flag": rng.integers(0, 5, n).astype(np.int16), "big": rng.random((n, 2_000)), "pair": rng.random((n, 2))}


def reading(data, counted=None):
    def read(at, n):
        if counted is not None:
            counted.append(len(data[at : at + n]))
        return data[at : at + n]

    return read


@pytest.mark.parametrize("unlimited", [True, False])
def test_header_and_values_by_ranges(unlimited):
    made = sample(50)
    data = records.encoded(made, {"flag": {"_FillValue": np.int16(3)}}, unlimited)
    h = records.header(reading(data), len(data), None if unlimited else "record")
    assert h.records == 50 and list(h.variables) == list(made) and h.variables["pair"].shape == [2]
    some = [h.variables[k] for k in ("pair", "time", "flag")]
    for a, b in ((0, 50), (7, 8), (49, 50), (20, 20)):
        got = records.values(reading(data), some, a, b)
        assert all(np.array_equal(x, made[v.name][a:b]) for v, x in zip(some, got))
    assert records.column(some[2], made["flag"], __import__("pyarrow").int32()).to_pylist() == [None if x == 3 else int(x) for x in made["flag"]]


def test_unread_variables_cost_no_bytes():
    made, counted = sample(1_000), []
    data = records.encoded(made)
    h = records.header(reading(data, counted), len(data))
    assert sum(counted) < 1_000
    counted.clear()
    records.values(reading(data, counted), [h.variables["time"], h.variables["flag"]], 100, 300)
    assert sum(counted) == 200 * (8 + 4 + 2) < len(data) / 500
    alone = records.encoded({"x": np.arange(9, dtype=np.int16)})
    assert records.values(reading(alone), [records.header(reading(alone), len(alone)).variables["x"]], 3, 6)[0].tolist() == [3, 4, 5]


def test_other_versions_streams_and_damage():
    """Versions 1 and 5 by hand, an unknown number of records, and headers that end early or lie."""
    name = lambda s, wide: struct.pack(">q" if wide else ">i", len(s)) + s.ljust(4, b"\0")
    for version, wide in ((1, False), (5, True)):
        num = lambda *x: struct.pack(f">{len(x)}{'q' if wide else 'i'}", *x)  # noqa: B023, E731
        for count in (3, -1):
            head = b"CDF" + bytes([version]) + num(count) + struct.pack(">i", 10) + num(1) + name(b"t", wide) + num(0) + struct.pack(">i", 0) + num(0) + struct.pack(">i", 11) + num(1)
            head += name(b"v", wide) + num(1, 0) + struct.pack(">i", 0) + num(0) + struct.pack(">i", 5) + num(4)
            begin = len(head) + (8 if wide else 4)
            data = head + struct.pack(">q" if wide else ">i", begin) + np.array([1.5, 2.5, 3.5], ">f4").tobytes()
            h = records.header(reading(data), len(data))
            assert h.records == 3 and records.values(reading(data), [h.variables["v"]], 1, 3)[0].tolist() == [2.5, 3.5]
            for cut in (3, 10, len(head) - 2):
                with pytest.raises(ValueError):
                    records.header(reading(data[:cut]), cut)
            with pytest.raises(ValueError):
                records.values(reading(data[:-2]), [h.variables["v"]], 0, 3)


def test_one_file_is_many_tasks_and_bad_files_are_counted(spark, tmp_path):
    made = {"a.nc": sample(2_500, 1), "sub/b.nc": sample(40, 2)}
    (tmp_path / "sub").mkdir()
    for k, v in made.items():
        (tmp_path / k).write_bytes(records.encoded(v, {"flux": {"scale_factor": np.float64(2), "add_offset": np.float64(1)}}))
    (tmp_path / "bad.nc").write_bytes(b"CDF\x07")
    (tmp_path / "late.nc").write_bytes((tmp_path / "sub/b.nc").read_bytes()[:-10_000])
    (tmp_path / "._a.nc").write_bytes(b"sidecar")
    df = records.records(spark, str(tmp_path), COLUMNS, records_per_task=100)
    assert df.rdd.getNumPartitions() == 25 + 1 + 1 + 1
    rows = df.collect()
    assert sorted(r.file.rpartition("/")[2] for r in rows if r.error) == ["bad.nc", "late.nc"]
    for k, v in made.items():
        got = sorted((r for r in rows if r.file.endswith("/" + k)), key=lambda r: r.record)
        assert [r.record for r in got] == list(range(len(v["time"]))) and [r.time for r in got] == v["time"].tolist()
        assert np.allclose([r.flux for r in got], 2 * v["flux"] + 1) and np.array_equal([r.pair for r in got], v["pair"]) and {r.none for r in got} == {None}
    assert records.records(spark, str(tmp_path), "time double").agg(F.count("*"), F.sum("time")).first()[0] == 2_580  # the cut file has all its times
    (tmp_path / "empty").mkdir()
    assert records.records(spark, str(tmp_path / "empty"), COLUMNS).collect() == []


def test_files_of_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, None]), ("b", None), (None, [1.0])], "k string, v array<double>")
    files = records.as_files(rows, "k", {"v": "v"}).collect()
    data = bytes(files[0].content)
    assert len(files) == 1 and np.isnan(records.values(reading(data), [records.header(reading(data), len(data)).variables["v"]], 0, 2)[0][1])
    reader = records.RecordReader(_parse_datatype_string(COLUMNS), {"path": str(tmp_path)})
    assert [p.file for p in reader.partitions()] == [""]


def test_many_ranges_are_a_bounded_number_of_tasks(spark, tmp_path):
    """More ranges than maxTasks: neighbours of a file are read as one, whole and in order; damaged files stay rows."""
    for i, n in enumerate((250, 0, 37, 110)):
        (tmp_path / f"{i}.nc").write_bytes(records.encoded(sample(n, i)))
    (tmp_path / "1b.nc").write_bytes(b"CDF")
    reader = lambda **o: records.RecordReader(_parse_datatype_string(COLUMNS), {"path": str(tmp_path), "recordsPerTask": "10", **o})
    assert len(reader().partitions()) == 25 + 4 + 11 + 1
    few = reader(maxTasks="6").partitions()
    assert len(few) == 6 and [(r.begin, r.end) for r in few[0].ranges] == [(0, 70)]
    rows = lambda r: [x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]
    assert rows(reader(maxTasks="6")) == rows(reader()) and len(rows(reader(maxTasks="1"))) == 250 + 37 + 110 + 1
