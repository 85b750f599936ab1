"""The streaming source by row offsets and the shuffle through bounded buffers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import grids
from tidemark.sources.row_stream import RowReader, RowStream
from tidemark.streaming.adaptive import drained
from tidemark.streaming.shuffle import _draw, shuffled

SCHEMA = "id long, name string, row_number long, lane int"


def source(spark, path, **options):
    spark.dataSource.register(RowStream)
    return spark.readStream.format("tidemark_rows").schema(SCHEMA).options(path=str(path), **options).load()


@pytest.fixture
def folder(spark, tmp_path):
    """700 rows in three files, with small row groups."""
    spark.range(700).select("id", F.concat(F.lit("n"), "id").alias("name"), F.lit("unread").alias("other")).repartitionByRange(3, "id").sortWithinPartitions("id").write.option("parquet.block.size", 1024).parquet(str(tmp_path / "in"))
    return tmp_path


def test_a_stopped_and_resumed_stream_reads_each_row_once(spark, folder):
    for take, want in ((100, 100), (100, 100), (450, 450), (10_000, 700)):
        got = drained(source(spark, folder / "in", take=take, rowsPerTask=64), f"s{take}", str(folder / "c")).collect()
        assert sorted((r.id, r.name, r.row_number, r.lane) for r in got) == [(i, f"n{i}", i, i % 8) for i in range(want)]
    spark.range(700, 720).select("id", F.lit(None).cast("string").alias("name"), F.lit("x").alias("other")).coalesce(1).write.parquet(str(folder / "more"))
    next((folder / "more").glob("part-*.parquet")).rename(folder / "in" / "part-99999-later.parquet")
    got = drained(source(spark, folder / "in"), "again", str(folder / "c")).collect()
    assert sorted(r.row_number for r in got) == list(range(720)) and {r.name for r in got if r.id >= 700} == {None}


def test_partitions_are_bounded_and_marks_close_a_run(spark, folder):
    from pyspark.sql.types import _parse_datatype_string

    reader = RowReader(_parse_datatype_string(SCHEMA), {"path": str(folder / "in"), "rowsPerTask": "50", "marks": "true", "lanes": "3"})
    assert reader.initialOffset() == {"row": 0} and reader.latestOffset() == {"row": 700}
    parts = reader.partitions({"row": 20}, {"row": 700})
    assert all(p.end - p.begin <= 50 for p in parts) and sum(p.end - p.begin for p in parts if p.file) == 680 and parts[-1].file is None
    assert [b.to_pydict() for b in reader.read(parts[-1])] == [{"id": [None] * 3, "name": [None] * 3, "row_number": [None] * 3, "lane": [0, 1, 2]}]
    assert all(p.file for p in reader.partitions({"row": 20}, {"row": 600})) and reader.partitions({"row": 700}, {"row": 700}) == []
    assert [r["id"] for p in parts[:-1] for b in reader.read(p) for r in b.to_pylist()] == list(range(20, 700))


def plain(n, buffer, seed, lane, lanes):
    held, out, came = [], [], 0
    for row in range(lane, n, lanes):
        if len(held) < buffer:
            held.append(row)
        else:
            j = _draw(seed, lane, came) % buffer
            out.append(held[j])
            held[j] = row
        came += 1
    for k in range(len(held), 0, -1):
        j = _draw(seed, lane, came + k) % k
        held[j], held[k - 1] = held[k - 1], held[j]
        out.append(held.pop())
    return out


def test_shuffle_keeps_every_row_within_its_buffer(spark, folder):
    """The same order in one run and in two, other orders for other seeds; no row leaves over a buffer's length early."""
    orders = {}
    for name, seed, takes in (("a", 1, (10_000,)), ("b", 1, (10_000,)), ("c", 2, (10_000,))):
        for take in takes:
            got = drained(shuffled(source(spark, folder / "in", take=take, marks="true", lanes=2), 40, seed), name, str(folder / name)).collect()
        orders[name] = {lane: [r.id for r in sorted(got, key=lambda r: r.place) if r.lane == lane] for lane in (0, 1)}
    assert orders["a"] == orders["b"] != orders["c"]
    for lane in (0, 1):
        assert orders["a"][lane] == plain(700, 40, 1, lane, 2)
        assert sorted(orders["a"][lane]) == list(range(lane, 700, 2)) != orders["a"][lane]
        assert min(place - x // 2 for place, x in enumerate(orders["a"][lane])) >= -40
    with pytest.raises(ValueError):
        shuffled(spark.range(1), 0)


def test_what_is_held_over_a_stop_comes_later(spark, folder):
    """Without marks a buffer stays in the state; the run that goes on from there gives the order of one run."""
    kept = drained(shuffled(source(spark, folder / "in", take=300, lanes=2), 40, 1), "first", str(folder / "s"))
    assert kept.count() == 300 - 2 * 40
    got = drained(shuffled(source(spark, folder / "in", marks="true", lanes=2), 40, 1), "second", str(folder / "s")).collect()
    assert all([r.id for r in sorted(got, key=lambda r: r.place) if r.lane == lane] == plain(700, 40, 1, lane, 2) for lane in (0, 1))


@pytest.mark.parametrize("side,window", [(1, 3), (5, 1), (6, 3), (4, 9)])
def test_neighbourhood_means_against_loops(spark, side, window):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3, side * side))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, None), (8, []), (9, [1.0] * (side * side + 1))]
    got = {(r.k, r.patch): r for r in grids.neighbourhood_means(spark.createDataFrame(rows, "k int, v array<double>"), "k", "v", side, window).collect()}
    assert len(got) == 3 * side * side
    for (k, p), r in got.items():
        near = [q for q in range(side * side) if abs(q // side - p // side) <= window // 2 and abs(q % side - p % side) <= window // 2]
        far = [x[k, q] for q in range(side * side) if q not in near]
        assert r.n_near == len(near) and r.near == pytest.approx(x[k, near].mean()) and (r.far == pytest.approx(np.mean(far)) if far else r.far is None)
