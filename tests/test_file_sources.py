"""The two-phase file writer and the header-first image scan."""

import json

import numpy as np
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from tidemark.sources import file_sink, fits

COLUMNS = "file string, QUALITY int, `DATE-OBS` string, EXPTIME double, DONE boolean, shape array<int>, pixels array<float>, error string"


def listed(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file())


def test_files_appear_together(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("d"), F.col("id") % 3, F.lit("/"), "id", F.lit(".bin")).alias("name"), F.concat(F.lit("x"), "id").cast("binary").alias("content")).repartition(4)
    odd = spark.createDataFrame([(None, b"x"), ("", b"x"), ("null.bin", None)], "name string, content binary")
    file_sink.written(rows.unionByName(odd), str(tmp_path / "out"))
    assert listed(tmp_path / "out") == sorted(f"d{i % 3}/{i}.bin" for i in range(40)) and (tmp_path / "out/d1/7.bin").read_bytes() == b"x7"
    again = rows.withColumn("content", F.lit(b"new"))
    file_sink.written(again, str(tmp_path / "out"))
    assert (tmp_path / "out/d1/7.bin").read_bytes() == b"x7"
    file_sink.written(again.where("name = 'd1/7.bin'"), str(tmp_path / "out"), existing="replace")
    assert (tmp_path / "out/d1/7.bin").read_bytes() == b"new"
    with pytest.raises(Exception, match="files exist"):
        file_sink.written(again.unionByName(spark.createDataFrame([("fresh.bin", b"")], "name string, content binary")), str(tmp_path / "out"), existing="fail")
    file_sink.written(rows.limit(0), str(tmp_path / "none"))
    assert "fresh.bin" not in listed(tmp_path / "out") and len(listed(tmp_path / "out")) == 40 and listed(tmp_path / "none") == []


@pytest.mark.parametrize("bad", ["../up.bin", "a//b", "_pending/x"])
def test_a_failing_task_leaves_nothing(spark, tmp_path, bad):
    rows = spark.range(30).select(F.when(F.col("id") == 29, bad).otherwise(F.concat("id", F.lit(".bin"))).alias("name"), F.lit(b"x").alias("content")).repartitionByRange(5, "name")
    with pytest.raises(Exception, match="not a file name"):
        file_sink.written(rows, str(tmp_path / "out"))
    assert [x for x in listed(tmp_path / "out") if not x.startswith("_pending/")] == [] and not (tmp_path / "up.bin").exists()
    assert file_sink.recovered(str(tmp_path / "out")) == 0 and listed(tmp_path / "out") == []


def test_a_commit_that_was_cut_off_ends_later(tmp_path):
    """The driver dies before the manifest (nothing is visible), after it, or between two names."""
    out = tmp_path / "out"
    for names, manifest in ((["a", "b"], False), (["c", "d", "e"], True)):
        w = file_sink.FileWriter(str(out), "keep")
        import pyarrow as pa

        m = w.write(iter([pa.record_batch([pa.array(names), pa.array([n.encode() for n in names], pa.binary())], names=["name", "content"])]))
        if manifest:
            (out / "_pending" / f"{w.job}.json").write_text(json.dumps({"existing": "keep", "files": {n: p for p, n in m.files}}))
            (out / "c").write_bytes((out / "_pending" / w.job / m.files[0][0].rpartition("/")[2]).read_bytes())
            (out / "_pending" / w.job / m.files[0][0].rpartition("/")[2]).unlink()
    assert [p.name for p in out.iterdir() if p.is_file()] == ["c"]
    assert file_sink.recovered(str(out)) == 1 and listed(out) == ["c", "d", "e"] and file_sink.recovered(str(out)) == 0
    assert (out / "d").read_bytes() == b"d"


def test_tensors(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None), (None, [1.0, 2.0]), ("c", [1.0])], "k string, v array<double>")
    file_sink.tensors(rows, str(tmp_path / "t"), "k", "v", [2, 1])
    assert listed(tmp_path / "t") == ["a.npy"] and np.load(tmp_path / "t/a.npy").tolist() == [[1.0], [2.0]]


@pytest.fixture
def folder(tmp_path):
    for i in range(20):
        cards = {"QUALITY": i % 4, "DATE-OBS": f"2024-01-{i + 1:02d}T00:00:00", "EXPTIME": i / 2, "DONE": i % 2 == 0, "NOTE": "it's / odd"}
        (tmp_path / f"f{i:02d}.fits").write_bytes(fits.encoded(cards, np.arange(600).reshape(20, 30) + i))
    (tmp_path / "broken.fits").write_bytes(b"SIMPLE  = no")
    (tmp_path / "short.fits").write_bytes((tmp_path / "f00.fits").read_bytes()[: 2880 + 100])
    (tmp_path / "._f00.fits").write_bytes(b"sidecar")
    (tmp_path / "other.txt").write_text("no image")
    return tmp_path


def test_scan_reads_headers_pixels_and_errors(spark, folder):
    got = {r.file.rpartition("/")[2]: r for r in fits.images(spark, str(folder), COLUMNS, 3).collect()}
    assert len(got) == 22 and got["broken.fits"].error and got["short.fits"].error and got["short.fits"].QUALITY is None
    r = got["f07.fits"]
    assert (r.QUALITY, r["DATE-OBS"], r.EXPTIME, r.DONE, r.shape, r.error) == (3, "2024-01-08T00:00:00", 3.5, False, [20, 30], None)
    assert r.pixels == [float(x + 7) for x in range(600)]
    assert fits.images(spark, str(folder), "file string, NOTE string, QUALITY string, NONE int").where("NOTE = \"it's / odd\"").count() == 21  # a sound header over pixels that are cut short
    df = fits.images(spark, str(folder), COLUMNS, 3).where("QUALITY = 0 AND `DATE-OBS` >= '2024-01-09'")
    assert sorted(r.file[-8:] for r in df.collect()) == ["f08.fits", "f12.fits", "f16.fits"]
    assert fits.images(spark, str(folder), COLUMNS).where("QUALITY IN (1, 2) AND EXPTIME < 3 AND `DATE-OBS` LIKE '2024%'").count() == 3
    assert fits.images(spark, str(folder / "x"), COLUMNS).count() == 0 if (folder / "x").mkdir() is None else True


def test_dropped_files_cost_their_header_only(folder, monkeypatch):
    """Bytes are counted where the scan reads them."""
    counted = {}

    class Counting:
        def __init__(self, at):
            self.at = at

        def __getattr__(self, k):
            return getattr(self.at, k)

        def open_input_file(self, file):
            f = self.at.open_input_file(file)
            class Reading:
                seek = f.seek
                def __enter__(self):
                    return self
                def __exit__(self, *_):
                    f.close()
                def read(self, n):
                    data = f.read(n)
                    counted[file] = counted.get(file, 0) + len(data)
                    return data
            return Reading()

    plain = fits.opened
    monkeypatch.setattr(fits, "opened", lambda path: (lambda at, p: (Counting(at), p))(*plain(path)))
    reader = fits.FitsReader(_parse_datatype_string(COLUMNS), {"path": str(folder)})
    assert list(reader.pushFilters([ds.EqualTo(("QUALITY",), 0), ds.EqualTo(("file",), "x")])) and len(reader.filters) == 1
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    kept = {r["file"] for r in found}
    assert len(kept) == 5 and all(n == (2880 + 2400 if f in kept else 2880) for f, n in counted.items() if "/f" in f.rpartition("/")[0] + f[-9:-7] and "short" not in f and "broken" not in f)
    reader = fits.FitsReader(_parse_datatype_string("file string, QUALITY int"), {"path": str(folder)})
    counted.clear()
    assert len([1 for p in reader.partitions() for b in reader.read(p)]) == 22 and max(counted.values()) == 2880


def test_scaled_integers_blanks_and_extensions():
    def unit(cards, data=b""):
        text = "".join(f"{k:<8}= {v:>20}".ljust(80) for k, v in cards) + "END".ljust(80)
        return text.ljust(-(-len(text) // 2880) * 2880).encode() + data + bytes(-len(data) % 2880)

    data = np.array([[1, -2, 3], [4, 5, -6]], ">i2").tobytes()
    whole = unit([("SIMPLE", "T"), ("BITPIX", 8), ("NAXIS", 0)]) + unit([("XTENSION", "'IMAGE   '"), ("BITPIX", 16), ("NAXIS", 2), ("NAXIS1", 3), ("NAXIS2", 2), ("BSCALE", "5.0D-1"), ("BZERO", 10), ("BLANK", -2)], data)
    read = lambda at, n: whole[at : at + n]
    cards, axes, begin = fits.image_header(read)
    assert axes == [2, 3] and np.array_equal(fits.pixels(read, cards, axes, begin), [10.5, np.nan, 11.5, 12, 12.5, 7], equal_nan=True)
    table = unit([("SIMPLE", "T"), ("BITPIX", 8), ("NAXIS", 0)]) + unit([("XTENSION", "'BINTABLE'"), ("BITPIX", 8), ("NAXIS", 1), ("NAXIS1", 8)], b"12345678")
    with pytest.raises(ValueError, match="no plain image"):
        fits.image_header(lambda at, n: table[at : at + n])
