"""Scan of FITS images, headers first.

    spark.dataSource.register(FitsScan)
    spark.read.format("tidemark_fits").schema("file string, QUALITY int, `DATE-OBS` string, pixels array<float>").load(folder)

Tasks get lists of files. Of each file the header blocks come first (2,880 bytes each); filters on header columns that Spark
pushes down are decided on these, and pixels are read only for files that pass, and only if they are asked for. Columns:
`file`, `shape` (slowest axis first), `pixels` (flat, BSCALE and BZERO applied), `error` (why a file can't be read, all
else null then), and any keyword of the header by its name, converted to the column's type (null if it isn't there or
can't be). The image is that of the first header unit that has data; compressed ones are an error. Push-down needs
spark.sql.python.filterPushdown.enabled, which `images` sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.sources.file_sink import opened

BLOCK, CARD = 2880, 80
#: Fixed by the format: bits of a value, negative for floating point.
TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
OWN = ("file", "shape", "pixels", "error")


def _value(text: str):
    """What stands after `= ` on a card: a text, a truth value, a number or nothing."""
    text = text.strip()
    if text.startswith("'"):
        out, at = [], 1
        while at < len(text):
            if text[at] == "'":
                if text[at + 1 : at + 2] != "'":
                    break
                at += 1
            out.append(text[at])
            at += 1
        return "".join(out).rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    for kind in (int, float):
        try:
            return kind(text.replace("D", "E"))
        except ValueError:
            pass
    return None


def header(read: Callable[[int, int], bytes], at: int) -> tuple[dict, int]:
    """The cards of the header unit at a place, and where its data begin. read(place, size) gives bytes."""
    cards: dict = {}
    while True:
        block = read(at, BLOCK)
        if len(block) < BLOCK:
            raise ValueError("the header has no end")
        at += BLOCK
        for i in range(0, BLOCK, CARD):
            card = block[i : i + CARD].decode("ascii", "replace")
            key = card[:8].rstrip()
            if key == "END":
                return cards, at
            if card[8:10] == "= " and key:
                cards.setdefault(key, _value(card[10:]))


def _count(cards: dict) -> tuple[list[int], int]:
    """The axes, slowest first, and the bytes of a unit's data."""
    if cards.get("BITPIX") not in TYPES:
        raise ValueError("no BITPIX")
    axes = [int(cards[f"NAXIS{i}"]) for i in range(int(cards.get("NAXIS", 0)), 0, -1)]
    n = int(np.prod(axes, dtype=np.int64)) if axes else 0
    return axes, abs(int(cards["BITPIX"])) // 8 * int(cards.get("GCOUNT", 1)) * (int(cards.get("PCOUNT", 0)) + n)


def image_header(read: Callable[[int, int], bytes]) -> tuple[dict, list[int], int]:
    """The header of the first unit with data, its axes, and where the data begin."""
    at = 0
    while True:
        cards, begin = header(read, at)
        if not at and cards.get("SIMPLE") is not True:
            raise ValueError("not a FITS file")
        axes, size = _count(cards)
        if size:
            if cards.get("ZIMAGE") or str(cards.get("XTENSION", "IMAGE")).strip() != "IMAGE":
                raise ValueError("the first unit with data is no plain image")
            return cards, axes, begin
        at = begin


def pixels(read: Callable[[int, int], bytes], cards: dict, axes: list[int], begin: int) -> np.ndarray:
    kind = np.dtype(TYPES[int(cards["BITPIX"])])
    n = int(np.prod(axes, dtype=np.int64))
    data = read(begin, n * kind.itemsize)
    if len(data) < n * kind.itemsize:
        raise ValueError("the pixels are cut short")
    raw = np.frombuffer(data, kind)
    out = raw.astype(np.float64) * float(cards.get("BSCALE", 1) or 1) + float(cards.get("BZERO", 0) or 0)
    return np.where(raw == cards["BLANK"], np.nan, out) if "BLANK" in cards and kind.kind != "f" else out


def encoded(cards: dict, values: np.ndarray) -> bytes:
    """A FITS file of one image of float32 with these cards."""
    def card(key: str, value) -> str:
        shown = f"'{value.replace(chr(39), chr(39) * 2):<8}'" if isinstance(value, str) else f"{'T' if value else 'F':>20}" if isinstance(value, bool) else f"{value!r:>20}"
        return f"{key:<8}= {shown}"[:CARD].ljust(CARD)

    axes = {f"NAXIS{i}": n for i, n in enumerate(reversed(values.shape), 1)}
    text = "".join(card(k, v) for k, v in ({"SIMPLE": True, "BITPIX": -32, "NAXIS": values.ndim} | axes | cards).items()) + "END".ljust(CARD)
    data = values.astype(">f4").tobytes()
    return text.ljust(-(-len(text) // BLOCK) * BLOCK).encode("ascii") + data + bytes(-len(data) % BLOCK)


class Files(ds.InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class FitsScan(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_fits"

    def schema(self) -> str:
        return "file string, shape array<int>, pixels array<float>, error string"

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        return FitsReader(schema, self.options)


def _converted(value, kind: pa.DataType):
    try:
        if value is None:
            return None
        if pa.types.is_string(kind):
            return str(value)
        if pa.types.is_boolean(kind):
            return value if isinstance(value, bool) else None
        if isinstance(value, bool):
            return None
        if pa.types.is_integer(kind):
            return int(value) if float(value) == int(float(value)) else None
        return float(value) if pa.types.is_floating(kind) else None
    except (ValueError, OverflowError):
        return None


class FitsReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.filters = to_arrow_schema(schema), options["path"], []
        self.per_task = int(options.get("filespertask", options.get("filesPerTask", 64)))

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        """Filters on header columns drop files before their pixels are read. Spark applies all of them again."""
        kept = (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual, ds.In, ds.IsNotNull, ds.StringStartsWith)
        self.filters = [f for f in filters if isinstance(f, kept) and len(f.attribute) == 1 and f.attribute[0] not in OWN]
        yield from filters

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        at, folder = opened(self.path)
        files = sorted(f.path for f in at.get_file_info(fs.FileSelector(folder, recursive=True)) if f.is_file and f.extension.lower() in ("fits", "fit", "fts") and not f.base_name.startswith(("._", "_")))
        return [Files(files[i : i + self.per_task]) for i in range(0, max(1, len(files)), self.per_task)]

    def _passes(self, row: dict) -> bool:
        for f in self.filters:
            v = row.get(f.attribute[0])
            if v is None:
                return False
            ok = {"EqualTo": lambda: v == f.value, "GreaterThan": lambda: v > f.value, "GreaterThanOrEqual": lambda: v >= f.value, "LessThan": lambda: v < f.value, "LessThanOrEqual": lambda: v <= f.value, "In": lambda: v in f.value, "IsNotNull": lambda: True, "StringStartsWith": lambda: v.startswith(f.value)}[type(f).__name__]  # noqa: B023
            if not ok():
                return False
        return True

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        at = opened(self.path)[0]
        names = self.schema.names
        for file in part.files:
            row = dict.fromkeys(names)
            row["file"] = file
            try:
                with at.open_input_file(file) as f:
                    def bytes_at(place: int, size: int) -> bytes:
                        f.seek(place)  # noqa: B023
                        return f.read(size)  # noqa: B023

                    cards, axes, begin = image_header(bytes_at)
                    row |= {n: _converted(cards.get(n.upper()), self.schema.field(n).type) for n in names if n not in OWN}
                    if not self._passes(row):
                        continue
                    row["shape"] = axes
                    if "pixels" in names:
                        row["pixels"] = pixels(bytes_at, cards, axes, begin)
            except (ValueError, KeyError, OSError) as e:
                row = dict.fromkeys(names) | {"file": file, "error": str(e)[:200]}
                if self.filters:
                    continue  # a header column is null there
            yield pa.record_batch([pa.array([row[f.name]], f.type) for f in self.schema], schema=self.schema)


def images(spark: SparkSession, path: str, columns: str, files_per_task: int = 64) -> DataFrame:
    """The images of a folder with these columns (a schema). Filters on header columns are pushed into the scan."""
    spark.dataSource.register(FitsScan)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("tidemark_fits").schema(columns).option("filesPerTask", str(files_per_task)).load(path)


def as_files(rows: DataFrame, name: str, pixels: str, width: int, keywords: dict[str, str]) -> DataFrame:
    """(name, content): a FITS image of float32 for each row, `width` values a line, for file_sink.written. keywords name
    the columns whose values go to the header (nulls are left out). Null arrays and those that fill no whole lines give
    nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, values, *held in zip(*(c.to_pylist() for c in batch.columns)):
                if n is not None and values and len(values) % width == 0:
                    cards = {k: v for k, v in zip(keywords, held) if v is not None}
                    content = encoded(cards, np.array([np.nan if v is None else v for v in values], np.float32).reshape(-1, width))
                    yield pa.record_batch([pa.array([n]), pa.array([content], pa.binary())], names=["name", "content"])

    return rows.select(rows[name].cast("string").alias("name"), rows[pixels], *(rows[c] for c in keywords.values())).mapInArrow(run, "name string, content binary")
