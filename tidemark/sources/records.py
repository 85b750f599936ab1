"""Scan of sensor files in netCDF's classic format (versions 1, 2 and 5) by ranges of records.

    spark.dataSource.register(RecordScan)
    spark.read.format("tidemark_records").schema("file string, record long, time double, xrsb_flux double").load(folder)

Planning reads headers only and cuts each file's records into ranges of `recordsPerTask`, so one large file is many tasks'
work; where there would be more than `maxTasks` (TASKS) of them, a task takes several ranges one after another. A task reads the bytes of the asked variables in its range: a record's stretch of them, with gaps of at most GAP
bytes, or all of the range at once where nothing larger lies between. Columns: `file`, `record`, and variables along the record dimension (the
unlimited one, or the dimension named by the option `along`); a variable of more dimensions is an array. Values equal to
_FillValue or missing_value are null; scale_factor and add_offset are applied to columns of float or double. A variable
that a file hasn't got is null. Files that can't be read give one row with `error`, if the schema has it, else none.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.sources.file_sink import opened

#: Fixed by the format: type codes, and tags of lists.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
GAP, OWN = 4096, ("file", "record", "error")
TASKS = 512


@dataclass
class Variable:
    """One variable of a file: where it begins, how far its records lie apart, and what one holds."""

    name: str
    kind: np.dtype
    begin: int
    stride: int
    shape: list[int]
    attributes: dict

    @property
    def size(self) -> int:
        return self.kind.itemsize * int(np.prod(self.shape, dtype=np.int64))


@dataclass
class Header:
    records: int
    variables: dict[str, Variable] = field(default_factory=dict)


class _Reading:
    """The header's bytes, a step at a time."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self._read, self.at = read, 0

    def bytes(self, n: int) -> bytes:
        data = self._read(self.at, n)
        if len(data) < n:
            raise ValueError("the header is cut short")
        self.at += n
        return data

    def number(self, wide: bool) -> int:
        return struct.unpack(">q" if wide else ">i", self.bytes(8 if wide else 4))[0]


def header(read: Callable[[int, int], bytes], size: int, along: str | None = None) -> Header:
    """What a file of so many bytes says of itself."""
    r = _Reading(read)
    magic = r.bytes(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError("not a classic netCDF file")
    wide, far = magic[3] == 5, magic[3] != 1
    number = lambda: r.number(wide)

    def padded(n: int) -> bytes:
        return r.bytes(-(-n // 4) * 4)[:n]

    def name() -> str:
        return padded(number()).decode()

    def entries(tag: int) -> range:
        found, n = r.number(False), number()
        if found not in (0, tag) or n < 0 or n > size:
            raise ValueError("the header is damaged")
        return range(n)

    def attributes() -> dict:
        out = {}
        for _ in entries(ATTRIBUTES):
            key, kind = name(), np.dtype(TYPES[r.number(False)])
            n = number()
            values = np.frombuffer(padded(n * kind.itemsize), kind)
            out[key] = b"".join(values).decode("utf-8", "replace") if kind.kind == "S" else values
        return out

    records = number()
    dims = [(name(), number()) for _ in entries(DIMENSIONS)]
    attributes()
    raw = []
    for _ in entries(VARIABLES):
        key = name()
        ids = [number() for _ in range(number())]
        own, kind = attributes(), np.dtype(TYPES[r.number(False)])
        number()  # the format's own size is too small for large variables; it follows from the shape
        raw.append((key, ids, own, kind, r.number(far)))
    unlimited = {i for i, (_, n) in enumerate(dims) if n == 0}
    count = lambda ids: int(np.prod([dims[i][1] for i in ids], dtype=np.int64))
    in_record = [kind.itemsize * count(ids[1:]) for _, ids, _, kind, _ in raw if ids and ids[0] in unlimited]
    stride = in_record[0] if len(in_record) == 1 else sum(-(-n // 4) * 4 for n in in_record)
    wanted = unlimited if along is None else {i for i, (n, _) in enumerate(dims) if n == along}
    if along is not None and not wanted & unlimited:
        found = [n for n, _ in dims if n == along]
        total = dims[next(iter(wanted))][1] if found else 0
    else:
        starts = [b for _, ids, _, _, b in raw if ids and ids[0] in unlimited]
        total = records if records >= 0 else (size - min(starts)) // stride if starts and stride else 0
    out = Header(total)
    for key, ids, own, kind, begin in raw:
        if ids and ids[0] in wanted:
            shape = [dims[i][1] for i in ids[1:]]
            out.variables[key] = Variable(key, kind, begin, stride if ids[0] in unlimited else kind.itemsize * count(ids[1:]), shape, own)
    return out


def values(read: Callable[[int, int], bytes], some: list[Variable], begin: int, end: int) -> list[np.ndarray]:
    """The values of variables in the records from begin to end, a row for each record."""
    out: list = [None] * len(some)
    todo = sorted(range(len(some)), key=lambda i: (some[i].stride, some[i].begin))
    while todo:
        group = [todo.pop(0)]
        first, last = some[group[0]], some[group[0]].begin + some[group[0]].size
        while todo and some[todo[0]].stride == first.stride and some[todo[0]].begin - last <= GAP and some[todo[0]].begin + some[todo[0]].size - first.begin <= first.stride:
            group.append(todo.pop(0))
            last = max(last, some[group[-1]].begin + some[group[-1]].size)
        n, width = end - begin, last - first.begin
        if first.stride - width <= GAP:
            data = read(first.begin + begin * first.stride, (n - 1) * first.stride + width) if n else b""
            whole, step = data, first.stride
        else:
            whole, step = b"".join(read(first.begin + i * first.stride, width) for i in range(begin, end)), width
        if n and len(whole) < (n - 1) * step + width:
            raise ValueError("the records are cut short")
        for i in group:
            v = some[i]
            at = np.frombuffer(whole, np.uint8)
            rows = np.lib.stride_tricks.as_strided(at[v.begin - first.begin :], (n, v.size), (step, 1)) if n else np.zeros((0, v.size), np.uint8)
            out[i] = np.ascontiguousarray(rows).view(v.kind).reshape(n, *v.shape)
    return out


def column(v: Variable, raw: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Raw values as a column: fill values as nulls, scaled where it is of float or double."""
    inner = kind.value_type if pa.types.is_list(kind) else kind
    if v.kind.kind == "S":
        text = [b"".join(x.ravel()).decode("utf-8", "replace").rstrip("\x00 ") for x in raw.reshape(len(raw), -1)]
        return pa.array(text, pa.string()).cast(kind)
    hole = np.zeros(raw.shape, bool)
    for key in ("_FillValue", "missing_value"):
        if key in v.attributes and len(v.attributes[key]):
            hole |= raw == v.attributes[key][0]
    native = raw.astype(raw.dtype.newbyteorder("="))
    if pa.types.is_floating(inner) and ("scale_factor" in v.attributes or "add_offset" in v.attributes):
        native = native * float(v.attributes.get("scale_factor", [1])[0]) + float(v.attributes.get("add_offset", [0])[0])
    if not pa.types.is_list(kind):
        return pa.array(native.reshape(len(raw), -1)[:, 0], mask=hole.reshape(len(raw), -1)[:, 0]).cast(kind, safe=False)
    flat = pa.array(native.ravel(), mask=hole.ravel()).cast(inner, safe=False)
    width = int(np.prod(raw.shape[1:], dtype=np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * width, pa.int32()), flat).cast(kind)


def encoded(variables: dict[str, np.ndarray], attributes: dict[str, dict] | None = None, unlimited: bool = True) -> bytes:
    """A file (version 2) of variables along one dimension `record`; further dimensions are fixed."""
    codes = {np.dtype(t).newbyteorder("="): c for c, t in TYPES.items() if c != 2 and c < 7}
    named = lambda s: struct.pack(">i", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    n = len(next(iter(variables.values()))) if variables else 0
    dims, ids = [("record", 0 if unlimited else n)], {}
    for k, a in variables.items():
        ids[k] = [0, *range(len(dims), len(dims) + a.ndim - 1)]
        dims += [(f"{k}_{i}", m) for i, m in enumerate(a.shape[1:])]
    tagged = lambda tag, parts: struct.pack(">ii", tag if parts else 0, len(parts)) + b"".join(parts)

    def listed(held: dict) -> bytes:
        parts = []
        for k, x in held.items():
            x = np.asarray(x).reshape(-1)
            data = x.astype(x.dtype.newbyteorder(">")).tobytes()
            parts.append(named(k) + struct.pack(">ii", codes[x.dtype], len(x)) + data.ljust(-(-len(data) // 4) * 4, b"\0"))
        return tagged(ATTRIBUTES, parts)

    size = {k: a.dtype.itemsize * int(np.prod(a.shape[1:], dtype=np.int64)) for k, a in variables.items()}
    space = {k: (s if len(variables) == 1 else -(-s // 4) * 4) if unlimited else -(-s * n // 4) * 4 for k, s in size.items()}
    first = b"CDF\x02" + struct.pack(">i", n if unlimited else 0) + tagged(DIMENSIONS, [named(k) + struct.pack(">i", m) for k, m in dims]) + listed({})

    def whole(begins: dict[str, int]) -> bytes:
        return first + tagged(VARIABLES, [named(k) + struct.pack(f">{1 + len(ids[k])}i", len(ids[k]), *ids[k]) + listed((attributes or {}).get(k, {})) + struct.pack(">iiq", codes[a.dtype], min(space[k], (1 << 31) - 4), begins[k]) for k, a in variables.items()])

    at, begins = len(whole(dict.fromkeys(variables, 0))), {}
    for k in variables:
        begins[k], at = at, at + space[k]
    big = {k: a.astype(a.dtype.newbyteorder(">")) for k, a in variables.items()}
    if unlimited:
        lines, place = np.zeros((n, sum(space.values())), np.uint8), 0
        for k in variables if n else ():
            lines[:, place : place + size[k]] = np.frombuffer(big[k].tobytes(), np.uint8).reshape(n, size[k])
            place += space[k]
        return whole(begins) + lines.tobytes()
    return whole(begins) + b"".join(big[k].tobytes().ljust(space[k], b"\0") for k in variables)


class Range(ds.InputPartition):
    def __init__(self, file: str, begin: int, end: int, error: str | None = None):
        self.file, self.begin, self.end, self.error = file, begin, end, error


class Ranges(ds.InputPartition):
    """What one task reads."""

    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


def dealt(ranges: list[Range], most: int) -> list[Range | Ranges]:
    """Neighbouring ranges dealt to at most so many tasks; those that follow on in a file become one."""
    if len(ranges) <= most:
        return list(ranges)
    each, out = -(-len(ranges) // most), []
    for at in range(0, len(ranges), each):
        held: list[Range] = []
        for r in ranges[at : at + each]:
            if held and held[-1].file == r.file and held[-1].end == r.begin and held[-1].error is None and r.error is None:
                held[-1] = Range(r.file, held[-1].begin, r.end)
            else:
                held.append(r)
        out.append(Ranges(held))
    return out


class RecordScan(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_records"

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        return RecordReader(schema, self.options)


class RecordReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.along = to_arrow_schema(schema), options["path"], options.get("along")
        self.per_task = int(options.get("recordspertask", options.get("recordsPerTask", 1 << 20)))
        self.tasks = max(1, int(options.get("maxtasks", options.get("maxTasks", TASKS))))

    def _reading(self, at, file: str):
        f = at.open_input_file(file)

        def read(place: int, n: int) -> bytes:
            f.seek(place)
            return f.read(n)

        return f, read

    def partitions(self) -> list[Range | Ranges]:
        from pyarrow import fs

        at, folder = opened(self.path)
        out = []
        for f in sorted(at.get_file_info(fs.FileSelector(folder, recursive=True)), key=lambda f: f.path):
            if f.is_file and f.extension.lower() in ("nc", "cdf") and not f.base_name.startswith(("._", "_")):
                try:
                    with (opened_file := self._reading(at, f.path))[0]:
                        n = header(opened_file[1], f.size, self.along).records
                    out += [Range(f.path, a, min(a + self.per_task, n)) for a in range(0, n, self.per_task)]
                except (ValueError, KeyError, OSError, UnicodeDecodeError) as e:
                    out += [Range(f.path, 0, 0, str(e)[:200])] if "error" in self.schema.names else []
        return dealt(out or [Range("", 0, 0)], self.tasks)

    def read(self, partition: Range | Ranges) -> Iterator[pa.RecordBatch]:
        for part in partition.ranges if isinstance(partition, Ranges) else [partition]:
            yield from self._read(part)

    def _read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        error = part.error
        if error is None:
            at = opened(self.path)[0]
            f, read = self._reading(at, part.file)
            with f:
                try:
                    found = header(read, at.get_file_info(part.file).size, self.along).variables
                    some = [found[n] for n in self.schema.names if n not in OWN and n in found]
                    for a in range(part.begin, part.end, 1 << 14):
                        b = min(a + (1 << 14), part.end)
                        got = {v.name: column(v, x, self.schema.field(v.name).type) for v, x in zip(some, values(read, some, a, b))}
                        got |= {"file": pa.array([part.file] * (b - a)), "record": pa.array(range(a, b), pa.int64())}
                        yield pa.record_batch([got[c.name].cast(c.type) if c.name in got else pa.nulls(b - a, c.type) for c in self.schema], schema=self.schema)
                    return
                except (ValueError, pa.ArrowInvalid) as e:
                    error = str(e)[:200]
        if "error" in self.schema.names:
            row = {"file": part.file, "record": part.begin, "error": error}
            yield pa.record_batch([pa.array([row.get(c.name)], c.type) for c in self.schema], schema=self.schema)


def records(spark: SparkSession, path: str, columns: str, along: str | None = None, records_per_task: int = 1 << 20) -> DataFrame:
    """The records of a folder's files with these columns (a schema)."""
    spark.dataSource.register(RecordScan)
    reader = spark.read.format("tidemark_records").schema(columns).option("recordsPerTask", str(records_per_task))
    return (reader.option("along", along) if along else reader).load(path)


def as_files(rows: DataFrame, name: str, variables: dict[str, str]) -> DataFrame:
    """(name, content): a file of each row, for file_sink.written. variables name the columns with a variable's values:
    arrays of one length, of numbers; nulls in them become not-a-number. Rows with a null name or array give nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, *held in zip(*(c.to_pylist() for c in batch.columns)):
                if n is not None and all(v is not None for v in held):
                    arrays = {k: np.array([np.nan if x is None else x for x in v], np.float64) for k, v in zip(variables, held)}
                    yield pa.record_batch([pa.array([n]), pa.array([encoded(arrays)], pa.binary())], names=["name", "content"])

    return rows.select(rows[name].cast("string").alias("name"), *(rows[c] for c in variables.values())).mapInArrow(run, "name string, content binary")
