"""A streaming source of its own: the rows of a folder of Parquet files, in order of files, by row offsets.

    spark.dataSource.register(RowStream)
    spark.readStream.format("tidemark_rows").schema(...).option("path", folder).option("take", n).load()

The offset is the number of rows read, so a query that is stopped and started again on its checkpoint goes on where it was.
Only footers are read to plan; each partition reads at most `rowsPerTask` rows of the columns asked for. `take` ends the
stream after so many rows; without it the stream ends where the files do, and files whose names sort after the others may
be added. The folder must be one that driver and executors reach, local or any URI that Arrow opens.

Two columns have their values from the source if the schema has them: `row_number`, from 0, and `lane`, which is
row_number % lanes. With `marks` true, a run that reaches its end closes with a row for each lane in which all else is
null: what holds rows back may then let them go.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Rows(InputPartition):
    """Rows of one file: those from begin to end, the first of which is number `first` of the stream."""

    def __init__(self, file: str | None, begin: int, end: int, first: int):
        self.file, self.begin, self.end, self.first = file, begin, end, first


class RowStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_rows"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return RowReader(schema, self.options)


class RowReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.lanes, self.marks = int(options.get("lanes", 8)), options.get("marks", "false").lower() == "true"
        self.take = int(options["take"]) if "take" in options else None
        self.per_task = int(options.get("rowspertask", options.get("rowsPerTask", 1 << 16)))

    def _folder(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def _files(self) -> tuple[list[str], list[int]]:
        """The files in order, and the number of the first row of each, with that after the last."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        at, folder = self._folder()
        files = sorted(f.path for f in at.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")))
        starts = [0]
        for f in files:
            starts.append(starts[-1] + pq.read_metadata(f, filesystem=at).num_rows)
        return files, starts

    def _end(self, rows: int) -> int:
        return rows if self.take is None else min(rows, self.take)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"row": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"row": self._end(self._files()[1][-1])}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        files, starts = self._files()
        at, stop, out = start["row"], end["row"], []
        marks = self.marks and stop > at and stop == self._end(starts[-1])
        while at < stop:
            i = bisect.bisect_right(starts, at) - 1
            to = min(stop, starts[i + 1], at + self.per_task)
            out.append(Rows(files[i], at - starts[i], to - starts[i], at))
            at = to
        return out + [Rows(None, 0, self.lanes, 0)] * marks

    def commit(self, end: dict) -> None:
        pass

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        schema, own = to_arrow_schema(self.schema), ("row_number", "lane")
        if part.file is None:
            lane = pa.array(range(part.end), pa.int32())
            yield pa.record_batch([lane.cast(f.type) if f.name == "lane" else pa.nulls(part.end, f.type) for f in schema], schema=pa.schema([f.with_nullable(True) for f in schema]))
            return
        at, file_at = 0, pq.ParquetFile(part.file, filesystem=self._folder()[0])
        columns = [f.name for f in schema if f.name not in own]
        for group in range(file_at.num_row_groups):
            n = file_at.metadata.row_group(group).num_rows
            begin, end = max(part.begin - at, 0), min(part.end - at, n)
            if begin < end:
                t = file_at.read_row_group(group, columns=columns).slice(begin, end - begin)
                number = pa.array(range(part.first + at + begin - part.begin, part.first + at + end - part.begin), pa.int64())
                made = {"row_number": number, "lane": pa.array([x % self.lanes for x in number.to_pylist()], pa.int32())}
                yield from pa.table([(made[f.name] if f.name in own else t[f.name]).cast(f.type) for f in schema], schema=schema).to_batches()
            at += n
