"""A writer that makes one file of each row, all of a job's files visible or none, by two phases.

    spark.dataSource.register(FileSink)
    rows.select("name", "content").write.format("tidemark_files").option("path", folder).mode("append").save()

Tasks write below `_pending/<job>` in the folder. The commit first lists what is to be published in a manifest, which is the
point of no return, then gives the files their names and takes the manifest away. An abort, or a task that fails for
good, takes the job's pending files away; what a task that was being stopped adds later stays below `_pending`, unseen. A driver that dies between leaves either no manifest (nothing is visible; the
next job's `recovered` drops the rest) or one, and `recovered` ends what it lists: giving names is safe to repeat.

`existing`: `keep` (default) leaves a file that is there as it is, `replace` overwrites it, `fail` aborts. Rows with a
null or empty name or null content write nothing; of rows with one name any one wins. Names may have folders in them, not
`..` or `_pending`. The folder is one that driver and executors reach, local or any URI that Arrow opens.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

PENDING = "_pending"


def opened(path: str):
    """The file system of a path, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _safe(name: str) -> bool:
    return all(p not in ("", ".", "..", PENDING) for p in name.split("/"))


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: (pending, name) of each file."""

    files: list[tuple[str, str]]


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FileWriter(self.options["path"], self.options.get("existing", "keep"))


class FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, existing: str):
        if existing not in ("keep", "replace", "fail"):
            raise ValueError("existing must be keep, replace or fail")
        self.path, self.existing, self.job = path, existing, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        at, folder = opened(self.path)
        done, pending = [], f"{folder}/{PENDING}/{self.job}"
        at.create_dir(pending, recursive=True)
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not name or not content.is_valid:
                    continue
                if not _safe(name):
                    raise ValueError(f"not a file name: {name!r}")
                part = f"{pending}/{uuid.uuid4().hex}"
                with at.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                done.append((part, name))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        at, folder = opened(self.path)
        files = {name: part for m in messages if m for part, name in m.files}
        if self.existing == "fail" and (there := [n for n in files if _there(at, f"{folder}/{n}")]):
            self.abort(messages)
            raise FileExistsError(f"{len(there)} files exist, such as {there[0]}")
        manifest = f"{folder}/{PENDING}/{self.job}.json"
        with at.open_output_stream(f"{manifest}.part") as out:
            out.write(json.dumps({"existing": self.existing, "files": files}).encode())
        at.move(f"{manifest}.part", manifest)
        _publish(at, folder, self.job)

    def abort(self, messages: list[Written | None]) -> None:
        at, folder = opened(self.path)
        for wait in (0.1, 0.3, 1.0, 0.0):  # tasks that are being stopped may still add a file
            try:
                if _there(at, f"{folder}/{PENDING}/{self.job}"):
                    at.delete_dir(f"{folder}/{PENDING}/{self.job}")
            except OSError:
                time.sleep(wait)


def _there(at, path: str) -> bool:
    from pyarrow import fs

    return at.get_file_info(path).type != fs.FileType.NotFound


def _publish(at, folder: str, job: str) -> None:
    """Ends what a manifest lists; what has its name already is passed over."""
    manifest = f"{folder}/{PENDING}/{job}.json"
    with at.open_input_stream(manifest) as f:
        listed = json.loads(f.read())
    for name, part in listed["files"].items():
        target = f"{folder}/{name}"
        if not _there(at, part) or (listed["existing"] == "keep" and _there(at, target)):
            continue
        at.create_dir(target.rpartition("/")[0], recursive=True)
        at.move(part, target)
    if _there(at, f"{folder}/{PENDING}/{job}"):
        at.delete_dir(f"{folder}/{PENDING}/{job}")
    at.delete_file(manifest)


def recovered(path: str) -> int:
    """Ends the jobs whose manifests a dead driver has left, drops what has none, and tells how many jobs it ended. To be
    called while no job writes to the folder."""
    from pyarrow import fs

    at, folder = opened(path)
    if not _there(at, f"{folder}/{PENDING}"):
        return 0
    jobs = [f.base_name[:-5] for f in at.get_file_info(fs.FileSelector(f"{folder}/{PENDING}")) if f.base_name.endswith(".json")]
    for job in jobs:
        _publish(at, folder, job)
    at.delete_dir(f"{folder}/{PENDING}")
    return len(jobs)


def written(rows: DataFrame, path: str, name: str = "name", content: str = "content", existing: str = "keep") -> None:
    """A file of each row of (name, content)."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(FileSink)
    rows.select(rows[name].alias("name"), rows[content].alias("content")).write.format("tidemark_files").options(path=path, existing=existing).mode("append").save()


def tensors(rows: DataFrame, path: str, key: str, values: str, shape: list[int], existing: str = "keep") -> None:
    """An .npy file of float32 and the given shape for each row, all or none; null arrays, null keys and arrays of another
    size write nothing."""
    import numpy as np

    size = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for batch in batches:
            names, contents = [], []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k is not None and v is not None and len(v) == size:
                    whole = io.BytesIO()
                    np.save(whole, np.array(v, np.float32).reshape(shape))
                    names.append(f"{k}.npy")
                    contents.append(whole.getvalue())
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["name", "content"])

    written(rows.select(rows[key].cast("string"), values).mapInArrow(run, "name string, content binary"), path, existing=existing)
