"""Fetches as a work queue: a table of requests that rounds bring forward.

A request is (url, name): an object to be stored as `name` in a folder. The queue is a table with a version for each round;
a row has how often the request was tried, when it is due again, and its status (waiting, done, failed). A round takes the
waiting rows that are due, fetches them with at most `most_tasks` tasks over the whole cluster, whatever its size, and
writes the next version. A failed try is due again after a pause that doubles; after `attempts` tries the request has
failed. An object gets its name when it is whole, and a request whose object is there is done without a fetch, so a run
that was killed goes on without fetching anything twice.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from http.client import HTTPException

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.file_sink import _there, opened

QUEUE = "url string, name string, attempts int, due double, status string, error string"
WAITING, DONE, FAILED = "waiting", "done", "failed"


def _versions(spark: SparkSession, path: str) -> list[int]:
    from pyarrow import fs

    at, folder = opened(path)
    if not _there(at, folder):
        return []
    found = [int(f.base_name.partition("=")[2]) for f in at.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("version=")]
    return sorted(v for v in found if _there(at, f"{folder}/version={v}/_SUCCESS"))


def queue(spark: SparkSession, path: str) -> DataFrame:
    """The queue as it is now; empty if there is none."""
    versions = _versions(spark, path)
    return spark.read.schema(QUEUE).parquet(f"{path}/version={versions[-1]}") if versions else spark.createDataFrame([], QUEUE)


def _write(rows: DataFrame, path: str) -> None:
    versions = _versions(rows.sparkSession, path)
    rows.select("url", "name", "attempts", "due", "status", "error").write.mode("overwrite").parquet(f"{path}/version={versions[-1] + 1 if versions else 0}")


def added(requests: DataFrame, path: str) -> int:
    """Adds requests (url, name) whose name the queue hasn't got, and tells how many. Of several for one name the least url
    counts; null urls and names are left out."""
    spark = requests.sparkSession
    new = requests.where("url IS NOT NULL AND name IS NOT NULL").groupBy("name").agg(F.min("url").alias("url")).join(queue(spark, path).select("name"), "name", "left_anti")
    new = new.select("url", "name", F.lit(0).alias("attempts"), F.lit(0.0).alias("due"), F.lit(WAITING).alias("status"), F.lit(None).cast("string").alias("error"))
    before = queue(spark, path).count()
    _write(queue(spark, path).unionByName(new), path)
    return queue(spark, path).count() - before


def _fetched(url: str, at, target: str, timeout: float) -> None:
    """Stores what a url gives as `target`, whole or not at all."""
    import urllib.request

    part = f"{target.rpartition('/')[0]}/._{uuid.uuid4().hex}"
    try:
        with urllib.request.urlopen(url, timeout=timeout) as got, at.open_output_stream(part) as out:  # noqa: S310
            size, want = 0, got.headers.get("Content-Length")
            while block := got.read(1 << 20):
                out.write(block)
                size += len(block)
        if want is not None and size != int(want):
            raise OSError(f"{size} of {want} bytes")
        at.move(part, target)
    finally:
        if _there(at, part):
            at.delete_file(part)


def round_of(spark: SparkSession, path: str, folder: str, now: float, most_tasks: int = 6, attempts: int = 5, pause: float = 1.0, timeout: float = 120.0) -> int:
    """One round over the requests due at `now` (seconds); tells how many were tried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = opened(folder)
        for batch in batches:
            errors = []
            for url, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                error, target = None, f"{base}/{name}"
                try:
                    if not _there(at, target):
                        at.create_dir(target.rpartition("/")[0], recursive=True)
                        _fetched(url, at, target, timeout)
                except (OSError, ValueError, HTTPException) as e:
                    error = str(e)[:200] or type(e).__name__
                errors.append(error)
            yield pa.record_batch([batch.column(1), pa.array(errors, pa.string())], names=["name", "found"])

    all_of = queue(spark, path)
    due = all_of.where((F.col("status") == WAITING) & (F.col("due") <= now)).select("url", "name")
    tried = due.repartition(most_tasks).mapInArrow(run, "name string, found string").withColumn("tried", F.lit(True))
    both = all_of.join(tried, "name", "left")
    used = F.col("attempts") + F.when(F.col("tried"), 1).otherwise(0)
    status = F.when(F.col("tried").isNull(), F.col("status")).when(F.col("found").isNull(), DONE).when(used >= attempts, FAILED).otherwise(WAITING)
    again = F.when(F.col("tried"), F.lit(now) + F.lit(pause) * F.pow(F.lit(2.0), used - 1)).otherwise(F.col("due"))
    error = F.when(F.col("tried"), F.col("found")).otherwise(F.col("error"))
    count = due.count()
    if count:
        _write(both.select("url", "name", used.cast("int").alias("attempts"), again.alias("due"), status.alias("status"), error.alias("error")), path)
    return count


def fetched(spark: SparkSession, path: str, folder: str, most_tasks: int = 6, attempts: int = 5, pause: float = 1.0, timeout: float = 120.0) -> DataFrame:
    """Rounds until nothing waits; the queue then. Between rounds it sleeps until the first request is due."""
    while True:
        first = queue(spark, path).where(F.col("status") == WAITING).agg(F.min("due")).first()[0]
        if first is None:
            return queue(spark, path)
        time.sleep(max(0.0, first - time.time()))
        round_of(spark, path, folder, time.time(), most_tasks, attempts, pause, timeout)
