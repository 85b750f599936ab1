"""Writers of the engine's results. Spark's commit makes each write whole or absent."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_partition(rows: DataFrame, path: str, *keys: str) -> None:
    """Parquet in a folder for each value of the keys; replaces the folders that it writes."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def sensor_csv(rows: DataFrame, path: str, sat: str = "sat") -> None:
    """CSV with header, a folder for each source."""
    rows.write.mode("overwrite").partitionBy(sat).option("header", True).csv(path)


def report_csv(rows: DataFrame, path: str) -> None:
    """A small report as CSV with header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def predictions_csv(rows: DataFrame, path: str) -> None:
    """Predictions as CSV files with headers, as many as there are partitions."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def maps(rows: DataFrame, path: str, key: str, values: str, width: int, kind: str) -> None:
    """Arrays over a grid in long form (key, kind, row, col, value); arrays that hold not-a-number are left out."""
    sound = rows.where(~F.exists(values, lambda x: F.isnan(x)))
    each = sound.select(key, F.posexplode(values).alias("at", "value"))
    each.select(key, F.lit(kind).alias("kind"), F.floor(F.col("at") / width).cast("int").alias("row"), (F.col("at") % width).alias("col"), F.col("value").cast("float").alias("value")).write.mode("append").partitionBy("kind").parquet(path)


def quarantine(frames: DataFrame, good: str, bad: str, flag: str = "quarantined") -> None:
    """Frames in one of two places by their flag; nothing is moved."""
    frames.where(~F.col(flag)).drop(flag).write.mode("overwrite").parquet(good)
    frames.where(F.col(flag)).drop(flag).write.mode("overwrite").parquet(bad)


def write_statistics(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").parquet(path)


def missing_only(rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key isn't in the folder yet; how many these are."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = rows.select(key).limit(0)
    new = rows.join(done, key, "left_anti")
    n = new.count()
    new.write.mode("append").parquet(path)
    return n


def missing_pairs(frames: DataFrame, partners: DataFrame, key: str, paired: str, missing: str) -> None:
    """Frames whose key has a partner in one place, the others in another; neither side is moved or changed."""
    known = partners.select(key).distinct()
    frames.join(known, key, "left_semi").write.mode("overwrite").parquet(paired)
    frames.join(known, key, "left_anti").write.mode("overwrite").parquet(missing)


def tensor_files(rows: DataFrame, path: str, key: str, values: str, shape: list[int]) -> DataFrame:
    """(key): writes an .npy file of float32 and the given shape for each row whose key has none yet, and tells which.

    path is a folder that all tasks reach, local or any URI that Arrow opens. A file gets its name when it is whole, so a
    task that is run again finds it or writes it anew. Null arrays and arrays of another size write nothing.
    """
    uri = path if "://" in path else f"file://{path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import uuid

        import numpy as np
        from pyarrow import fs

        at, folder = fs.FileSystem.from_uri(uri)
        at.create_dir(folder, recursive=True)
        size = int(np.prod(shape))
        for batch in batches:
            written = []
            for name, array in zip(batch.column(0).to_pylist(), batch.column(1)):
                name, held = f"{folder}/{name}.npy", array.as_py()
                sound = held is not None and len(held) == size and at.get_file_info(name).type == fs.FileType.NotFound
                if sound:
                    whole = io.BytesIO()
                    np.save(whole, np.array(held, np.float32).reshape(shape))
                    part = f"{folder}/._{uuid.uuid4().hex}.npy"
                    with at.open_output_stream(part) as out:
                        out.write(whole.getvalue())
                    at.move(part, name)
                written.append(sound)
            yield batch.select([0]).filter(pa.array(written))

    named = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key), values)
    return named.mapInArrow(run, f"{key} string")
