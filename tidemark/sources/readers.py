"""Readers of the engine's inputs."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SENSOR = "time timestamp_ntz, xrsa_flux double, xrsb_flux double, xrsb_flag int"


def sensor_csv(spark: SparkSession, path: str, schema: str = SENSOR, name: str = r"combined_g(\d+)_") -> DataFrame:
    """CSV files of sensors with `sat` and `file` from their names; names of another form are passed over."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    file = F.element_at(F.split("_metadata.file_path", "/"), -1)
    found = rows.select("*", file.alias("file"), F.regexp_extract(file, name, 1).try_cast("int").alias("sat"))
    return found.where(F.col("sat").isNotNull() & ~F.col("file").startswith("._"))


def predictions_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("timestamp string, predictions double, groundtruth double").option("header", True).csv(path)


def shards(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Parquet shards, the named columns alone."""
    return spark.read.parquet(path).select(*columns)


def tensors(spark: SparkSession, path: str) -> DataFrame:
    """(name, shape, values) of .npy files; sidecar files that begin with `._` and unreadable files are passed over."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").where(~F.col("name").startswith("._"))

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for frame in frames:
            out = []
            for name, content in zip(frame["name"], frame["content"]):
                try:
                    a = np.load(io.BytesIO(content), allow_pickle=False)
                except ValueError:
                    continue
                out.append((name, list(a.shape), a.astype("float32").ravel()))
            yield pd.DataFrame(out, columns=["name", "shape", "values"])

    return named.mapInPandas(load, "name string, shape array<int>, values array<float>")


def stacked(frames: DataFrame, key: str, channel: str, pixels: str, order: list) -> DataFrame:
    """(key, stack): the channels' images one after another in the given order; keys without all channels go."""
    each = [F.first(F.when(F.col(channel) == c, F.col(pixels)), True).alias(f"c{i}") for i, c in enumerate(order)]
    found = frames.where(F.col(channel).isin(*order)).groupBy(key).agg(*each)
    names = [f"c{i}" for i in range(len(order))]
    return found.dropna(subset=names).select(key, F.concat(*names).alias("stack"))


def catalogue(rows: DataFrame, ts: str, channel: str, start: str, end: str, channels: list) -> DataFrame:
    """Rows of a time window (closed) and some channels; both conditions reach the files."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return rows.where((F.col(ts) >= at(start)) & (F.col(ts) <= at(end)) & F.col(channel).isin(*channels))


def config(text: str) -> dict[str, Any]:
    """A YAML text with `${name}` replaced by the top level's strings, once; unknown names stay."""
    import yaml

    tree = yaml.safe_load(text) or {}
    known = {k: v for k, v in tree.items() if isinstance(v, str)}

    def put(x: Any) -> Any:
        if isinstance(x, str):
            return re.sub(r"\$\{(\w+)\}", lambda m: known.get(m[1], m[0]), x)
        if isinstance(x, dict):
            return {k: put(v) for k, v in x.items()}
        return [put(v) for v in x] if isinstance(x, list) else x

    return put(tree)


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """The one row (mean, std) that write_statistics has left."""
    return spark.read.schema("mean double, std double").parquet(path)
