"""Patch grids: neighbourhood masks and reductions of attention over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = ("none", "local", "inverted")
#: Images that a task takes at once.
IMAGES = 256


def neighbours(spark: SparkSession, side: int, window: int) -> DataFrame:
    """(query, key): patches of a side x side grid at most window // 2 rows and columns apart. Each patch makes its
    window's offsets; pairs of far patches never exist."""
    r = window // 2
    offsets = F.explode(F.sequence(F.lit(-r), F.lit(r)))
    cells = spark.range(side * side).select(F.col("id").alias("query"), F.floor(F.col("id") / side).alias("row"), (F.col("id") % side).alias("col"))
    near = cells.select("*", offsets.alias("dr")).select("*", offsets.alias("dc"))
    row, col = F.col("row") + F.col("dr"), F.col("col") + F.col("dc")
    return near.where(row.between(0, side - 1) & col.between(0, side - 1)).select("query", (row * side + col).alias("key"))


def mask_rows(spark: SparkSession, side: int, window: int, mode: str) -> DataFrame:
    """(query, n_masked): how many keys a query may not see. `inverted` hides its neighbours, `local` all others."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    local = neighbours(spark, side, window).groupBy("query").agg(F.count("*").alias("n"))
    hidden = {"none": F.lit(0), "inverted": F.col("n"), "local": F.lit(side * side) - F.col("n")}[mode]
    return local.select("query", hidden.cast("long").alias("n_masked"))


def received(attention: DataFrame, sample: str = "sample", key: str = "key", weight: str = "weight") -> DataFrame:
    """(sample, key, weight): mean over heads and queries of the weight that each key receives."""
    return attention.groupBy(sample, key).agg(F.avg(weight).alias(weight))


def placed(flat: DataFrame, index: str, width: int) -> DataFrame:
    """flat with row and col of a flat index."""
    return flat.withColumns({"row": F.floor(F.col(index) / width).cast("long"), "col": (F.col(index) % width).cast("long")})


def neighbourhood_means(rows: DataFrame, key: str, values: str, side: int, window: int) -> DataFrame:
    """(key, patch, n_near, near, far): for each patch of an image the number of patches at most window // 2 rows and columns
    away, itself included, the mean over them, and the mean over all others (null if there are none).

    Two running sums make a table in which a window is four look-ups and the rest is the total less the window, so no pair
    of patches is made. Images that are null or of another size give no rows; one with a null or not-a-number gives what
    sums with not-a-number give.
    """
    r = window // 2
    low, high = np.maximum(np.arange(side) - r, 0), np.minimum(np.arange(side) + r + 1, side)
    n = np.outer(high - low, high - low)
    source = rows.select(key, F.col(values).cast("array<double>").alias("__values")).where(F.size("__values") == side * side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, IMAGES) for b in batches for i in range(0, b.num_rows, IMAGES)):
            x = np.array([[np.nan if v is None else v for v in a] for a in batch.column(1).to_pylist()], float).reshape(-1, side, side)
            sums = np.zeros((len(x), side + 1, side + 1))
            sums[:, 1:, 1:] = x.cumsum(axis=1).cumsum(axis=2)
            near = sums[:, high][:, :, high] - sums[:, low][:, :, high] - sums[:, high][:, :, low] + sums[:, low][:, :, low]
            far = sums[:, -1:, -1:] - near
            with np.errstate(divide="ignore", invalid="ignore"):
                far = np.where(n < side * side, far / (side * side - n), np.nan)
            owner = np.repeat(np.arange(len(x)), side * side)
            flat = lambda a: np.broadcast_to(a, x.shape).ravel()
            hole = flat(n == side * side)
            yield pa.record_batch([batch.column(0).take(pa.array(owner)), pa.array(np.tile(np.arange(side * side), len(x)), pa.int32()), pa.array(flat(n), pa.int64()), pa.array(flat(near / n)), pa.array(flat(far), mask=hole)], names=[key, "patch", "n_near", "near", "far"])

    return source.mapInArrow(run, f"{key} {source.schema[key].dataType.simpleString()}, patch int, n_near long, near double, far double")
