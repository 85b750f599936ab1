"""Splits, samples, chunks and mini-batches that depend on keys and not on chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import in_part


def split_of(ts: Column, ranges: dict[str, tuple[str, str]] | None = None) -> Column:
    """The split of a time: the first of train, val and test whose days hold it (the last day whole), null if none
    does; without ranges August is test, January to March val, the rest train."""
    if not ranges:
        return F.when(F.month(ts) == 8, "test").when(F.month(ts).between(1, 3), "val").otherwise("train")
    out = F.lit(None).cast("string")
    for name in ("test", "val", "train"):
        if name in ranges:
            start, end = ranges[name]
            out = F.when((ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.timestamp_add("DAY", F.lit(1), F.lit(end).cast("timestamp_ntz"))), name).otherwise(out)
    return out


def alias_of(split: Column) -> Column:
    """validation and val are one; other names stay."""
    return F.when(split == "validation", "val").otherwise(split)


def sample(rows: DataFrame, key: str, seed: str, n: int | None = None, fraction: float | None = None) -> DataFrame:
    """n rows (or a fraction, one at least; or all) in an order that key and seed decide, with their place in it."""
    if n is None and fraction is not None:
        n = max(1, int(rows.count() * fraction))
    mark = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(seed)).cast("binary"))
    marked = rows.withColumn("mark", mark).orderBy("mark", key)
    return marked if n is None else marked.limit(n)


def chunk_size(n: int, processes: int, per_process: int, least: int) -> int:
    """Rows of a chunk: an even share for so many chunks a process, but not under `least`."""
    processes = min(processes, max(1, n // 100))
    return max(least, n // (processes * per_process))


def numbered(rows: DataFrame, by: str | None, order: str, part: Column | None = None) -> DataFrame:
    """rows with number: 0, 1, 2 and so on in order within `by`, or over all rows.

    `part` is a range of the order; rows are numbered within it, and the parts' counts add up over a table with a row for
    each. Without it a value of `by` is one task's work, so numbers over all rows need it.
    """
    if part is None:
        if by is None:
            raise ValueError("numbers over all rows need parts")
        return rows.withColumn("number", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)
    marked = rows.withColumn("__part", in_part(by, part))
    earlier = Window.partitionBy("__part.by").orderBy("__part.range").rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return marked.join(counts, "__part").select(*rows.columns, (within + F.col("__n")).alias("number"))


def batched(rows: DataFrame, by: str | None, order: str, size: int, part: Column | None = None) -> DataFrame:
    """rows with batch: so many rows each, in order within `by`; for `part` see numbered."""
    return numbered(rows, by, order, part).withColumn("batch", F.floor(F.col("number") / size).cast("long")).drop("number")
