"""Targets paired with observations: time grids, exact and nearest joins, anti joins for what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def grid(spark: SparkSession, start: str, end: str, seconds: int) -> DataFrame:
    """(ts): every `seconds` from start, end left out."""
    steps = F.floor(F.timestamp_diff("SECOND", F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")) / seconds)
    n = spark.range(1).select(steps.alias("n")).where("n > 0")
    return n.select(F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("i")).select(F.timestamp_add("SECOND", F.col("i") * seconds, F.lit(start).cast("timestamp_ntz")).alias("ts"))


def mean_of_sources(targets: DataFrame, readings: DataFrame, on: str, source: str, value: str) -> DataFrame:
    """(on, value, sources): each target with the mean of its sources' readings, which are averaged within a source
    first, and the sources listed from the last to the first. Null readings don't count; targets without any go."""
    each = readings.where(F.col(value).isNotNull()).groupBy(on, source).agg(F.avg(value).alias(value))
    both = each.join(targets.select(on).distinct(), on, "left_semi")
    names = F.array_join(F.sort_array(F.collect_list(F.col(source).cast("string")), asc=False), ",")  # a row for each source
    return both.groupBy(on).agg(F.avg(value).alias(value), names.alias("sources"))


def nearest(targets: DataFrame, frames: DataFrame, channels: DataFrame, on: str, channel: str, seconds: int, bad: str, tie: str) -> DataFrame:
    """The nearest frame of each channel to each target within `seconds` (closed); good frames go before bad ones, then
    the smaller distance, then the earlier frame, then the smaller tie column. Targets and channels without a frame are
    left out. Frames and targets meet in time buckets as wide as the tolerance, so the join is one by equal keys.
    """
    width = F.lit(seconds)
    bucket = lambda c: F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c) / width)
    left = targets.select(F.col(on).alias("target")).crossJoin(F.broadcast(channels.select(channel)))  # a handful of channels
    left = left.withColumn("bucket", F.explode(F.array(*(bucket(F.col("target")) + d for d in (-1, 0, 1)))))
    right = frames.withColumn("bucket", bucket(F.col(on)))
    distance = F.abs(F.timestamp_diff("MICROSECOND", F.col("target"), F.col(on)))
    found = left.join(right, [channel, "bucket"]).withColumn("distance_us", distance).where(F.col("distance_us") <= seconds * 1_000_000)
    rank = F.row_number().over(Window.partitionBy("target", channel).orderBy(F.coalesce(F.col(bad), F.lit(False)), F.col("distance_us").asc_nulls_last(), on, tie))
    return found.withColumn("rank", rank).where("rank = 1").drop("rank", "bucket")


def missing_channels(targets: DataFrame, channels: DataFrame, found: DataFrame, on: str, channel: str) -> DataFrame:
    """(target, channel) pairs without a frame."""
    wanted = targets.select(F.col(on).alias("target")).crossJoin(F.broadcast(channels.select(channel)))
    return wanted.join(found.select("target", channel), ["target", channel], "left_anti")


def complete_keys(files: DataFrame, key: str, part: str, parts: int) -> DataFrame:
    """(key): keys that occur with all of so many parts."""
    return files.groupBy(key).agg(F.count_distinct(part).alias("n")).where(F.col("n") == parts).select(key)


def not_done(wanted: DataFrame, done: DataFrame, key: str, parts: int | None = None, part: str | None = None) -> DataFrame:
    """Rows of wanted whose key isn't done; with parts, a key is done when all its parts are."""
    return wanted.join(done if parts is None else complete_keys(done, key, part, parts), key, "left_anti")


def overlaid(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the values of new that aren't null, by key; keys of old only stay."""
    cols = [c for c in old.columns if c != key]
    both = old.join(new.select(key, *(F.col(c).alias(f"__{c}") for c in cols if c in new.columns)), key, "left")
    return both.select(key, *(F.coalesce(f"__{c}", c).alias(c) if c in new.columns else F.col(c) for c in cols))


def one_file_each(rows: DataFrame, source: str, file: str) -> DataFrame:
    """The rows of each source's first file by name."""
    first = rows.groupBy(source).agg(F.min(file).alias(file))
    return rows.join(first, [source, file], "left_semi")
