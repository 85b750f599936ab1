"""The engine's roles played by generic tables: events as sensor series, embeddings as images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, sat, user_id, flux, k): a flux for each event, and a number from its properties."""
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("sat"), "user_id", (F.col("value") * F.lit(1e-6)).alias("flux"), F.get_json_object("props", "$.k").try_cast("int").alias("k"))


#: The same in SQL, for the oracles.
SERIES = "s AS (SELECT event_id, ts, event_type AS sat, user_id, value * 1e-6 AS flux, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, sat, truth, pred): the prediction is the value that the same user had before."""
    from pyspark.sql import Window

    before = F.lag("flux").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return series(spark, sf_dir).withColumn("pred", before).where(F.col("pred").isNotNull()).select("event_id", "ts", "sat", F.col("flux").alias("truth"), "pred")


PAIRS = SERIES + ", p AS (SELECT * FROM (SELECT event_id, ts, sat, flux AS truth, lag(flux) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pred FROM s) WHERE pred IS NOT NULL)"
