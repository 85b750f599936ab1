"""Loss sums, class weights within batches, and per-batch class errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.flux import huber


def losses(rows: DataFrame, error: str, by: list[str] | None = None, delta: float = 0.3) -> DataFrame:
    """(huber, mse, mae, rmse) of an error column, overall or by group."""
    e = F.col(error)
    return rows.groupBy(*(by or [])).agg(F.avg(huber(e, delta)).alias("huber"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def batch_weights(rows: DataFrame, batch: str, weight: str) -> DataFrame:
    """rows with `share`: the weight over the mean weight of its batch."""
    return rows.withColumn("share", F.try_divide(F.col(weight), F.avg(weight).over(Window.partitionBy(batch))))


def class_errors(rows: DataFrame, batch: str, cls: str, error: str) -> DataFrame:
    """(batch, class, error): the mean error of each class in each batch that has it."""
    return rows.groupBy(batch, cls).agg(F.avg(error).alias(error))


def epoch_means(log: DataFrame, epoch: str, metrics: list[str]) -> DataFrame:
    """(epoch, steps, metrics): the means of step metrics by epoch; null steps don't count in a mean."""
    return log.groupBy(epoch).agg(F.count("*").alias("steps"), *(F.avg(m).alias(m) for m in metrics))
