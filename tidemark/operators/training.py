"""Training of the transformer as Spark jobs: gradients by partition, sums by a tree, moments as a table.

A step reads its batch where it lies: each task sums the gradients of its images and sends one vector, cut into chunks.
Chunks are summed FAN tasks at a time by key, so no task and not the driver gets all partitions' gradients. Parameters
and AdamW's moments are a table by chunk, written for each step; a killed run goes on after its last whole step.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.transformer import Weights, loss_and_gradients

CHUNK, FAN = 1 << 16, 32
STATE = "chunk int, params binary, m binary, v binary"


def flat(arrays: dict[str, np.ndarray]) -> np.ndarray:
    """The arrays as one vector, by name."""
    return np.concatenate([arrays[k].ravel() for k in sorted(arrays)])


def shaped(vector: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k], at = vector[at : at + like[k].size].reshape(like[k].shape), at + like[k].size
    return out


def _chunks(vector: np.ndarray) -> list[bytes]:
    return [vector[i : i + CHUNK].astype("<f8").tobytes() for i in range(0, len(vector), CHUNK)]


def initial(spark: SparkSession, weights: Weights) -> DataFrame:
    """(chunk, params, m, v) of a model before its first step."""
    return spark.createDataFrame([(i, c, bytes(len(c)), bytes(len(c))) for i, c in enumerate(_chunks(flat(weights.arrays)))], STATE)


def with_state(weights: Weights, state: DataFrame) -> Weights:
    """weights with the parameters of a state: a model of fixed size."""
    parts = [np.frombuffer(r.params, "<f8") for r in state.select("chunk", "params").orderBy("chunk").collect()]
    return dataclasses.replace(weights, arrays=shaped(np.concatenate(parts), weights.arrays))


def gradients(rows: DataFrame, pixels: str, target: str, weights: Weights, share: str | None = None, delta: float = 0.3) -> DataFrame:
    """(chunk, grad, loss, n): sums over the rows whose image and target aren't null. `share` weighs a row's loss (null
    as 1); without it rows weigh the same. An image for which the model's output isn't finite fails the job."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)  # a model of fixed size
    weight = F.lit(1.0) if share is None else F.coalesce(F.col(share).cast("double"), F.lit(1.0))
    source = rows.select(F.col(pixels).alias("x"), F.col(target).cast("double").alias("y"), weight.alias("share")).where("x IS NOT NULL AND y IS NOT NULL")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, total, loss, n = sent.value, None, 0.0, 0
        batch = w.at_once()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                some, grads = loss_and_gradients(np.stack(part["x"].to_numpy()).astype(np.float64), part["y"].to_numpy(), part["share"].to_numpy(), w, delta)
                total, loss, n = flat(grads) if total is None else total + flat(grads), loss + some, n + len(part)
        if n:
            parts = _chunks(total)
            yield pd.DataFrame({"slot": [TaskContext.get().partitionId()] * len(parts), "chunk": range(len(parts)), "grad": parts, "loss": loss, "n": n})

    found = source.mapInPandas(run, "slot int, chunk int, grad binary, loss double, n long")

    def add(t: pa.Table) -> pa.Table:
        grad = sum(np.frombuffer(x, "<f8") for x in t.sort_by("slot")["grad"].to_pylist())
        return pa.table({"slot": t["slot"][:1], "chunk": t["chunk"][:1], "grad": pa.array([grad.tobytes()], pa.binary()), "loss": [sum(t["loss"].to_pylist())], "n": [sum(t["n"].to_pylist())]})

    slots = source.rdd.getNumPartitions()
    while slots > 1:
        slots = -(-slots // FAN)
        found = found.withColumn("slot", F.floor(F.col("slot") / FAN).cast("int")).groupBy("slot", "chunk").applyInArrow(add, found.schema)
    return found.drop("slot")


def updated(state: DataFrame, grads: DataFrame, step: int, lr: float, decay: float = 1e-5, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8, clip: float | None = None) -> DataFrame:
    """The state after a step of AdamW (the first is step 1) along the mean gradient, with the step's loss (the mean) and n.

    `clip` bounds the mean gradient's length. Without rows nothing changes; loss is null then.
    """
    scale = 1.0
    if clip is not None:
        squares = grads.select("n", "grad").mapInPandas(lambda fs: (pd.DataFrame({"s": [float((np.frombuffer(g, "<f8") ** 2).sum()) / n**2 for g, n in zip(f["grad"], f["n"])]}) for f in fs), "s double")
        scale = min(1.0, clip / ((squares.agg(F.sum("s")).first()[0] or 0.0) ** 0.5 + 1e-6))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, r in frame.iterrows():
                if r["grad"] is None:
                    continue
                p, m, v, g = (np.frombuffer(r[c], "<f8") for c in ("params", "m", "v", "grad"))
                g = g / r["n"] * scale
                m, v = betas[0] * m + (1 - betas[0]) * g, betas[1] * v + (1 - betas[1]) * g * g
                p = p * (1 - lr * decay) - lr * (m / (1 - betas[0] ** step)) / (np.sqrt(v / (1 - betas[1] ** step)) + eps)
                frame.at[at, "params"], frame.at[at, "m"], frame.at[at, "v"] = p.tobytes(), m.tobytes(), v.tobytes()
            yield frame.drop(columns="grad")

    both = state.select("chunk", "params", "m", "v").join(grads.select("chunk", "grad", (F.col("loss") / F.col("n")).alias("loss"), "n"), "chunk", "left")
    return both.mapInPandas(run, f"{STATE}, loss double, n long")


def _whole(spark: SparkSession, path: str) -> bool:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def trained(rows: DataFrame, pixels: str, target: str, weights: Weights, path: str, steps: int, lr: float | Callable[[int], float], batch: Column | None = None, batches: int = 1, share: str | None = None, delta: float = 0.3, decay: float = 1e-5, clip: float | None = None) -> tuple[Weights, DataFrame]:
    """The weights after so many steps, and (step, loss, n) of each.

    Step s takes the rows whose `batch` (0 to batches - 1) is (s - 1) % batches; all rows without it. lr may depend on the
    step. Each step's state is a table below `path`; what is whole there is not computed again.
    """
    spark = rows.sparkSession
    state, log = initial(spark, weights), None
    for step in range(1, steps + 1):
        at = f"{path.rstrip('/')}/step={step}"
        if not _whole(spark, at):
            some = rows if batch is None else rows.where(batch == (step - 1) % batches)
            grads = gradients(some, pixels, target, with_state(weights, state), share, delta)
            updated(state, grads, step, lr(step) if callable(lr) else lr, decay, clip=clip).write.mode("overwrite").parquet(at)
        state = spark.read.schema(f"{STATE}, loss double, n long").parquet(at)
        row = state.where("chunk = 0").select(F.lit(step).alias("step"), "loss", F.coalesce("n", F.lit(0)).alias("n"))
        log = row if log is None else log.unionByName(row)
    return with_state(weights, state), log
