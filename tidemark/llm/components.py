"""Connected components of a large graph by alternating star contractions; a small one is folded at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.llm.common import cut

#: A key with more than this share of all rows is hot, so there are fewer than 1 / SHARE such keys; but FEW rows never are.
SHARE, FEW = 0.001, 256
#: A graph of at most so many edges (4 MB) needs no rounds.
SMALL = 1 << 18


def _most(total: int) -> int:
    """Rows that a key may have without being hot."""
    return max(FEW, int(total * SHARE))


def joined(rows: DataFrame, of_key: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the columns of of_key, which has one row for each key and in `times` how many of the `total` rows have it.

    A key with a large share of all rows would meet in one task of a shuffle, so the hot keys (at most 1 / SHARE, whatever
    the input) are broadcast, and only rows of other keys are shuffled. Rows without a match go.
    """
    limit = _most(total)
    hot = of_key.where(F.col("times") > limit).withColumn("__hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), key, "left")
    rest = marked.where("__hot IS NULL").select(rows.columns).join(of_key.where(F.col("times") <= limit), key)
    return marked.where("__hot").drop("__hot").unionByName(rest).drop("times")


def _large_star(edges: DataFrame, count: int, hot: bool) -> DataFrame:
    """Each node's larger neighbours are tied to the least node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("times"))
    larger = both.where("v > u")
    return (joined(larger, least, "u", 2 * count) if hot else larger.join(least, "u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, count: int, hot: bool) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of these. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("times"))
    tied = (joined(edges, least, "u", count) if hot else edges.join(least, "u")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a graph in order, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _folded(edges: DataFrame) -> DataFrame:
    """(node, root) of a graph of at most SMALL edges, in one task of a few MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
        if held:
            nodes, roots = roots_of(*map(np.concatenate, zip(*held)))
            yield pa.record_batch([pa.array(nodes), pa.array(roots)], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that an edge touches; root is the least node of its component.

    Nulls and loops are left out. Each round halves the depth or better; its result goes to the shared folder. Minima are
    combined before they are shuffled, and a star's centre with a large share of the edges is never a key of a shuffle.
    A round costs several stages however few edges there are, so a graph of at most SMALL edges between longs is folded
    in one task instead; a larger one never is.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    if now.schema["u"].dataType == LongType() and now.count() <= SMALL:
        return _folded(now)
    for _ in range(most_rounds):
        count, unfinished, most = _state(now)
        if not unfinished:
            break
        hot = most > _most(count)  # a star's centre may keep its edges, or get them, in either step
        now = cut(_small_star(_large_star(now, count, hot), count, hot))
    else:
        raise RuntimeError("components: no fixed point")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple[int, int, int]:
    """How many edges there are, how many nodes still keep them from being stars whose centres are least, and the most
    edges of a node."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("x").agg(F.sum("as_u").alias("as_u"), F.sum("as_v").alias("as_v"))
    found = nodes.agg(F.sum("as_u"), F.count_if((F.col("as_u") > 1) | ((F.col("as_u") > 0) & (F.col("as_v") > 0))), F.max(F.col("as_u") + F.col("as_v"))).first()
    return found[0] or 0, found[1], found[2] or 0
