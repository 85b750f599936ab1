"""Exact top-k search by inner product over a bit-sliced index.

Vectors are quantised to integers and dealt into blocks. A block keeps, for each attribute and each bit of its offset
values, one bitmap over the block's rows. A query's scores over a block are the weighted sum of the attributes' slices,
added with carry-save bitmap arithmetic; the sum again is a stack of slices. The best k are taken from the most
significant slice downward, and rows that tie on all slices at the boundary are settled by the smaller id. Blocks'
winners, k a block, meet in one ranking for each query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of an index block, and queries that are put to it at a time.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 1024
INDEX = "block int, dims int, ids binary, lows binary, slices binary"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(id, q array<long>): floor(scale * x) for each component x. Null vectors and those with a null or non-finite
    component are left out; so are null ids."""
    x = F.col(vec_col)
    sound = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("q"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), np.int64).reshape(len(flat), len(flat.flatten()) // max(1, len(flat)))


def _build(table: pa.Table) -> pa.Table:
    """One index row: ids in ascending order, the least value of each attribute, and the slices of what exceeds it."""
    ids, q = np.asarray(table["id"]), _matrix(table["q"])
    order = np.argsort(ids, kind="stable")
    ids, q = ids[order], q[order]
    lows = q.min(axis=0)
    over, rows = (q - lows).T.copy(), -(-len(ids) // 64) * 64
    bits = int(over.max(initial=0)).bit_length()
    slices = np.zeros((bits, q.shape[1], rows), bool)
    for b in range(bits):
        slices[b, :, : len(ids)] = (over >> b) & 1
    packed = np.packbits(slices, axis=2, bitorder="little")
    return pa.table({"block": table["block"][:1], "dims": pa.array([q.shape[1]], pa.int32()), "ids": [ids.tobytes()], "lows": [lows.tobytes()], "slices": [packed.tobytes()]})


def index(q: DataFrame, blocks: int) -> DataFrame:
    """The bit-sliced index: a row for each block and number of dimensions, every vector in one of them."""
    dealt = q.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.size("q").alias("dims"), "id", "q")
    return dealt.groupBy("block", "dims").applyInArrow(_build, INDEX)


def _added(planes: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """The slices of a sum, least significant first. planes: bitmaps by the power of two that they count."""
    out, at = [], 0
    while any(k >= at for k in planes):
        held = planes.pop(at, [])
        stack = np.concatenate(held) if held else np.zeros((0, 0), np.uint64)
        while len(stack) > 1:
            third = len(stack) // 3
            if third:
                a, b, c, rest = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third], stack[3 * third :]
                half = a ^ b
                carry, stack = (a & b) | (half & c), np.concatenate([half ^ c, rest])
            else:
                carry, stack = stack[:1] & stack[1:], stack[:1] ^ stack[1:]
            planes.setdefault(at + 1, []).append(carry)
        out.append(stack[0] if len(stack) else None)
        at += 1
    return out


def _scores(query: np.ndarray, slices: np.ndarray, lows: np.ndarray) -> tuple[list[np.ndarray], int]:
    """The slices of the query's scores over a block, and the number to be added to each."""
    bits, negative = len(slices), query < 0
    turned = slices ^ np.where(negative, np.uint64(2**64 - 1), np.uint64(0))[:, None]  # -x = (2^bits - 1 - x) - (2^bits - 1)
    size, planes = np.abs(query), {}
    for j in range(int(size.max(initial=0)).bit_length()):
        dims = np.flatnonzero((size >> j) & 1)
        for b in range(bits if len(dims) else 0):
            planes.setdefault(j + b, []).append(turned[b, dims])
    plus = sum(int(x) * (int(low) + (2**bits - 1 if x < 0 else 0)) for x, low in zip(query.tolist(), lows.tolist()))
    return _added(planes), plus


def _best(sums: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k greatest, the smaller position first among equals."""
    sure, maybe = np.zeros_like(among), among
    for s in reversed(sums):
        s = np.zeros_like(among) if s is None else s
        more = sure | (maybe & s)
        n = int(np.bitwise_count(more).sum())
        if n > k:
            maybe = maybe & s
        else:
            sure, maybe = more, maybe & ~s
            if n == k:
                break
    found, tied = (np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little")) for x in (sure, maybe))
    return np.r_[found, tied[: k - len(found)]]


def _searched(held: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    out: list[tuple[int, int, int]] = []
    if held.num_rows and asked.num_rows:
        ids, lows = (np.frombuffer(held[c][0].as_py(), np.int64) for c in ("ids", "lows"))
        words = -(-len(ids) // 64)
        slices = np.frombuffer(held["slices"][0].as_py(), np.uint64)
        slices = slices.reshape(len(slices) // max(1, len(lows) * words), len(lows), words)
        every = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view(np.uint64)
        for own, query in zip(asked["id"].to_pylist(), _matrix(asked["q"])):
            sums, plus = _scores(query, slices, lows)
            among = every & ~np.packbits(np.r_[ids == own, np.zeros(words * 64 - len(ids), bool)], bitorder="little").view(np.uint64)
            rows = _best(sums, among, k)
            totals = [sum(int(s[r >> 6] >> np.uint64(r & 63)) % 2 << i for i, s in enumerate(sums) if s is not None) + plus for r in rows.tolist()]
            out += zip([own] * len(rows), ids[rows].tolist(), totals)
    return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k greatest integer inner products, ties to the smaller id.

    Both tables go in blocks, each block of queries to each block of the index. Rows with a query's id are its own and no
    candidates; only vectors of as many components are compared. Scores must fit a long. Fewer candidates than k give
    fewer rows; empty tables none.
    """
    q, asked = quantised(vectors, id_col, vec_col, scale), quantised(queries, id_col, vec_col, scale).dropDuplicates(["id"])
    blocks, query_blocks = max(1, -(-q.count() // BLOCK_ROWS)), max(1, -(-asked.count() // BLOCK_QUERIES))
    held = index(q, blocks).withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    dealt = asked.select(F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("asked"), F.size("q").alias("dims"), "id", "q").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["block", "dims", "asked"]
    found = held.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(lambda a, b: _searched(a, b, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
