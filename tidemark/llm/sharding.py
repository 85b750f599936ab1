"""Sharding by fixed virtual slots.

Every record hashes into one of a fixed number of slots. Bytes are summed per slot, slots are dealt out to shards largest
first, each to the shard that holds least, and the map from slots to shards is stored under a version. Rebalancing edits
the map into the next version and moves whole slots only; records never hash anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 8192
#: Bytes that a record counts besides its text.
OVERHEAD = 16
MAP = "vslot int, shard int, bytes long, n long, version int"


def records(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, vslot) of each row. A null text has no bytes; repeated rows share a slot."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    return docs.select(id_col, (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), crc.cast("long").alias("text_crc32")).withColumn("vslot", F.pmod(F.xxhash64(id_col, "text_crc32"), F.lit(slots)).cast("int"))


def slot_loads(rows: DataFrame) -> DataFrame:
    """(vslot, bytes, n): at most one row for each slot."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def _dealt(shards: int) -> Column:
    """The shard of each element of `largest`, dealt in that order to the shard that holds least."""
    least = lambda held: F.array_position(held, F.array_min(held)).cast("int") - 1

    def step(acc: Column, x: Column) -> Column:
        to = least(acc["held"])
        held = F.transform(acc["held"], lambda v, i: F.when(i == to, v + x["bytes"]).otherwise(v))
        return F.struct(held.alias("held"), F.concat(acc["shards"], F.array(to)).alias("shards"))

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("held"), F.array().cast("array<int>").alias("shards"))
    return F.aggregate("largest", start, step, lambda acc: acc["shards"])


def first_map(loads: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """(version, vslot, shard, bytes, n). It is worked out over one row that holds the fixed number of slots."""
    largest = loads.agg(F.sort_array(F.collect_list(F.struct("bytes", "vslot", "n")), asc=False).alias("largest"))
    dealt = largest.select(F.explode(F.arrays_zip("largest", _dealt(shards).alias("to"))).alias("x"))
    return dealt.select(F.lit(version).alias("version"), "x.largest.vslot", F.col("x.to").alias("shard"), "x.largest.bytes", "x.largest.n")


def grown_map(current: DataFrame, shards: int) -> DataFrame:
    """The next version, for one shard more: each old shard hands over slots of at most its even share, others stay."""
    per, order = Window.partitionBy("shard"), Window.partitionBy("shard").orderBy(F.xxhash64("vslot", "version"))
    moves = F.sum("bytes").over(order) * (shards + 1) <= F.sum("bytes").over(per)
    return current.select((F.col("version") + 1).alias("version"), "vslot", F.when(moves, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"), "bytes", "n")


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored map; versions already there stay as they are."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the stored map, the latest if none is named."""
    stored = spark.read.schema(MAP).parquet(path)
    version = stored.agg(F.max("version")).first()[0] if version is None else version
    return stored.where(F.col("version").eqNullSafe(F.lit(version)))


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """rows with shard and slot, a gapless position from 0 in the shard.

    Positions start at the rows of the shard's earlier virtual slots and count on within the virtual slot, so no task
    orders more than one virtual slot. The map has one row for each of the fixed number of slots.
    """
    order = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, 0)
    begins = slot_map.select("vslot", "shard", (F.sum("n").over(order) - F.col("n")).alias("begin"))
    within = F.row_number().over(Window.partitionBy("vslot").orderBy(*(c for c in rows.columns if c != "vslot")))
    return rows.withColumn("within", within).join(F.broadcast(begins), "vslot").withColumn("slot", F.col("begin") + F.col("within") - 1).drop("begin", "within", "vslot")


def shard(docs: DataFrame, path: str, shards: int = 40, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its shard, by near-equal bytes; the map is stored at `path` as version 1.

    A shard's bytes differ from another's by about the bytes of a small slot, unless one record outweighs that. Empty
    tables give an empty result; null ids hash by their text; repeated rows are kept, each with its own position.
    """
    rows = records(docs, slots, id_col, text_col)
    store_map(first_map(slot_loads(rows), shards), path)
    return assign(rows, load_map(docs.sparkSession, path, 1))
