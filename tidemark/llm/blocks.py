"""Texts dealt into groups of bounded size, and vectorised hashes over them; for the operators that look for repeats."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import shuffle_width, utf8

#: Text bytes that a group is meant to hold, and that are hashed at a time.
GROUP_BYTES, PIECE = 4 << 20, 1 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 4096
BASE = 0x9E3779B97F4A7C15
OTHER = 0xD6E8FEB86659FD93
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
_SPACES = re.compile(rb"[ \t\n\v\f\r]")


def dealt(docs: DataFrame, id_col: str, text_col: str, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, int]:
    """(grp, id, data) with each row in one of the groups, and how many groups there are; texts are UTF-8 bytes."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    data = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("data"))
    grp = F.pmod(F.xxhash64("id", F.length("data")), F.lit(groups)).cast("int")
    return data.select(grp.alias("grp"), "id", F.coalesce("data", F.lit(b"")).alias("data")), groups


def parts(spark: SparkSession, groups: int) -> int:
    """Shuffle partitions for so many groups or buckets, which each take a task some seconds."""
    return max(shuffle_width(spark), min(groups, 50_000))


def mixed(x: np.ndarray) -> np.ndarray:
    """x with every bit depending on all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


def rolled(h: np.ndarray, n: int, base: int = BASE) -> np.ndarray:
    """A polynomial hash of each n consecutive elements."""
    out, length, step, size = None, 0, h, 1
    if len(h) < n:
        return h[:0]
    while n:
        if n & 1:
            if out is None:
                out = step
            else:
                m = min(len(out), len(step) - length)
                out = out[:m] + np.uint64(pow(base, length, 1 << 64)) * step[length : length + m]
            length += size
        n >>= 1
        if n:
            step = step[:-size] + np.uint64(pow(base, size, 1 << 64)) * step[size:]
            size *= 2
    return out


def pieces(texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(index of the text, a piece of it) in order; a long text is cut at white space."""
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > PIECE and (cut := _SPACES.search(text, at + PIECE)):
            yield i, text[at : cut.start()]
            at = cut.start()
        yield i, text[at:] if at else text


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words `[^\\x20\\x09-\\x0D]+` in order, and which text each is of."""
    found, owner, held, size = [], [], [], 0

    def take() -> None:
        if held:
            h, starts, _ = words_of(b" ".join(p for _, p in held))
            offsets = np.cumsum([0, *(len(p) + 1 for _, p in held)])
            found.append(h)
            owner.append(np.array([i for i, _ in held], np.int32)[np.searchsorted(offsets, starts, "right") - 1])
            held.clear()

    for i, piece in pieces(texts):
        held.append((i, piece))
        size += len(piece)
        if size >= PIECE:
            take()
            size = 0
    take()
    return (np.concatenate(found), np.concatenate(owner)) if found else (np.empty(0, np.uint64), np.empty(0, np.int32))


def words_of(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of a block's words, and where they start and end."""
    inside = np.r_[False, ~_SPACE[np.frombuffer(block, np.uint8)], False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return slice_hashes(block, edges[::2], edges[1::2]), edges[::2], edges[1::2]


def eights(block: bytes) -> np.ndarray:
    """The eight bytes from each place of the block, as one number; zeros follow its end."""
    return np.ndarray((len(block) + 1,), "<u8", buffer=block + bytes(8), strides=(1,))


def slice_hashes(block: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each slice, taken in eight at a time."""
    lengths, at = ends - starts, 0
    h, words = mixed(lengths.astype(np.uint64) + np.uint64(BASE)), eights(block)
    live = np.flatnonzero(lengths <= LONG_WORD)
    while len(live):
        h[live] = mixed(h[live] * np.uint64(OTHER) ^ (words[starts[live] + at] & _mask(lengths[live] - at)))
        live = live[lengths[live] > at + 8]
        at += 8
    for i in np.flatnonzero(lengths > LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(block[starts[i] : ends[i]])
    return h


def _mask(left: np.ndarray) -> np.ndarray:
    return ~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * np.clip(left, 1, 8).astype(np.uint64))


def same_slices(block: bytes, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Whether each slice has the same bytes as slice number like[i]."""
    lengths, at, words = ends - starts, 0, eights(block)
    same = lengths == lengths[like]
    live = np.flatnonzero(same & (lengths <= LONG_WORD))
    while len(live):
        x, y = words[starts[live] + at], words[starts[like[live]] + at]
        same[live] &= ((x ^ y) & _mask(lengths[live] - at)) == 0
        live = live[lengths[live] > at + 8]
        at += 8
    for i in np.flatnonzero(same & (lengths > LONG_WORD)):
        same[i] = block[starts[i] : ends[i]] == block[starts[like[i]] : ends[like[i]]]
    return same


def bucket_bounds(sorted_hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that hold any of the hashes, and where each begins and the last ends. Buckets follow the hashes' order."""
    bucket = ((sorted_hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
    return bucket[starts].astype(np.int32), np.r_[starts, len(bucket)]


def column_bytes(table: pa.Table, name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The arrays in a binary column's rows one after another, and how long each is."""
    rows = [np.frombuffer(x.as_py(), kind) for x in table[name]]
    return (np.concatenate(rows) if rows else np.empty(0, kind)), np.array([len(r) for r in rows], np.int64)
