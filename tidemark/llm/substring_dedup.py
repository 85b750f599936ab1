"""Removal of repeated word passages, found by fixed-block anchors.

Each text is laid out in non-overlapping reference blocks of 18 words, counted from its start; a window of 35 words holds
a whole block wherever it lies. The blocks are indexed by hash, every rolling 18-word window of every text probes them,
and windows of 35 words over a hit are the candidates. These are compared among themselves: a window that starts in two
places is a repeat, and neighbouring repeats join to maximal ones.

Texts go in groups of bounded bytes. A group sends each bucket of hashes what it has once, however often it occurs, and
gets answers for itself alone; so a passage in a third of all texts costs a bucket one entry for each group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.blocks import OTHER, bucket_bounds, column_bytes, dealt, mixed, pieces, rolled, word_hashes

WINDOW = 35


def _rolling(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their texts, and the places and hashes of the n-word windows that lie in one text."""
    words, owner = word_hashes(texts)
    at = np.flatnonzero(owner[n - 1 :] == owner[: len(owner) - n + 1]) if len(owner) >= n else np.empty(0, np.int64)
    return words, owner, at, mixed(rolled(words, n))[at]


def _block_keys(texts: list[bytes], block: int) -> tuple[np.ndarray, ...]:
    words, owner, at, h = _rolling(texts, block)
    keys, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    first = np.searchsorted(owner, np.arange(len(texts)))
    indexed = np.bincount(inverse, (at - first[owner[at]]) % block == 0, len(keys)) > 0 if len(keys) else np.empty(0, bool)
    return words, owner, at, keys, inverse, counts, indexed


def _probe(table: pa.Table, block: int, buckets: int) -> pa.Table:
    """A group's windows for each bucket: 32 bits of each hash, whether it is of a reference block, whether it recurs here."""
    *_, keys, _, counts, indexed = _block_keys(table["data"].to_pylist(), block)
    bucket, ends = bucket_bounds(keys, buckets)
    low, flags = keys.astype("<u4"), (indexed + 2 * (counts > 1)).astype(np.uint8)
    parts = list(zip(ends[:-1], ends[1:]))
    return pa.table({"bucket": pa.array(bucket), "grp": pa.array(np.full(len(bucket), table["grp"][0].as_py(), np.int32)), "low": pa.array([low[a:b].tobytes() for a, b in parts], pa.binary()), "flags": pa.array([flags[a:b].tobytes() for a, b in parts], pa.binary())})


def _hits(table: pa.Table) -> pa.Table:
    """For each group, a bit for each of its windows: its words are a reference block somewhere and start twice or more."""
    low, sizes = column_bytes(table, "low", "<u4")
    flags, _ = column_bytes(table, "flags", np.uint8)
    keys, inverse = np.unique(low, return_inverse=True)
    times, indexed = np.bincount(inverse, 1 + (flags >> 1)), np.bincount(inverse, flags & 1)
    hit = ((times > 1) & (indexed > 0))[inverse]
    parts = np.split(hit, np.cumsum(sizes)[:-1])
    return pa.table({"grp": table["grp"], "bucket": table["bucket"], "bits": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())})


def _candidates(table: pa.Table, hits: pa.Table, block: int, window: int, buckets: int) -> pa.Table:
    """The windows over a hit, each once, for each bucket: 96 bits of hash, and whether it recurs in this group."""
    out = {"bucket": pa.array([], pa.int32()), "grp": pa.array([], pa.int32()), "high": pa.array([], pa.binary()), "low": pa.array([], pa.binary()), "again": pa.array([], pa.binary())}
    if not hits.num_rows or not table.num_rows:
        return pa.table(out)
    words, owner, at, keys, inverse, _, _ = _block_keys(table["data"].to_pylist(), block)
    bucket, ends = bucket_bounds(keys, buckets)
    bits = dict(zip(hits["bucket"].to_pylist(), hits["bits"].to_pylist()))
    hit = np.concatenate([np.unpackbits(np.frombuffer(bits[k], np.uint8), count=b - a) for k, a, b in zip(bucket.tolist(), ends[:-1], ends[1:])])
    over = np.zeros(len(words) + 1, np.int32)
    over[at[hit[inverse] > 0] + 1] = 1
    over = np.cumsum(over)
    high, low, places = _window_keys(words, owner, window)
    held = over[np.minimum(places + window - block + 1, len(words))] > over[places]
    high, low = high[held], low[held]
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])]) if len(high) else np.empty(0, np.int64)
    again = (np.diff(np.r_[new, len(high)]) > 1).astype(np.uint8)
    high, low = high[new], low[new]
    bucket, ends = bucket_bounds(high, buckets)
    parts = list(zip(ends[:-1], ends[1:]))
    held = {"high": high, "low": low, "again": again}
    return pa.table({"bucket": pa.array(bucket), "grp": pa.array(np.full(len(bucket), table["grp"][0].as_py(), np.int32))} | {k: pa.array([v[a:b].tobytes() for a, b in parts], pa.binary()) for k, v in held.items()})


def _window_keys(words: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    places = np.flatnonzero(owner[window - 1 :] == owner[: len(owner) - window + 1]) if len(owner) >= window else np.empty(0, np.int64)
    return mixed(rolled(words, window))[places], (mixed(rolled(words, window, OTHER))[places] >> np.uint64(32)).astype("<u4"), places


def _repeats(table: pa.Table) -> pa.Table:
    """For each group, those of its candidates that start in two places or more."""
    high, sizes = column_bytes(table, "high", "<u8")
    low, _ = column_bytes(table, "low", "<u4")
    again, _ = column_bytes(table, "again", np.uint8)
    order = np.lexsort((low, high))
    same = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
    repeat = again > 0
    repeat[order[1:]] |= same
    repeat[order[:-1]] |= same
    parts = [slice(b - n, b) for b, n in zip(np.cumsum(sizes), sizes)]
    return pa.table({"grp": table["grp"], "high": pa.array([high[p][repeat[p]].tobytes() for p in parts], pa.binary()), "low": pa.array([low[p][repeat[p]].tobytes() for p in parts], pa.binary())})


def _kept(table: pa.Table, repeats: pa.Table, window: int, with_text: bool) -> pa.Table:
    texts = table["data"].to_pylist()
    high, _ = column_bytes(repeats, "high", "<u8")
    low, _ = column_bytes(repeats, "low", "<u4")
    covered, first = None, None
    if len(high):
        words, owner = word_hashes(texts)
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        a, b, places = _window_keys(words, owner, window)
        spot, last = np.searchsorted(high, a), np.searchsorted(high, a, "right")
        found = np.zeros(len(a), bool)
        while (open_ := np.flatnonzero(~found & (spot < last))).size:  # equal high halves stand side by side
            found[open_] = low[spot[open_]] == b[open_]
            spot[open_] += 1
        cover = np.zeros(len(words) + 1, np.int32)
        cover[places[found]] += 1
        cover[places[found] + window] -= 1
        covered = np.cumsum(cover[:-1]) > 0
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
    rows = []
    for i, text in enumerate(texts):
        n, gone, digest, out = 0, 0, hashlib.sha256(), []
        for _, part in pieces([text]):
            words = part.split()
            keep = words
            if covered is not None and (mask := covered[first[i] + n : first[i] + n + len(words)]).any():
                keep = [w for w, x in zip(words, mask.tolist()) if not x]
            joined = b" ".join(keep)
            if joined:
                digest.update(b" " * (n > gone) + joined)
                out.append(joined)
            n, gone = n + len(words), gone + len(words) - len(keep)
        rows.append((n, gone, digest.hexdigest(), b" ".join(out).decode("utf-8", "replace") if with_text else None))
    n, gone, sha, kept = zip(*rows)
    found = {"id": table["id"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
    return pa.table(found | ({"kept": pa.array(kept, pa.string())} if with_text else {}))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256[, kept]) for each row.

    A word goes if a window of `window` words over it has the same words as one that starts anywhere else, in this text
    or another; windows never cross texts and are judged on the input. Kept words are joined by one space. A null or
    empty text has no words; a text shorter than the window keeps all; a repeated row is another text, so it counts.
    """
    block = (window + 1) // 2
    texts, groups = dealt(docs, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()
    by_group = texts.groupBy("grp")
    probes = by_group.applyInArrow(lambda t: _probe(t, block, groups), "bucket int, grp int, low binary, flags binary")
    hits = probes.groupBy("bucket").applyInArrow(_hits, "grp int, bucket int, bits binary")
    schema = "bucket int, grp int, high binary, low binary, again binary"
    windows = by_group.cogroup(hits.groupBy("grp")).applyInArrow(lambda t, h: _candidates(t, h, block, window, groups), schema)
    repeats = windows.groupBy("bucket").applyInArrow(_repeats, "grp int, high binary, low binary")
    out = by_group.cogroup(repeats.groupBy("grp")).applyInArrow(lambda t, r: _kept(t, r, window, with_text), f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
    return out.withColumnRenamed("id", id_col)
