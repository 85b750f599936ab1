"""SimHash near-duplicates: fingerprints, their links within a Hamming radius, and the groups these make.

Fingerprints are linked by a segment-popcount embedding. A fingerprint's 64 bits form 32 segments of two bits; the vector
of bit counts per segment (each 0, 1 or 2) is kept packed in one long in unary code. Manhattan distance between vectors
never exceeds Hamming distance between fingerprints, so a radius in the first bounds the second. The grid deals the 32
coordinates into `blocks` groups: a Manhattan distance of r leaves at least blocks - r groups untouched, so two
fingerprints within r share a cell of some grid over blocks - r groups. In each cell the Manhattan bound is applied, and
what passes is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, utf8, word_blocks
from tidemark.llm.components import components, joined

SEED = 42
ODD = 0x5555555555555555
#: Cells of up to so many fingerprints are compared by offsets, all cells at once.
LARGE_CELL = 1024
#: Shingles hashed at a time.
HASHED = 65_536


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """The SimHash of a text's word shingles as a signed long; zero for a text without words."""
    ones, total, carry = np.zeros(64, np.int64), 0, []
    first = True
    for words in word_blocks(data.lower()):
        words = carry + words
        for at in range(0, len(words) - shingle + 1, HASHED):
            part = words[at : at + HASHED + shingle - 1]
            ones += _ones(part, shingle)
            total += len(part) - shingle + 1
        first &= len(words) < shingle
        carry = words[-(shingle - 1) :] if shingle > 1 else []
    if first and carry:
        total, ones = 1, _ones(carry, len(carry))
    bits = np.packbits(ones * 2 > total)
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def _ones(words: list[bytes], n: int) -> np.ndarray:
    """How many of the shingles' hashes have each bit, most significant first."""
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - n] + 1).tolist()]
    digests = b"".join([xxhash.xxh64_digest(joined[s:e], SEED) for s, e in zip(starts, ends[n - 1 :].tolist())])
    return np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, simhash long) for each row. Null and wordless texts get zero; repeated rows stay repeated."""
    source = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("data"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py() or b"", shingle) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.int64())], names=["id", "simhash"])

    return source.mapInArrow(run, f"id {kind}, simhash long").withColumnRenamed("id", id_col)


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each as 00, 01 or 11."""
    high = F.shiftrightunsigned(fp, 1)
    any_, both = fp.bitwiseOR(high).bitwiseAND(F.lit(ODD)), fp.bitwiseAND(high).bitwiseAND(F.lit(ODD))
    return any_.bitwiseOR(F.shiftleft(both, 1))


def grids(untouched: int, blocks: int) -> list[int]:
    """A mask over the embedding for each choice of so many blocks."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(c)) for c in combinations(block_masks(blocks), untouched)]


def block_masks(blocks: int) -> list[int]:
    """A mask over the embedding for each block of segments."""
    edges = [round(i * 32 / blocks) for i in range(blocks + 1)]
    return [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:])]


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which fingerprints are within the radius: first by the Manhattan bound, then exactly. Of sketches, all bits count."""
    if b.ndim > 1:
        apart = np.bitwise_count(a[..., 0] ^ b[:, 0]) + np.bitwise_count(a[..., 1] ^ b[:, 1])
        near = apart <= radius
        near[near] = apart[near] + np.bitwise_count(np.broadcast_to(a, b.shape)[near, 2:] ^ b[near, 2:]).sum(axis=1) <= radius
        return near
    near = np.bitwise_count(_embedded(a) ^ _embedded(b)) <= radius
    near[near] = np.bitwise_count((np.broadcast_to(a, near.shape)[near] ^ b[near])) <= radius
    return near


def _embedded(x: np.ndarray) -> np.ndarray:
    odd, one = np.uint64(ODD), np.uint64(1)
    return ((x | (x >> one)) & odd) | ((x & (x >> one) & odd) << one)


def _cell_links(cell: np.ndarray, fp: np.ndarray, radius: int, stars: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join whatever is joined within each cell; cell is in order, and fp has a fingerprint or a row of them for
    each place. A cell with as many links as rows, or a large one, gets a spanning forest of the pairs within the radius;
    so links grow with a cell's size and not with the square. With `stars`, a tree's members are all linked to its first one
    instead, which may be farther: as the first in order is often the same in many cells, far fewer links differ."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    number = np.repeat(np.arange(len(starts)), sizes)
    some = np.repeat((sizes > 1) & (sizes <= LARGE_CELL), sizes)
    f, number = fp[some], number[some]
    links, found, by = np.zeros(len(starts), np.int64), [], 1
    while by < len(f):
        same = np.flatnonzero(number[by:] == number[:-by])
        if not len(same):
            break
        same = same[_near(f[same], f[same + by], radius)]
        if len(same):
            found.append((number[same], f[same], f[same + by]))
            links += np.bincount(number[same], minlength=len(starts))
            if (full := (links >= sizes)[number]).any():  # these cells need no further comparison here
                f, number = f[~full], number[~full]
        by += 1
    forest = (sizes > LARGE_CELL) | (links >= sizes)
    for n, a, b in found:
        yield a[~forest[n]], b[~forest[n]]
    for at, size in zip(starts[forest], sizes[forest]):
        left = fp[at : at + size]
        while len(left):
            reached, first, left = [left[:1]], left[0], left[1:]
            while reached and len(left):
                for node in reached.pop():
                    near = _near(node, left, radius)
                    if near.any():
                        yield np.repeat((first if stars else node)[None], near.sum(), axis=0), left[near]
                        reached.append(left[near])
                        left = left[~near]


def links(distinct: DataFrame, fp_col: str = "simhash", radius: int = 3, blocks: int = 6) -> DataFrame:
    """(a, b) pairs of different fingerprints whose links join all that lie within the radius of one another.

    Two of them within the radius differ in at most `radius` blocks of the embedding, so they meet in a cell of the grid
    over blocks that neither touches: the grids over blocks - radius of them leave no pair out.
    """
    e = embedding(F.col(fp_col))
    cells = [F.xxhash64(F.lit(i), e.bitwiseAND(F.lit(m))) for i, m in enumerate(grids(blocks - radius, blocks))]
    return linked_in_cells(distinct, [fp_col], cells, radius)


def linked_in_cells(distinct: DataFrame, words: Sequence[str], cells: Sequence[Column], radius: int, stars: bool = False) -> DataFrame:
    """(a, a1, a2, ..., b, b1, b2, ...) pairs of different fingerprints, of one or more words of 64 bits, whose links join
    all that share a cell and lie within the radius over all bits. With `stars` the ends of a link may lie farther apart,
    if others tie them together."""
    fps = ["fp", *(f"fp{i}" for i in range(1, len(words)))]
    names = [c + n[2:] for c in "ab" for n in fps]
    rows = distinct.select(F.explode(F.array(*cells)).alias("cell"), *(F.col(w).alias(n) for w, n in zip(words, fps)))
    rows = rows.repartition("cell").sortWithinPartitions("cell", *fps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            now = [np.asarray(c) for c in batch.columns]
            if not len(now[0]):
                continue
            last = np.searchsorted(now[0], now[0][-1])  # the last cell may go on
            if last:
                yield from found([*held, [x[:last] for x in now]])
                held = []
            held.append([x[last:] for x in now])
        yield from found(held)

    def found(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        cell, *fp = (np.concatenate(x) for x in zip(*held))
        wide = (np.stack(fp, axis=1) if len(fp) > 1 else fp[0]).view(np.uint64)
        for pair in _cell_links(cell, wide, radius, stars):
            if len(pair[0]):
                ends = (end.view(np.int64).reshape(-1, len(fps)) for end in pair)
                yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for end in ends for c in end.T], names=names)

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(id_col, fingerprint, component_id) for each row.

    fingerprint is 16 lowercase hex digits; component_id the least id reachable over links of at most `radius` bits.
    Texts without words have fingerprint zero and are linked like any other. Null ids keep their row and never name a
    group unless it has no other; repeated rows share theirs. An empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    least = fps.groupBy("simhash").agg(F.min(id_col).alias("own"), F.count("*").alias("times"))
    roots = components(links(least, "simhash", radius, blocks), "a", "b")
    tied = cut(least.join(roots, F.col("simhash") == F.col("node"), "left").select("simhash", "own", "times", F.coalesce("root", "simhash").alias("root")))
    groups = tied.groupBy("root").agg(F.min("own").alias("component_id"), F.count("*").alias("times"))
    named = joined(tied.withColumnRenamed("times", "rows"), groups, "root", tied.count()).select("simhash", "component_id", F.col("rows").alias("times"))
    return joined(fps, named, "simhash", fps.count()).select(id_col, F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")
