"""Groups of texts whose sets of word shingles are alike: candidates by wide SimHash, then an exact check.

A text's set of shingles is hashed to 64-bit numbers, and four fingerprints of 64 bits are made of the set. Sets of
similarity s differ in arccos(2 s / (1 + s)) / pi of these bits on average, so candidates may differ in that and 2.5
standard deviations more. The fingerprints' segment embedding is cut into blocks, and the grids over some triples of
blocks bring candidates together (`simhash.linked_in_cells`). What the links tie together is a neighbourhood: all that
may be alike is in the same one. In each, the sets themselves decide: two texts are linked if their sets share enough.

The exact check takes a neighbourhood whole, or, where it is large, by cells over some bits of the fingerprint, more bits
for a larger one, and as many tables of cells as leave two alike texts apart in all of them with a chance of 0.005.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import PIECE, mixed, rolled, word_hashes
from tidemark.llm.common import cut, utf8
from tidemark.llm.components import components, joined
from tidemark.llm.simhash import HASHED, block_masks, embedding, linked_in_cells

WORDS = ["w0", "w1", "w2", "w3"]
#: Blocks of each fingerprint; a cell has three of all fingerprints' blocks, which lie STEPS apart.
BLOCKS, STEPS = 10, ((0, 1, 4), (0, 7, 17), (0, 2, 13))
#: Texts, and shingles, that a cell of the exact check is meant to hold.
CELL_TEXTS, CELL_SHINGLES = 1024, 1 << 20
_SALTS = np.array([0, 0x8CB92BA72F3D8DD7, 0x3C6EF372FE94F82B, 0xDAA66D2C7DDF743F], np.uint64)


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """The different shingles of each text as hashes in order. A text of fewer words has one shingle, all of them."""
    h, owner = word_hashes([t.lower() for t in texts])
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    runs, out = rolled(h, shingle), []
    for a, b in zip(bounds[:-1], bounds[1:]):
        out.append(np.unique(mixed(runs[a : b - shingle + 1] if b - a >= shingle else rolled(h[a:b], b - a))) if b > a else h[:0])
    return out


def slices(batch: pa.RecordBatch, text: int, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about so many bytes of its text column, a row each at least."""
    total = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size)))
        yield batch.slice(at, to - at)
        at = to


def sketch(found: np.ndarray) -> list[int]:
    """Four fingerprints of a set of hashes, as signed longs: a bit is 1 if set in over half of them."""
    ones = np.zeros(64 * len(WORDS), np.int64)
    for at in range(0, len(found), HASHED):
        wide = mixed(found[at : at + HASHED, None] ^ _SALTS)
        ones += np.unpackbits(wide.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(found)).view("<i8").tolist()


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, same, n, w0, w1, w2, w3) for each row: a hash of its set, how many shingles are in it, its fingerprints."""
    source = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            sets = shingle_sets([x.as_py() or b"" for x in batch.column(1)], shingle)
            wide = np.array([sketch(s) for s in sets], np.int64).reshape(-1, len(WORDS))
            columns = [batch.column(0), pa.array(_set_hashes(sets)), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(wide[:, i]) for i in range(len(WORDS)))]
            yield pa.record_batch(columns, names=["id", "same", "n", *WORDS])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, same long, n long, " + ", ".join(f"{w} long" for w in WORDS))


def _set_hashes(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)


def _cells(words: list[str]) -> list[Column]:
    """A cell for each triple of blocks of the embeddings of all fingerprints; two triples share one block at most."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    blocks = [F.col(w).bitwiseAND(F.lit(signed(m))) for w in words for m in block_masks(BLOCKS)]
    return [F.xxhash64(F.lit(i), *(blocks[(at + s) % len(blocks)] for s in steps)) for i, (at, steps) in enumerate((a, s) for s in STEPS for a in range(len(blocks)))]


def contracted(pairs: DataFrame) -> DataFrame:
    """Fewer links that join the same sketches: a sketch and all that it is linked to are tied to the least of these.

    The cells of a large group have different first members, so a sketch has a link for each cell at first; but the first
    members are few, and what ties them together is the same for many sketches. A sketch has one link in a cell that gave
    a forest, and fewer than the cell's rows in a small one, so its list is bounded by the number of cells.
    """
    of = lambda c: F.struct(*(F.col(f"{c}{i or ''}").alias(w) for i, w in enumerate(WORDS)))
    around = pairs.groupBy(of("b").alias("b")).agg(F.collect_set(of("a")).alias("firsts"))
    tied = around.select(F.array_min("firsts").alias("a"), F.explode(F.array_append("firsts", F.col("b"))).alias("b")).where("a <> b").distinct()
    return tied.select(*(F.col(f"{c}.{w}").alias(f"{c}{i or ''}") for c in "ab" for i, w in enumerate(WORDS)))


def neighbourhoods(sets: DataFrame, similarity: float) -> DataFrame:
    """(same, own, n, w0..w3, root, texts, shingles) of the sets that may be alike others: the neighbourhood of each, and
    how much is in it. `sets` has a row for each different set."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * len(WORDS)
    limit = int(bits * p + 2.5 * math.sqrt(bits * p * (1 - p)))
    nodes = cut(sets.groupBy(*WORDS).agg(F.min("same").alias("node"), F.count("*").alias("of_sketch")))
    embedded = nodes.select(*WORDS, *(embedding(F.col(w)).alias(f"e{w}") for w in WORDS))
    pairs = contracted(linked_in_cells(embedded, WORDS, _cells([f"e{w}" for w in WORDS]), limit, stars=True))
    for c, name in (("a", "x"), ("b", "y")):
        ends = [F.col(w).alias(f"{c}{i or ''}") for i, w in enumerate(WORDS)]
        pairs = pairs.join(nodes.select(*ends, F.col("node").alias(name)), [f"{c}{i or ''}" for i in range(len(WORDS))])
    roots = components(pairs.select("x", "y"), "x", "y")
    touched = nodes.join(roots, "node", "left").where("root IS NOT NULL OR of_sketch > 1")
    placed = cut(sets.join(touched.select(*WORDS, F.coalesce("root", "node").alias("root")), WORDS))
    sizes = placed.groupBy("root").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"), F.count("*").alias("times"))
    return joined(placed, sizes, "root", placed.count())


def _exact_cells(similarity: float) -> Column:
    """The cells of the exact check: one for a neighbourhood that fits, else one in each table."""
    stays = math.log(1 - math.acos(2 * similarity / (1 + similarity)) / math.pi)  # a bit, on average
    bits = F.greatest(F.ceil(F.log2(F.greatest(F.col("texts") / CELL_TEXTS, F.col("shingles") / CELL_SHINGLES))), F.lit(0)).cast("int")
    last = (F.ceil(math.log(0.005) / F.log(1 - F.exp(bits * stays))) - 1).cast("int")
    return F.when(bits == 0, F.array(F.xxhash64("root"))).otherwise(F.transform(F.sequence(F.lit(0), last), lambda t: F.xxhash64("root", t, _slice(t, bits))))


def _slice(table: Column, bits: Column) -> Column:
    """Some bits of one of the fingerprints, at another place for each table."""
    word = F.element_at(F.array(*WORDS), table % len(WORDS) + 1)
    place = F.floor(table / len(WORDS)) * 7 % (64 - bits)
    return F.call_function("shiftrightunsigned", word, place.cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)


def exact_links(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(a, b) pairs of sets of a neighbourhood whose links join all that are alike and share a cell of the exact check.

    A set is many times a cell's name, so sets go out table by table: first those of the first table of cells, then those
    of the second, then of all others; and from the second on only to cells whose members the links so far leave apart.
    A cell whose members are joined already could give no link that joins more. Copies of one text are joined after two
    tables, however many there are.
    """
    asked = cut(members.select(F.col("own").alias("id"), "same", _exact_cells(similarity).alias("cells")))
    tables = asked.agg(F.max(F.size("cells"))).first()[0] or 1
    links = cut(_linked(asked.withColumn("cells", F.slice("cells", 1, 1)), docs, id_col, text_col, shingle, similarity))
    for first, n in ((1, 1), (2, tables)):
        if first < tables:
            apart = _apart(asked.where(F.size("cells") > first).withColumn("cells", F.slice("cells", first + 1, n)), links)
            if apart.isEmpty():
                continue
            links = cut(links.union(_linked(apart, docs, id_col, text_col, shingle, similarity)))
    return links


def _apart(asked: DataFrame, links: DataFrame) -> DataFrame:
    """asked with those of its cells that have members of more than one component of the links; rows without any go."""
    each = asked.select("id", "same", F.explode("cells").alias("cell"))
    each = cut(each.join(components(links, "a", "b"), F.col("same") == F.col("node"), "left").select("id", "same", "cell", F.coalesce("root", "same").alias("root")))
    open_ = each.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("times")).where("low <> high").select("cell", "times")
    left = joined(each, open_, "cell", each.count())
    return cut(left.groupBy("id", "same").agg(F.collect_set("cell").alias("cells")))  # at most one for each table


def _linked(asked: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(a, b) links in the cells that are asked for: a spanning forest of each."""
    texts = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("data")).join(asked, "id").select("same", "cells", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            sets = shingle_sets([x.as_py() or b"" for x in batch.column(2)], shingle)
            own = pa.array(_set_hashes(sets) == np.asarray(batch.column(0)))  # another row with this id may have another text
            sets = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), sets], names=["same", "cells", "shingles"]).filter(own)

    with_sets = texts.mapInArrow(run, "same long, cells array<long>, shingles binary")
    return with_sets.select(F.explode("cells").alias("cell"), "same", "shingles").groupBy("cell").applyInArrow(lambda t: _alike(t, similarity), "a long, b long")


def _alike(table: pa.Table, similarity: float) -> pa.Table:
    """A spanning forest of a cell's sets of at least the similarity: each set is compared, by the places where its shingles
    occur, with all that no tree has reached yet."""
    same, at = np.unique(np.asarray(table["same"].combine_chunks()), return_index=True)
    sets = [np.frombuffer(table["shingles"][int(i)].as_py(), np.uint64) for i in at]
    sizes = np.array([len(s) for s in sets], np.int64)
    _, number = np.unique(np.concatenate(sets), return_inverse=True) if len(sets) else (None, np.empty(0, np.int64))
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(number, kind="stable")]
    begins = np.r_[0, np.cumsum(np.bincount(number))]
    own = np.r_[0, np.cumsum(sizes)]
    left, links = np.ones(len(sets), bool), []
    for root in range(len(sets)):
        queue = [root] if left[root] else []
        left[root] = False
        while queue and left.any():
            node = queue.pop()
            found = number[own[node] : own[node + 1]]
            n = begins[found + 1] - begins[found]
            spots = np.repeat(begins[found] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            shared = np.bincount(holders[spots], minlength=len(sets))
            alike = np.flatnonzero(left & (shared * (1 + similarity) >= similarity * (sizes[node] + sizes) - 1e-9) & (sizes > 0))
            left[alike] = False
            links += [(node, int(i)) for i in alike]
            queue += alike.tolist()
    ends = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": same[ends[:, 0]], "b": same[ends[:, 1]]})


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id_col, component_id) for each row with an id: the least id of the texts joined by links of at least the similarity
    between their sets of word shingles (Jaccard; A-Z in lower case).

    Texts without words are alike, and null is one of them. A link of no less than the similarity is never made up; one
    of just the similarity is missed with a chance of some 2 % (its ends share no cell, or differ in more bits than
    candidates may), of 0.85 with under 0.5 %, if no other text ties its ends together.
    """
    rows = cut(sketches(docs, id_col, text_col, shingle).where("id IS NOT NULL"))
    sets = rows.groupBy("same").agg(F.min("id").alias("own"), F.first("n").alias("n"), *(F.first(w).alias(w) for w in WORDS), F.count("*").alias("times"))
    sets = cut(sets)
    near = cut(neighbourhoods(sets.drop("times"), similarity))
    roots = components(exact_links(near, docs, id_col, text_col, shingle, similarity), "a", "b")
    grouped = cut(sets.join(roots, F.col("same") == F.col("node")).select("same", "own", "root"))
    least = grouped.groupBy("root").agg(F.min("own").alias("component_id"), F.count("*").alias("times"))
    named = joined(grouped, least, "root", grouped.count()).select("same", "component_id")
    named = sets.join(named, "same", "left").select("same", F.coalesce("component_id", "own").alias("component_id"), "times")
    return joined(rows, named, "same", rows.count()).select(F.col("id").alias(id_col), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of similar texts, the one with the least id.

    Rows without an id stay, as nothing tells them apart; of rows with the same id one stays. Texts without words are
    alike. Columns of any name but id_col and text_col go through untouched.
    """
    groups = cut(similar_groups(docs, id_col, text_col, shingle, similarity))
    gone = groups.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    kept = docs.join(gone, id_col, "left_anti").select(docs.columns)
    again = groups.groupBy(id_col).agg(F.count("*").alias("times")).where("times > 1").select(id_col)
    if again.isEmpty():
        return kept
    again = cut(again)
    once = kept.join(again, id_col, "left_semi").select(docs.columns).dropDuplicates([id_col])
    return kept.join(again, id_col, "left_anti").select(docs.columns).unionByName(once)
