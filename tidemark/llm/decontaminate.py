"""Benchmark passages in documents, found by q-gram lemma filtering.

Two strings within k edits share at least m - q + 1 - kq of the first one's m - q + 1 q-grams, and the places of shared
q-grams differ by shifts that span k at most. For each document the q-grams shared with each benchmark item are counted
in diagonal bands of width 2(k + 1) that overlap by half, so some band holds all of them; bands that reach the bound are
aligned, over their own diagonals and k more on both sides, and matches within the budget stay. Where an item is so short
for its budget that the bound is below one, shorter q-grams are used, of which the lemma promises one at least.

Both sides are compared in a plain form: letters and digits in lower case, with one space for whatever lies between.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.letters import plain

#: Letters of benchmark text that are sent to all tasks at a time; a larger benchmark goes in several passes.
AT_ONCE = 8 << 20
#: Letters of documents whose q-grams are looked up at a time.
BLOCK = 1 << 20
Q, RATE = 12, 0.05
FILTER_BITS = 22


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """The hash of each q consecutive letters."""
    h, c = np.zeros(max(0, len(codes) - q + 1), np.uint64), codes.astype(np.uint64)
    for j in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[j : j + len(h)]
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xD6E8FEB86659FD93)


class _Index:
    """The q-grams of some items by hash: which item, and where in it."""

    def __init__(self, items: np.ndarray, texts: list[np.ndarray], q: int):
        self.q = q
        grams = [_grams(texts[i], q) for i in items]
        h = np.concatenate([*grams, np.empty(0, np.uint64)])
        item = np.repeat(items, [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, np.int64)]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.place = h[order], item[order], place[order]
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[h >> np.uint64(64 - FILTER_BITS)] = True

    def shared(self, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in joined, item, place in the item) for every q-gram that an item shares."""
        h = _grams(joined, self.q)
        at = np.flatnonzero(self.seen[h >> np.uint64(64 - FILTER_BITS)])
        low, high = np.searchsorted(self.h, h[at]), np.searchsorted(self.h, h[at], "right")
        times = high - low
        at, low = np.repeat(at, times), np.repeat(low, times)
        entry = low + np.arange(len(low)) - np.repeat(np.cumsum(times) - times, times)
        return at, self.item[entry], self.place[entry]


class _Items:
    """Benchmark items with indexes of their q-grams."""

    def __init__(self, ids: list, texts: list[np.ndarray], q: int, rate: float):
        self.ids, self.texts = ids, texts
        sizes = np.array([len(t) for t in texts], np.int64)
        self.budget = np.minimum((sizes * rate).astype(np.int64), np.maximum(0, sizes - 1))
        tight = (sizes >= q) & (sizes - q + 1 - self.budget * q < 1)
        lesser = int((sizes // (self.budget + 1))[tight].min()) if tight.any() else q
        self.least = sizes - np.where(tight, lesser, q) * (self.budget + 1) + 1
        self.indexes = [_Index(np.flatnonzero((sizes >= q) & ~tight), texts, q)]
        if tight.any():
            self.indexes.append(_Index(np.flatnonzero(tight), texts, lesser))
        self.short = [i for i, t in enumerate(texts) if 0 < len(t) < q]  # too short for any q-gram: sought as they are

    def found(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, begin, end, edits) of the best match of each item in each of the texts."""
        gap = np.zeros(1, np.uint32)
        joined = np.concatenate([x for t in texts for x in (t, gap)])
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        at, item, place = (np.concatenate(x) for x in zip(*(index.shared(joined) for index in self.indexes)))
        diagonal = at - place
        text = np.searchsorted(offsets, at, "right") - 1
        step = self.budget[item] + 1
        band = (diagonal + (1 << 40)) // step  # diagonals may be negative
        pairs = np.concatenate([np.stack([text, item, band]), np.stack([text, item, band - 1])], axis=1)
        order = np.lexsort(pairs[::-1])
        pairs = pairs[:, order]
        new = np.flatnonzero(np.r_[True, (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)][: pairs.shape[1]])
        count = np.diff(np.r_[new, pairs.shape[1]])
        kept = new[count >= self.least[pairs[1, new]]]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for t, i, b in pairs[:, kept].T.tolist():
            k = int(self.budget[i])
            first = b * (k + 1) - (1 << 40) - int(offsets[t])
            if (match := _aligned(self.texts[i], texts[t], first - k, 4 * k + 2, k)) is not None:
                best[t, i] = min(best.get((t, i), match), match)
        for t, text in enumerate(texts if self.short else []):
            whole = " " + text.tobytes().decode("utf-32-le", "surrogatepass").strip() + " "
            for i in self.short:
                word = self.texts[i].tobytes().decode("utf-32-le", "surrogatepass").strip()
                if word and (p := whole.find(f" {word} ")) >= 0:
                    best[t, i] = (0, p, p + len(word))
        for (t, i), (edits, begin, end) in best.items():
            yield t, i, begin, end, edits


def _aligned(item: np.ndarray, text: np.ndarray, first: int, width: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, begin, end) of the part of text that the whole item aligns with best over `width` diagonals from the first
    one; None beyond the budget.

    A row for each letter of the item, a cell for each diagonal; insertions along a row are a running minimum. begin is
    carried with each cell. Cells before the text's begin are out of reach, and what passes its end doesn't come back.
    """
    n, m, edit = len(text), len(item), np.int64(1 << 32)
    letters = np.full(m + width, 0xFFFFFFFF, np.uint32)  # the letter that leads to each diagonal of the first row, and on
    lo, hi = max(0, first), min(n, first + m + width)
    if hi > lo:
        letters[lo - first : hi - first] = text[lo:hi]
    steps = np.arange(width, dtype=np.int64) * edit
    begins = np.arange(first, first + width, dtype=np.int64)
    far = np.int64(1 << 61)
    row = np.where((begins >= 0) & (begins <= n), begins, far)  # edits times `edit` plus the begin that leads there
    for i in range(m):
        down = row + np.where(letters[i : i + width] == item[i], 0, edit)
        down[:-1] = np.minimum(down[:-1], row[1:] + edit)
        row = np.minimum.accumulate(down - steps) + steps
    ends = begins + m
    row = np.where((ends >= 0) & (ends <= n), row, far)
    at = int(np.argmin(row))
    edits, begin = divmod(int(row[at]), int(edit))
    return (edits, begin, int(ends[at])) if edits <= budget else None


def _passes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The benchmark's rows in passes of bounded size; its rows come to the driver part by part."""
    held, size = [], 0
    for r in benchmark.where(F.col(text_col).isNotNull()).select(id_col, text_col).toLocalIterator():
        codes = plain(r[1], True)
        if codes.size and codes[-1] == 32:
            codes = codes[:-1]
        if codes.size and codes[0] == 32:
            codes = codes[1:]
        if codes.size:
            held.append((r[0], codes))
            size += codes.size
        if size >= AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE) -> DataFrame:
    """(id_col, item_col, begin, end, edits): each benchmark item in each document, at its best place, within rate x its
    length edits. Places count letters of the document's plain form.

    Null and empty texts match nothing; items shorter than q letters match as whole words without edits; a row that is
    repeated on either side gives repeated rows.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, item_kind = source.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, begin long, `end` long, edits int"
    out, arrow_item = docs.sparkSession.createDataFrame([], schema), to_arrow_type(benchmark.schema[item_col].dataType)

    for n, sent in enumerate(_sent(docs, benchmark, item_col, item_text, q, rate)):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(_found(batch.column(1), sent.value))
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                held = [pa.array([r[c] for r in rows], k) for c, k in ((1, arrow_item), (2, pa.int64()), (3, pa.int64()), (4, pa.int32()))]
                yield pa.RecordBatch.from_arrays([ids, *held], names=["id", "item", "begin", "end", "edits"])

        found = source.mapInArrow(run, schema)
        out = found if not n else out.unionByName(found)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def _sent(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, q: int, rate: float) -> Iterator:
    for held in _passes(benchmark, item_col, item_text):
        yield docs.sparkSession.sparkContext.broadcast(_Items([i for i, _ in held], [t for _, t in held], q, rate))


def _found(column: pa.Array, items: _Items) -> Iterator[tuple]:
    """(row, item id, begin, end, edits) of the matches in a column of texts."""
    at, texts, size = 0, [], 0
    for i, x in enumerate(column):
        texts.append(plain(x.as_py() or "", True))
        size += len(texts[-1])
        if size >= BLOCK or i + 1 == len(column):
            for t, j, begin, end, edits in items.found(texts):
                yield at + t, items.ids[j], begin, end, edits
            at, texts, size = i + 1, [], 0


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE) -> DataFrame:
    """docs without the rows whose text holds a benchmark item. Null and empty texts stay."""
    text = docs.columns.index(text_col)
    for sent in _sent(docs, benchmark, item_col, item_text, q, rate):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                stays[[r[0] for r in _found(batch.column(text), sent.value)]] = False
                yield batch.filter(pa.array(stays))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
