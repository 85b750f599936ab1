"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

Ordinary texts go through the library whole. A text beyond `giant` letters is cut into chunks at any letter. What a chunk
needs of its neighbours is its boundary state: the last piece that starts before the boundary. For a BPE vocabulary a
segmentation is the library's own exactly if every two neighbouring pieces are stable side by side, that is, if encoding
the two together gives the two again; so the scores of the lattice are 0 (stable) and minus infinity, each chunk yields a
matrix of scores from its entry states to its exit states, and matrices combine by the max-plus product, which is
associative. A row of a matrix is kept as bits, one for each entry state. The products from both ends leave one state at
each boundary, and every chunk is traced back between its two states on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tidemark.llm.common import shuffle_width

GIANT, CHUNK = 65_536, 16_384
SPACE = "▁"
#: Letters of ordinary texts that are encoded at a time, and pairs of pieces that a worker remembers.
BATCH, PAIRS = 1 << 19, 200_000


class Vocabulary:
    """The library's model, and its pieces as a lattice over a normalised text."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        plain = [i for i in range(len(sp)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = [b""] * len(sp)
        for i in range(len(sp)):
            if sp.is_byte(i):
                self.bytes[i] = bytes([int(sp.id_to_piece(i)[3:-1], 16)])
        for p, i in self.ids.items():
            self.bytes[i] = p.replace(SPACE, " ").encode()
        self.of_byte = {self.bytes[i]: i for i in range(len(sp)) if sp.is_byte(i)}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.single: dict[str, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text: of all neighbours that form a piece, the best-scored, leftmost first, are joined."""
        parts = list(text)
        while True:
            best = max(((self.scores[j], -i) for i in range(len(parts) - 1) if (j := parts[i] + parts[i + 1]) in self.scores), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def stable(self, a: str, b: str) -> bool:
        """Whether the pieces a and b stay apart and whole side by side."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = found = self.merged(a + b) == [a, b]
        return found

    def starting(self, s: str, at: int) -> list[str]:
        """The pieces that the text has at a place; a letter outside the vocabulary is a piece of its own."""
        out = []
        for n in range(1, min(self.longest, len(s) - at) + 1):
            p = s[at : at + n]
            if n == 1 or p in self.ids:
                if (whole := self.single.get(p)) is None:
                    self.single[p] = whole = self.merged(p) == [p]
                if whole:
                    out.append(p)
        return out

    def states(self, s: str, boundary: int) -> list[tuple[int, str]]:
        """(start, piece) of the pieces that start before a place and reach it."""
        return [(a, p) for a in range(max(0, boundary - self.longest), boundary) for p in self.starting(s, a) if a + len(p) >= boundary]

    def paths(self, s: str, begin: int, end: int, entries: list[tuple[int, str] | None]) -> dict[tuple[int, str], int]:
        """For each (start, piece) from begin up to end: bits of the entry states from which a stable way leads there."""
        arrived: dict[int, dict[str | None, int]] = {}
        for i, e in enumerate(entries):
            place, piece = (begin, None) if e is None else (e[0] + len(e[1]), e[1])
            arrived.setdefault(place, {})
            arrived[place][piece] = arrived[place].get(piece, 0) | 1 << i
        out = {}
        for at in range(begin, end):
            if (before := arrived.pop(at, None)) is None:
                continue
            for p in self.starting(s, at):
                bits = 0
                for q, b in before.items():
                    if q is None or self.stable(q, p):
                        bits |= b
                if bits:
                    out[at, p] = bits
                    to = arrived.setdefault(at + len(p), {})
                    to[p] = to.get(p, 0) | bits
        return out

    def transfer(self, s: str, begin: int, end: int, last: bool) -> np.ndarray:
        """The matrix of a chunk: entry states by exit states, True for a score of 0. A text's first chunk has one entry
        state, before any piece, and its last has the exit states that end with it."""
        entries, exits = self.ends(s, begin, end, last)
        bits = self.paths(s, begin, end, entries)
        # a piece that begins before the chunk may reach beyond it
        through = {e: 1 << i for i, e in enumerate(entries) if e is not None and e[0] + len(e[1]) >= end}
        rows = [bits.get(e, 0) | through.get(e, 0) for e in exits]
        return np.array([[r >> i & 1 for r in rows] for i in range(len(entries))], bool).reshape(len(entries), len(exits))

    def ends(self, s: str, begin: int, end: int, last: bool) -> tuple[list, list]:
        exits = self.states(s, end)
        return (self.states(s, begin) if begin else [None]), [e for e in exits if e[0] + len(e[1]) == end] if last else exits

    def traced(self, s: str, begin: int, end: int, last: bool, entry: int, exit_: int) -> list[int]:
        """The ids of the pieces that start in a chunk, back from its exit state to its entry state."""
        entries, exits = self.ends(s, begin, end, last)
        first, now, out = entries[entry], exits[exit_], []
        bits = self.paths(s, begin, end, [first])
        by_end: dict[int, list[tuple[int, str]]] = {}
        for a, p in bits:
            by_end.setdefault(a + len(p), []).append((a, p))
        while now != first:
            out.append(now[1])
            if first is None and now[0] == begin:
                break
            ways = by_end.get(now[0], []) + ([first] if first is not None and first[0] + len(first[1]) == now[0] else [])
            now = next(w for w in ways if self.stable(w[1], now[1]))
        return [i for p in reversed(out) for i in self.numbered(p)]

    def numbered(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        return [found] if found is not None else [self.of_byte[bytes([b])] for b in piece.encode("utf-8", "surrogatepass")]

    def decoded(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(proto: bytes) -> Vocabulary:
    return Vocabulary(proto)


def normalised(text: Column) -> Column:
    return F.when(text == "", text).otherwise(F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE))))


def _scan(table: pa.Table) -> pa.Table:
    """One text's chunks: the entry and exit state of each, from the products of matrices before and behind it."""
    table = table.sort_by("chunk")
    shapes = [(n, m) for n, m in zip(table["entries"].to_pylist(), table["exits"].to_pylist())]
    matrices = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n * m).reshape(n, m).astype(bool) for x, (n, m) in zip(table["matrix"], shapes)]
    product = lambda v, m: (v[:, None] & m).any(axis=0)  # noqa: E731  max-plus over scores of 0 and minus infinity
    ahead = list(accumulate(matrices, product, initial=np.ones(1, bool)))
    back = list(accumulate((m.T for m in reversed(matrices)), product, initial=np.ones(shapes[-1][1], bool)))[::-1]
    at = [int(np.flatnonzero(a & b)[0]) for a, b in zip(ahead, back)]
    return pa.table({"key": table["key"], "chunk": table["chunk"], "entry": pa.array(at[:-1], pa.int32()), "exit": pa.array(at[1:], pa.int32())})


def _giant(texts: DataFrame, proto, chunk: int) -> DataFrame:
    """(key, ids) of different giant texts (key, text)."""
    tasks = shuffle_width(texts.sparkSession)  # as a chunk's work is more than its bytes tell
    longest = 64  # letters of context on both sides; no piece is longer
    s = texts.select("key", normalised(F.col("text")).alias("s")).withColumn("n", F.length("s"))
    begin = F.col("chunk") * chunk
    rows = s.withColumn("chunk", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / chunk).cast("int")))).select(
        "key", "chunk", F.greatest(begin - longest, F.lit(0)).alias("from"), F.least(begin + chunk, "n").alias("to"), (begin + chunk >= F.col("n")).alias("last"), F.substr("s", F.greatest(begin - longest, F.lit(0)) + 1, F.lit(chunk + 2 * longest)).alias("part")
    ).repartition(tasks, "key", "chunk")

    def place(r: dict) -> tuple[str, int, int, bool]:
        return r["part"], r["chunk"] * chunk - r["from"], r["to"] - r["from"], r["last"]

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(proto.value)
        for batch in batches:
            found = [v.transfer(*place(r)) for r in batch.to_pylist()]
            cells = pa.array([np.packbits(m).tobytes() for m in found], pa.binary())
            yield pa.record_batch([batch["key"], batch["chunk"], *(pa.array([m.shape[i] for m in found], pa.int32()) for i in (0, 1)), cells], names=["key", "chunk", "entries", "exits", "matrix"])

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(proto.value)
        for batch in batches:
            found = [v.traced(*place(r), r["entry"], r["exit"]) for r in batch.to_pylist()]
            yield pa.record_batch([batch["key"], batch["chunk"], pa.array(found, pa.list_(pa.int32()))], names=["key", "chunk", "ids"])

    states = rows.mapInArrow(matrices, "key string, chunk int, entries int, exits int, matrix binary").groupBy("key").applyInArrow(_scan, "key string, chunk int, entry int, exit int")
    traced = rows.join(states, ["key", "chunk"]).repartition(tasks, "key", "chunk").mapInArrow(traces, "key string, chunk int, ids array<int>")
    in_order = F.array_sort(F.collect_list(F.struct("chunk", "ids")))  # of one text
    return traced.groupBy("key").agg(F.flatten(F.transform(in_order, lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, model_path: str, text_col: str = "text", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """docs' columns and ids array<int>: the ids that the library gives for each whole text.

    Null and empty texts have no ids. Repeated rows and copies of a giant text are encoded alike; a giant text is encoded
    once for all its copies. Any column but text_col may be null; a column `ids` that docs has gives way.
    """
    proto = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())  # one vocabulary file
    docs = docs.drop("ids")
    long = F.coalesce(F.length(text_col) > giant, F.lit(False))
    keys, text = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = vocabulary(proto.value).library
        for batch in batches:
            at, texts, size = 0, [], 0
            for i, x in enumerate(batch.column(text)):
                texts.append(x.as_py() or "")
                size += len(texts[-1])
                if size >= BATCH or i + 1 == batch.num_rows:
                    found = library.encode(texts, out_type=int, num_threads=1)
                    offsets = np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32)
                    flat = np.fromiter((y for f in found for y in f), np.int32, offsets[-1])
                    yield pa.record_batch([*batch.slice(at, i + 1 - at).columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[*keys, "ids"])
                    at, texts, size = i + 1, [], 0

    schema = StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType()))])
    ordinary = docs.where(~long).mapInArrow(run, schema)
    huge = docs.where(long).withColumn("__key", F.sha2(F.col(text_col).cast("binary"), 256))
    found = _giant(huge.select(F.col("__key").alias("key"), F.col(text_col).alias("text")).dropDuplicates(["key"]), proto, chunk)
    return ordinary.unionByName(huge.join(found.withColumnRenamed("key", "__key"), "__key").select(*docs.columns, "ids"))


def decode(tokens: DataFrame, model_path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """tokens' columns and the text of the ids; null ids give the empty text."""
    proto = tokens.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    tokens = tokens.drop(into)
    keys, ids = tokens.columns, tokens.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(proto.value)
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            found = [v.decoded(np.asarray(x.values)) if x.is_valid else "" for x in batch.column(ids)]
            yield pa.record_batch([*batch.columns, pa.array(found, pa.string())], names=[*keys, into])

    return tokens.mapInArrow(run, StructType([*tokens.schema.fields, StructField(into, StringType())]))
