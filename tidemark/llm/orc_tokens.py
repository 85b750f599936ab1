"""Token ids in ORC files: whole texts encoded, written in id order, read back by stripe.

ORC keeps the ids as integer run-length streams, a row index every `index_stride` rows, and a Bloom filter on the
document ids in each stripe. A reader takes stripes as they come, in parallel; a filter on doc_id skips stripes and row
groups by these statistics and filters without opening their ids.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.blocks import pieces, same_slices, slice_hashes
from tidemark.llm.common import cut, shuffle_width, utf8

END = 1
#: Text bytes that a file is meant to hold.
FILE_BYTES = 64 << 20
#: Words that a worker remembers at least.
WORDS = 500_000
#: Bytes by kind (white space 0, marks 2, others 1), and those that are letters or numbers by themselves or after C3.
KIND = np.ones(256, np.uint8)
KIND[list(b" \t\n\v\f\r")], KIND[list(b".,!?;:|#$%&*()[]{}\"-+=/")] = 0, 2
LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))
COMPOSED = (np.arange(256) >= 0x9F) & (np.arange(256) <= 0xBF) & (np.arange(256) != 0xB7)
#: Words of lower-case Latin letters in composed form, which normalising leaves as they are.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


# The steps of a tokenizer whose words can be encoded apart.
NORMALS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def words_stand_alone(source: str) -> bool:
    """Whether a tokenizer's file tells of these steps and no others: composed lower-case letters, white space dropped,
    letters, single numbers and marks apart, bytes as letters, pairs merged within a word, special tokens with `<|`."""
    t = json.loads(source)
    normal, before, model = (t.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    steps, cuts = normal.get("normalizers", []), before.get("pretokenizers", [])
    return (
        [x["type"] for x in steps] == NORMALS
        and (steps[1].get("pattern"), steps[1].get("content")) == ({"Regex": r"\s+"}, " ")
        and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
        and (cuts[0].get("pattern"), cuts[0].get("behavior"), cuts[0].get("invert")) == ({"Regex": SPLIT}, "Removed", True)
        and not cuts[1].get("add_prefix_space")
        and not cuts[1].get("use_regex")
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and not t.get("post_processor")
        and all("<|" in x["content"] for x in t.get("added_tokens") or [])
    )


def _byte_letters() -> dict[int, int]:
    """The letters by which byte-level models write bytes: printable ones stand for themselves, the others follow at 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}


#: Bytes of text whose words are looked up together.
BLOCK = 4 << 20


class _Memory(dict):
    """What `find` gives, remembered: the last `most` keys at least, twice as many at most."""

    def __init__(self, find: Callable[[bytes], bytes], most: int):
        self.find, self.most, self.older = find, most, {}

    def __missing__(self, key: bytes) -> bytes:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        found = self.older.get(key)
        self[key] = found = self.find(key) if found is None else found
        return found


class _Words:
    """Ids of texts, for which each different word is encoded once.

    The tokenizer never joins across white space, nor a letter or number with the ASCII marks beside it, and it puts
    letters in lower case. So texts fall into words and runs of marks that stand alone, but for texts that may spell a
    special token; these are encoded as they are. So are all texts if the tokenizer's file tells of other steps.
    """

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.whole = not words_stand_alone(source)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.words = _Memory(self._encoded, WORDS)

    def _encoded(self, word: bytes) -> bytes:
        if not self.whole and PLAIN.fullmatch(word):
            ids = [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each with the end id, and how many each has."""
        held, size, out = [], 0, [[] for _ in texts]
        special = {i for i, t in enumerate(texts) if self.whole or b"<|" in t}
        for i in special:
            out[i].append(np.frombuffer(self._encoded(texts[i]), "<u4"))
        for i, piece in pieces([b"" if i in special else t.lower() for i, t in enumerate(texts)]):
            held.append((i, piece))
            size += len(piece) + 1
            if size >= BLOCK:
                self._block(held, out)
                held, size = [], 0
        self._block(held, out)
        ends = np.array([end], np.uint32)
        sizes = np.array([sum(map(len, x)) + 1 for x in out], np.int64)
        return np.concatenate([y for x in out for y in (*x, ends)] or [ends[:0]]), sizes

    def _block(self, held: list[tuple[int, bytes]], out: list[list[np.ndarray]]) -> None:
        """Each different word of the block is looked up once."""
        block = b" ".join(p for _, p in held)
        starts, ends = _cut(np.frombuffer(block, np.uint8))
        if not len(starts):
            return
        _, first, inverse = np.unique(slice_hashes(block, starts, ends), return_index=True, return_inverse=True)
        odd = np.flatnonzero(~same_slices(block, starts, ends, first[inverse]))
        inverse[odd], first = len(first) + np.arange(len(odd)), np.r_[first, odd]  # words whose hash another has
        found = [self.words[block[a:b]] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        ids, sizes = np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)
        n = sizes[inverse]
        done = np.cumsum(n)
        values = ids[np.repeat((np.cumsum(sizes) - sizes)[inverse] - (done - n), n) + np.arange(done[-1])]
        offsets = np.cumsum([len(p) + 1 for _, p in held[:-1]])
        cuts = np.r_[0, done][np.searchsorted(starts, offsets)]
        for (i, _), part in zip(held, np.split(values, cuts)):
            out[i].append(part)


def _cut(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words and runs of marks start and end that stand alone."""
    kind, known = KIND[b], LETTER[b]
    composed = np.r_[False, (b[:-1] == 0xC3) & COMPOSED[b[1:]]]  # second bytes of Latin letters
    before = known | composed  # the byte ends a letter or number
    after = known | np.r_[composed[1:], False]  # the byte begins one
    mark = kind == 2
    apart = np.r_[False, (mark[1:] & before[:-1]) | (mark[:-1] & ~mark[1:] & after[1:])]
    inside = kind > 0
    last = np.r_[False, inside[:-1]]
    starts = np.flatnonzero(inside & (~last | apart))
    ends = np.flatnonzero(np.r_[last & (~inside | apart), inside[-1:]])
    return starts, ends


@lru_cache(maxsize=2)
def _words(source: str) -> _Words:
    """One for each worker process, whichever tasks it runs."""
    return _Words(source)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END) -> DataFrame:
    """(id_col, ids array<int>) of each row in the order it has; a null or empty text has the end id alone."""
    source = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text())  # one vocabulary file
    data = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("data"))
    kind = data.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(source.value)
        for batch in batches:
            sizes = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0), np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK)))
                values, counts = words.encode([x.as_py() or b"" for x in batch.column(1).slice(at, to - at)], end_id)
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values.view(np.int32)))
                yield pa.record_batch([batch.column(0).slice(at, to - at), ids], names=["id", "ids"])
                at = to

    return data.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def write(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 16 << 20, index_stride: int = 2_000, file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of all rows as ORC files, ascending by id within and across files (null ids first), with each row's
    place in its file. Files are as many as the texts' bytes ask for, and one for each shuffle partition at least.

    Rows with one id follow one another by a hash of their text, so that many of them can span files; of rows that are
    equal in both any order is the same.
    """
    data = docs.select(id_col, text_col).withColumn("__tie", F.xxhash64(F.col(text_col).cast("string")))
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    files = max(shuffle_width(docs.sparkSession), -(-size // file_bytes))
    ordered = data.repartitionByRange(files, id_col, "__tie").sortWithinPartitions(id_col, "__tie").drop("__tie")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's number in its partition
    out = encode(ordered, tokenizer_path, id_col, text_col).select(id_col, place.alias("place"), F.size("ids").alias("n_tokens"), "ids")
    options = {"orc.stripe.size": stripe_bytes, "orc.row.index.stride": index_stride, "orc.create.index": "true", "orc.bloom.filter.columns": id_col, "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}
    out.write.options(**options).orc(path)


def read(spark: SparkSession, path: str, ids: Iterable[int] | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id_col, place, n_tokens, ids) from the files; with `ids`, only these documents, found by the files' own indexes."""
    found = spark.read.orc(path)
    return found if ids is None else found.where(F.col(id_col).isin(list(ids)))


def summary(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) from the files: where each document begins, and a checksum of its ids.

    A document begins where those of earlier files and of earlier places in its own file end, ties included. Running sums are taken within each file and then over one row per file.
    """
    stored = spark.read.orc(path).select(id_col, F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("part"), "place", "ids")
    kind = stored.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ends = np.asarray(batch.column(3).flatten(), "<i4"), np.cumsum(np.asarray(batch.column(3).value_lengths()))
            sizes = np.diff(np.r_[0, ends])
            crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist())]
            yield pa.record_batch([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["id", "part", "place", "n", "crc"])

    rows = cut(stored.mapInArrow(run, f"id {kind}, part int, place long, n long, crc long"))
    parts = rows.groupBy("part").agg(F.sum("n").alias("held"))
    before = parts.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("before"))  # a row per file
    within = F.sum("n").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    out = rows.withColumn("within", within).join(F.broadcast(before), "part")
    return out.select(F.col("id").alias(id_col), (F.col("before") + F.col("within")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
