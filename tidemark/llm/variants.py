"""Spelling variants: each word of a corpus with the frequent word that it is one edit away from.

Words are counted over whole texts, with sums within a task before the shuffle. Near words come from the full neighbourhood
of each word: all distinct deletions, replacements and insertions over the letters that the vocabulary has. A neighbour
that is in the vocabulary is near, so the join by equal strings needs no distance afterwards. A word of L letters over an
alphabet of A has some 2 L A neighbours; tasks make these as rolling hashes and send to the join only those that a filter
of the vocabulary lets pass. The filter has a fixed greatest size, `FILTER_BITS`, and never drops a word of the vocabulary:
a vocabulary that outgrows it costs more rows in the join, not results.

Letters are a-z and U+00C0 to U+00FF, so that a word is a row of bytes in Latin-1.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Bits of the vocabulary's filter for each word, and at most (64 MiB).
WORD_BITS, FILTER_BITS = 32, 1 << 29
#: Bits of a block of the filter; letters of a part of a text; distinct words that a task sums before it sends them.
BLOCK, PART, HELD = 1 << 19, 1 << 20, 1 << 18
ROWS = 256
_LETTERS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 0xC0 else 32 for i in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _runs(text: str) -> Iterator[list[bytes]]:
    """The runs of letters of a text in lower case, in Latin-1, a part of the text at a time."""
    at = 0
    while at < len(text):
        part = text[at : at + PART].encode("latin-1", "replace").translate(_LETTERS)
        at += len(part)
        tail = bytearray()
        while at < len(text) and part and part[-1] != 32 and (c := text[at].encode("latin-1", "replace").translate(_LETTERS)) != b" ":
            tail += c
            at += 1
        yield (part + tail).split()


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = 199, least_letters: int = 6, least: int = 5) -> DataFrame:
    """(word, n): the words of all texts with at least so many letters and occurrences.

    h is the crc32 of `<id>:<run>`; where one_in divides it, the run loses its letter h % length before it is counted, in
    every occurrence in that document (one_in 0: runs stay as they are). Null texts have no runs; a null id counts as the
    empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                seed = zlib.crc32(f"{key.as_py() if key.is_valid else ''}:".encode())
                for runs in _runs(text.as_py() or ""):
                    for r, n in Counter(runs).items():
                        if one_in and (h := zlib.crc32(r if r.isascii() else r.decode("latin-1").encode(), seed)) % one_in == 0:
                            p = h % len(r)
                            r = r[:p] + r[p + 1 :]
                        if len(r) >= least_letters:
                            held[r] += n
                    if len(held) > HELD:
                        yield _rows(held)
                        held.clear()
        yield _rows(held)

    source = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _rows(held: Counter[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the filter for each hash."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    last = np.uint64(bits - 1)
    return h & last, (h >> np.uint64(32)) & last


def _hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of one length, a row each: hashes of their beginnings and ends by where they end or begin, and powers."""
    n, size = words.shape
    power = np.array([pow(int(_BASE), i, 1 << 64) for i in range(size + 2)], np.uint64)
    head, tail = np.zeros((n, size + 1), np.uint64), np.zeros((n, size + 1), np.uint64)
    for i in range(size):
        head[:, i + 1] = head[:, i] * _BASE + words[:, i]
        tail[:, size - 1 - i] = tail[:, size - i] + words[:, size - 1 - i] * power[i]
    return head, tail, power


def _by_length(words: list[str]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words of one length, ROWS of them at most, as bytes and as a matrix."""
    by: dict[int, list[bytes]] = {}
    for w in words:
        by.setdefault(len(w), []).append(w.encode("latin-1"))
    for size, of_size in by.items():
        for at in range(0, len(of_size), ROWS):
            part = of_size[at : at + ROWS]
            yield part, np.frombuffer(b"".join(part), np.uint8).reshape(len(part), size).astype(np.uint64)


def _filter(words: DataFrame, bits: int) -> np.ndarray:
    """The vocabulary's filter: a bit for each place. Blocks are made on the executors; at most FILTER_BITS come here."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.concatenate(_places(_hashes(m)[0][:, -1], bits)) for _, m in _by_length(batch.column(0).to_pylist())]
            at = np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array((at // BLOCK).astype(np.int32)), pa.array((at % BLOCK).astype(np.int32))], names=["block", "place"])

    def block(t: pa.Table) -> pa.Table:
        on = np.zeros(min(bits, BLOCK), np.uint8)
        on[t["place"].to_numpy()] = 1
        return pa.table({"block": t["block"][:1], "bytes": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    for r in words.select("word").mapInArrow(places, "block int, place int").groupBy("block").applyInArrow(block, "block int, bytes binary").toLocalIterator():
        part = np.frombuffer(r.bytes, np.uint8)
        out[r.block * (BLOCK // 8) :][: len(part)] = part
    return out


def neighbours(words: DataFrame, letters: str, known: np.ndarray) -> DataFrame:
    """(word, near): every distinct deletion, replacement and insertion of a word that the filter `known` lets pass.

    A letter equal to the one before it is neither deleted nor inserted, as that gives the neighbour before; so no
    neighbour comes twice.
    """
    sent = words.sparkSession.sparkContext.broadcast(known)
    codes = np.frombuffer(letters.encode("latin-1"), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on, c = sent.value, codes.astype(np.uint64)
        bits = len(on) * 8

        def passing(h: np.ndarray, distinct: np.ndarray) -> np.ndarray:
            a, b = _places(h, bits)
            bit = lambda p: (on[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
            ok = distinct & (bit(a) == 1)
            ok[ok] = bit(b[ok]) == 1
            return np.argwhere(ok)

        for batch in batches:
            word, near = [], []
            for part, m in _by_length(batch.column(0).to_pylist()):
                size = m.shape[1]
                head, tail, power = _hashes(m)
                same = np.zeros(m.shape, bool)
                same[:, 1:] = m[:, 1:] == m[:, :-1]
                gone = head[:, :-1] * power[size - 1 - np.arange(size)] + tail[:, 1:]
                for w, i in passing(gone, ~same):
                    word.append(part[w])
                    near.append(part[w][:i] + part[w][i + 1 :])
                put = (head[:, :-1] * power[size - np.arange(size)] + tail[:, 1:])[:, :, None] + c * power[size - 1 - np.arange(size)][:, None]
                for w, i, x in passing(put, m[:, :, None] != c):
                    word.append(part[w])
                    near.append(part[w][:i] + codes[x].tobytes() + part[w][i + 1 :])
                at = np.arange(size + 1)
                added = (head * power[size + 1 - at] + tail)[:, :, None] + c * power[size - at][:, None]
                distinct = np.ones(added.shape, bool)
                distinct[:, 1:] = m[:, :, None] != c
                for w, i, x in passing(added, distinct):
                    word.append(part[w])
                    near.append(part[w][:i] + codes[x].tobytes() + part[w][i:])
            yield pa.record_batch([pa.array([x.decode("latin-1") for x in side], pa.string()) for side in (word, near)], names=["word", "near"])

    return words.select("word").mapInArrow(run, "word string, near string")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last one. Each form occurs `times` as often as its word, so that
    chains are short; each round doubles what has been followed."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        next_of = now.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        stepped = cut(now.join(next_of, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")))
        now = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return now


def grouped(vocabulary: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of (word, n), words being distinct and of Latin-1 letters.

    A word's form is its near word (one letter inserted, deleted or replaced) of the largest n, of equals the smallest
    in code-point order, if that n is at least `times` the word's; else null, as is form_n. Its root is where forms of
    forms end. Words without near words have n_near 0. A word has a bounded number of neighbours, so that no key of a
    join or group is hot. An empty vocabulary gives no rows. times must be 2 or more.
    """
    if times < 2:
        raise ValueError("times must be 2 or more, else forms could go round")
    words = cut(vocabulary.select("word", "n"))
    letters = sorted(r[0] for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect())  # at most 90
    bits = min(FILTER_BITS, max(1 << 16, 1 << (WORD_BITS * words.count()).bit_length()))
    pairs = neighbours(words, "".join(letters), _filter(words, bits))
    found = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = found.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("form"))).alias("best"))
    all_of = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best")
    enough = -F.col("best.k") >= times * F.col("n")
    formed = cut(all_of.select("word", "n", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.k")).alias("form_n")))
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
