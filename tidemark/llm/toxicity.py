"""Toxicity by bags of subwords: a linear softmax over averaged embeddings of character n-grams.

A word is the mean of its n-grams' vectors (three to five characters with the word's limits, and the word itself), hashed
into a table of fixed size; a window of WINDOW words is the mean of its words; a linear softmax says how likely label 1
is. Vectors and softmax are trained jointly in numpy. A spelling never seen shares most n-grams with those that were.

One hit in a text of thousands of words vanishes in the text's mean, so the softmax is over windows, and a text is as
toxic as its most toxic window. Training takes labels of texts: a text's windows count by their share in the text's
likelihood (a softmax over the windows' scores), which goes to the largest one as the training goes on.

As all means are linear, a trained model is a number for each n-gram: scoring a word adds up a few numbers, and nothing
of the table's width reaches the large input. The model is fitted on a bounded sample: about `sample` rows of labels 1
and 0, chosen by a hash of the id, and of those at most WINDOWS windows each, evenly over the text. Scores cover whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of label 1 and of label 0 that the model is fitted on, about; windows of each row.
SAMPLE, WINDOWS = (1_000, 3_000), 128
#: Hash bits of the table, its width, words of a window, words whose scores a task keeps, letters of a text taken at once.
BITS, DIM, WINDOW, CACHE, PART = 18, 8, 8, 1 << 18, 1 << 20
THRESHOLD = 0.3
#: Texts of the sample that an n-gram must be in; how strongly vectors are pulled to zero.
LEAST, DECAY = 8, 1e-5
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_EDGES = " \t\n\r\v\f.,;:!?\"'()[]{}|#$%&*"


def words(text: str) -> Iterator[list[str]]:
    """The words of a text in lower case, without marks at their edges; a part of the text at a time."""
    at = 0
    while at < len(text):
        to = at + PART
        while to < len(text) and not text[to].isspace():
            to += 1
        yield [w for x in text[at:to].lower().split() if (w := x.strip(_EDGES))]
        at = to


def subwords(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places in the table of all words' n-grams, one word after another, and how many each word has."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in some).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in some])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    owner, left = np.repeat(np.arange(len(some)), sizes), np.repeat(starts + sizes, sizes) - np.arange(len(codes))
    rolled, found, own = codes + np.uint64(1), [], []
    for n in range(2, 6):
        if len(rolled) < 2:
            break
        rolled = rolled[:-1] * _A + codes[n - 1 :]
        if n > 2:
            fits = left[: len(rolled)] >= n
            found.append(rolled[fits])
            own.append(owner[: len(rolled)][fits])
    # the word itself: the sum of its characters by place
    power = np.cumprod(np.full(max(sizes, default=1), _A, np.uint64))
    whole = np.add.reduceat(codes * power[np.arange(len(codes)) - starts[owner]], starts) if len(some) else np.zeros(0, np.uint64)
    found.append(whole)
    own.append(np.arange(len(some)))
    own, h = np.concatenate(own), np.concatenate(found)
    h = (h ^ (h >> np.uint64(30))) * _B
    order = np.argsort(own, kind="stable")
    return (h >> np.uint64(64 - BITS)).astype(np.int64)[order], np.bincount(own, minlength=len(some))


class Model:
    """A trained model: a number for each place of the table, and the softmax's bias."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def of_words(self, some: list[str]) -> np.ndarray:
        if not some:
            return np.zeros(0)
        at, n = subwords(some)
        return np.add.reduceat(self.table[at].astype(np.float64), np.r_[0, np.cumsum(n)[:-1]]) / n

    def score(self, text: str | None, cache: dict[str, float] | None = None) -> float:
        """How likely label 1 is, by the text's most toxic window; a text without words has the bias alone."""
        cache = {} if cache is None else cache
        best, rest = None, []
        for some in words(text or ""):
            if missing := list({w for w in some if w not in cache}):
                if len(cache) + len(missing) > CACHE:
                    cache.clear()
                    missing = list(set(some))
                cache.update(zip(missing, self.of_words(missing).tolist()))
            values = rest + [cache[w] for w in some]
            full = len(values) // WINDOW * WINDOW
            if full:
                top = float(np.array(values[:full]).reshape(-1, WINDOW).mean(axis=1).max())
                best = top if best is None else max(best, top)
            rest = values[full:]
        if rest:
            last = sum(rest) / len(rest) if best is None else sum(rest) / WINDOW  # a short end counts as if plain words filled it
            best = last if best is None else max(best, last)
        return float(1 / (1 + np.exp(-np.clip((best or 0.0) + self.bias, -50, 50))))


def train(texts: list[list[list[str]]], labels: np.ndarray, rounds: int = 150, rate: float = 0.1, seed: int = 0) -> Model:
    """A model of texts (each a list of windows of words) with labels 0 and 1. Equal labels or no texts give a model that
    knows the share of label 1 only."""
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    prior = float(np.log(share / (1 - share)))
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(1 << BITS, np.float32), prior)
    known: dict[str, int] = {}
    ids = [np.array([known.setdefault(w, len(known)) for w in win], np.int64) for t in texts for win in t]
    at, n = subwords(list(known))
    in_win = np.concatenate(ids)
    sizes = np.array([len(x) for x in ids])
    win_of = np.repeat(np.arange(len(sizes)), sizes)
    text_of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    text_first = np.flatnonzero(np.r_[True, np.diff(text_of) > 0])
    y = labels.astype(np.float32)[text_of[text_first]]
    # n-grams of few texts would learn these texts by heart: they stay at zero
    of_text = np.unique(np.repeat(text_of, sizes) * len(known) + in_win)
    texts_with = np.bincount(of_text % len(known), minlength=len(known))
    df = np.bincount(at, np.repeat(texts_with, n), 1 << BITS)
    used, place_of = np.flatnonzero(df >= LEAST), np.zeros(1 << BITS, np.int64)
    place_of[used] = np.arange(1, len(used) + 1)
    of_word = np.repeat(np.arange(len(known)), n)[place_of[at] > 0]
    at = place_of[at][place_of[at] > 0] - 1
    place = np.repeat(np.arange(len(text_first)), np.diff(np.r_[text_first, len(text_of)]))
    rng = np.random.default_rng(seed)
    e, w = (0.1 * rng.standard_normal((len(used), DIM))).astype(np.float32), (0.1 * rng.standard_normal((DIM, 2))).astype(np.float32)
    b = np.zeros(2, np.float32)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (e, w, b)]
    for step in range(1, rounds + 1):
        u = w[:, 1] - w[:, 0]
        of_gram = e @ u  # averages are linear, so scores may be averaged in place of vectors
        of_known = np.bincount(of_word, of_gram[at], len(known)) / n
        z = np.bincount(win_of, of_known[in_win], len(sizes)) / sizes + b[1] - b[0]
        sharp = 1 + 4 * step / rounds
        a = np.exp(sharp * (z - np.maximum.reduceat(z, text_first)[place]))
        a /= np.add.reduceat(a, text_first)[place]
        p = 1 / (1 + np.exp(-np.add.reduceat(a * z, text_first)))
        g = ((p - y) / len(y))[place] * a
        dz = np.bincount(in_win, (g / sizes)[win_of], len(known)) / n
        dgram = np.bincount(at, dz[of_word], len(used)).astype(np.float32)
        de, du, db = np.outer(dgram, u), e.T @ dgram, g.sum()
        dw, db = np.stack([-du, du], axis=1), np.array([-db, db], np.float32)
        de += DECAY * e
        for x, gx, (m, v) in zip((e, w, b), (de, dw, db), moments):
            m += 0.1 * (gx - m)
            v += 0.01 * (gx * gx - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    table = np.zeros(1 << BITS, np.float32)
    table[used] = e @ (w[:, 1] - w[:, 0])
    return Model(table, float(b[1] - b[0]))


def held_out(id_col: str) -> Column:
    """crc32 of the id as text leaves 2 over 4. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _windows(text: str) -> list[list[str]]:
    """Windows of a text for training: all up to WINDOWS of them, else so many evenly over the text."""
    some = [w for part in words(text) for w in part]
    made = [some[i : i + WINDOW] for i in range(0, len(some), WINDOW)]
    return made if len(made) <= WINDOWS else [made[i] for i in np.linspace(0, len(made) - 1, WINDOWS).astype(int)]


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: tuple[int, int] = SAMPLE) -> Model:
    """A model of the documents that labels mark with 0 or 1 and where `learn` holds (all, if none is given). Null ids,
    texts and labels teach nothing; of several labels of one id the largest counts, of several rows of one id one."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.max("label").cast("int").alias("label"))
    rows = docs.where(F.lit(True) if learn is None else learn).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    counts = {r.label: r.n for r in rows.select("id").distinct().join(marks, "id").groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("label") == 1, min(1.0, sample[0] / counts.get(1, 1))).otherwise(min(1.0, sample[1] / counts.get(0, 1)))
    # about sum(sample) rows, whatever the input, so that texts stay where they are
    chosen = marks.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20) < share)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\x01".join(" ".join(win) for win in _windows(x.as_py())) for x in batch.column(1)]
            yield pa.record_batch([pa.array([0] * len(texts), pa.int32()), batch.column(0), pa.array(texts, pa.string()), batch.column(2).cast(pa.int32())], names=["one", "id", "windows", "label"])

    def learned(t: pa.Table) -> pa.Table:
        t = t.sort_by([("label", "ascending"), ("id", "ascending"), ("windows", "ascending")])
        texts = [[win.split(" ") for win in x.split("\x01")] if x else [] for x in t["windows"].to_pylist()]
        have = [i for i, x in enumerate(texts) if x]
        model = train([texts[i] for i in have], t["label"].to_numpy()[have])
        return pa.table({"table": pa.array([model.table.tobytes()], pa.binary()), "bias": [model.bias]})

    kind = rows.schema["id"].dataType.simpleString()
    some = rows.join(F.broadcast(chosen), "id").select("id", "text", "label").mapInArrow(cut_up, f"one int, id {kind}, windows string, label int")
    some = some.groupBy("one", "id").agg(F.min("windows").alias("windows"), F.max("label").alias("label"))  # one row of an id
    found = some.groupBy("one").applyInArrow(learned, "table binary, bias double").collect()  # one model of a fixed size
    return Model(np.frombuffer(found[0].table, np.float32), found[0].bias) if found else train([], np.zeros(0))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs' columns and score (0 to 1, higher: label 1 likelier), predicted (1 from the threshold on).

    Whole texts are scored; null and empty ones get what no words give. Repeated rows get the same answer each; columns of
    docs that have the new names give way.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    docs = docs.drop("score", "predicted")
    keys, text = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = held.value, {}
        for batch in batches:
            score = np.array([model.score(x.as_py(), cache) for x in batch.column(text)], np.float64)
            yield pa.record_batch([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*keys, "score", "predicted"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("score", "double").add("predicted", "integer"))
