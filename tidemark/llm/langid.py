"""Language identification by nearest centroids.

A text is the vector of its hashed letter n-grams (one to three letters, word limits included), weighted by TF-IDF and
normalised. Each language has several centroids, found by spherical k-means. A text takes the language of the centroid
with the greatest cosine; one that lies too far from it is rejected. How near it lies is the cosine's share of the most
that a text of as many n-grams can reach; the limit comes from a low quantile of this over the centroid's own sample texts
and over the language's, so that neither an odd row nor a centroid of odd rows sets it.
Document frequencies cover all rows that may be learned from. The centroids are fitted on a bounded sample: about
`sample` rows of each language, chosen by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.letters import parts, plain

BITS = 13
#: Rows of each language that centroids are fitted on, about; the documented bound of the sample.
SAMPLE = 1_000
UNKNOWN = "und"
#: A text is too far away below this share of the quantile LOW of what sample texts have.
NEAR, LOW = 0.5, 0.01
#: Few n-grams prove little: a text of so many has half the limit.
FEW = 16
ROWS = 64


def counts(text: str) -> np.ndarray | None:
    """How often each hashed n-gram occurs in the whole text; None if it has no letter."""
    total, seen = np.zeros(1 << BITS, np.int64), False
    for part in parts(text):
        letters = plain(part, False)
        if not len(letters):
            continue
        seen = True
        c = np.concatenate([[np.uint64(32)], letters.astype(np.uint64), [np.uint64(32)]])
        a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        two = c[:-1] * b + c[1:]
        three = two[:-1] * b + c[2:]
        shift = np.uint64(64 - BITS)
        for grams in (c[1:-1], two + (b >> np.uint64(3)), three):
            mixed = grams * a
            total += np.bincount(((mixed ^ (mixed >> np.uint64(29))) * a >> shift).astype(np.int64), minlength=1 << BITS)
    return total if seen else None


def _vectors(rows: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    v = np.log1p(np.stack(rows).astype(np.float32)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def held_out(id_col: str) -> Column:
    """crc32 of the id as text leaves 2 over 4. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts have each n-gram, and how many have any. The answer has one row for each of the hash's values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for x in batch.column(0):
                if (c := counts(x.as_py())) is not None:
                    df += c > 0
                    n += 1
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.r_[-1, at], pa.int32()), pa.array(np.r_[n, df[at]], pa.int64())], names=["gram", "n"])

    found = np.zeros((1 << BITS) + 1, np.int64)
    for r in texts.mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        found[r.gram] = r.n
    return found[:-1], int(found[-1])


def _reach(centroids: np.ndarray) -> np.ndarray:
    """For each centroid, the greatest cosine that a text of 1, 2, ... different n-grams can have with it."""
    return np.sqrt(np.cumsum(-np.sort(-(centroids.astype(np.float64) ** 2), axis=1), axis=1)).astype(np.float32)


def _clustered(table: pa.Table, idf: np.ndarray, clusters: int, rounds: int = 8) -> pa.Table:
    """The centroids of one language's sample, and how near to each a text must lie."""
    rows = [c for x in table["text"] if (c := counts(x.as_py())) is not None]
    if not rows:
        return pa.table({"lang": pa.array([], pa.string()), "centroid": pa.array([], pa.binary()), "least": pa.array([], pa.float64())})
    v = np.concatenate([_vectors(rows[i : i + ROWS], idf) for i in range(0, len(rows), ROWS)])
    by_mean = np.argsort(v @ v.mean(axis=0), kind="stable")
    chosen = by_mean[np.linspace(0, len(v) - 1, 2 * min(clusters, len(v)) + 1).astype(int)[1::2]]
    c = v[chosen]
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        c = np.stack([v[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    cosine = v @ c.T
    own = np.argmax(cosine, axis=1)
    near = cosine.max(axis=1) / _reach(c)[own, np.count_nonzero(v, axis=1) - 1]
    low = float(np.quantile(near, LOW))
    least = [NEAR * max(low, float(np.quantile(near[own == i], LOW)) if (own == i).any() else low) for i in range(len(c))]
    return pa.table({"lang": [table["lang"][0].as_py()] * len(c), "centroid": pa.array([x.astype("<f4").tobytes() for x in c], pa.binary()), "least": least})


class Model:
    """Centroids by language, with weights of n-grams and the nearness below which a text is rejected."""

    def __init__(self, langs: list[str], centroids: np.ndarray, least: np.ndarray, idf: np.ndarray):
        self.langs, self.centroids, self.least, self.idf = langs, centroids, least, idf
        self.reach = _reach(centroids)


def fit(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", clusters: int = 4, sample: int = SAMPLE) -> Model:
    """A model of the rows where `learn` holds (all, if none is given) and neither text nor language is null."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (F.lit(True) if learn is None else learn).alias("learn"))
    rows = rows.where(F.col("learn") & F.col("text").isNotNull() & F.col("lang").isNotNull())
    df, n = _frequencies(rows.select("text"))
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    shares = {r.lang: min(1.0, sample / r.n) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    share = F.element_at(F.create_map(*(F.lit(x) for pair in shares.items() for x in pair)), F.col("lang")) if shares else F.lit(1.0)
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20) < share).select("lang", "text")
    found = some.groupBy("lang").applyInArrow(lambda t: _clustered(t, idf, clusters), "lang string, centroid binary, least double").collect()
    found.sort(key=lambda r: (r.lang, r.centroid))
    matrix = np.stack([np.frombuffer(r.centroid, "<f4") for r in found]) if found else np.zeros((0, 1 << BITS), np.float32)
    return Model([r.lang for r in found], matrix, np.array([r.least for r in found]), idf)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' columns and lang_pred, score, rejected.

    The score is the cosine with the nearest centroid, from 0 to 1. Texts that are null or have no letter are `und` with
    score 0 and rejected; so is everything if the model knows no language. Repeated rows get the same answer each;
    columns of docs that have the new names give way.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few centroids for each language
    docs = docs.drop("lang_pred", "score", "rejected")
    keys, text = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            found = [counts(x.as_py()) if m.langs and x.is_valid else None for x in batch.column(text)]
            lang, score, far = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            if at := [i for i, c in enumerate(found) if c is not None]:
                cosine = _vectors([found[i] for i in at], m.idf) @ m.centroids.T
                grams = np.array([np.count_nonzero(found[i]) for i in at])
                best = np.argmax(cosine, axis=1)
                score[at] = np.clip(cosine[np.arange(len(at)), best], 0, 1)
                far[at] = score[at] / m.reach[best, grams - 1] < m.least[best] * grams / (grams + FEW)
                for i, b in zip(at, best):
                    lang[i] = m.langs[b]
            yield pa.record_batch([*batch.columns, pa.array(lang), pa.array(score), pa.array(far)], names=[*keys, "lang_pred", "score", "rejected"])

    schema = StructType([*docs.schema.fields])
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")):
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)
