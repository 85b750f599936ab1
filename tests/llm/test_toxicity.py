"""Toxicity: held-out accuracy, scores by plain loops, and edges."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, toxicity
from tidemark.llm.toxicity import Model


def test_held_out_accuracy(spark):
    """Recall of held-out toxic documents, and how many clean ones are left alone; labels are no input of a score. Only
    the English rows of these data have words that mark label 1 and are frequent enough to be learned (some 300 texts)."""
    d = "/root/testdata/sf0.1"
    found = {r.doc_id: r for r in queries.op11_toxicity(spark, d).collect()}
    truth = {i: (toxic, lang) for i, toxic, lang in duckdb.sql(f"SELECT doc_id, toxic, lang FROM '{d}/labels.parquet' JOIN '{d}/documents.parquet' USING (doc_id)").fetchall()}
    assert len(found) == duckdb.sql(f"SELECT count(*) FROM '{d}/documents.parquet'").fetchall()[0][0]
    said = [(*truth[i], r.predicted) for i, r in found.items() if r.held_out and i in truth]
    recall = np.mean([p for t, lang, p in said if t == 1 and lang == "en"])
    clean = np.mean([p == 0 for t, _, p in said if t == 0])
    assert recall > 0.88 and clean > 0.98, (recall, clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())


def test_scores_equal_plain_loops():
    """Means by word and by window, over texts longer than a part, with marks, other scripts and emojis."""
    rng = np.random.default_rng(2)
    model = Model(rng.standard_normal(1 << toxicity.BITS).astype(np.float32) * 5, -0.7)

    def grams(word):
        w = f"\x02{word}\x03"
        return sum(max(0, len(w) - n + 1) for n in (3, 4, 5)) + 1

    some = ["a", "idiot", "straße", "\U0001f600", "ж" * 9, "co-op"]
    at, n = toxicity.subwords(some)
    assert list(n) == [grams(w) for w in some]
    each = [toxicity.subwords([w])[0] for w in some]
    assert all(sorted(x) == sorted(y) for x, y in zip(np.split(at, np.cumsum(n)[:-1]), each))
    assert model.of_words(some) == pytest.approx([model.table[x].mean() for x in each], rel=1e-4)
    for size in (0, 1, 7, 8, 9, 500):
        chosen = list(rng.choice(some, size))
        values = [float(model.of_words([w])[0]) for w in chosen]
        wins = [values[i : i + toxicity.WINDOW] for i in range(0, size, toxicity.WINDOW)]
        means = [sum(x) / (toxicity.WINDOW if len(wins) > 1 else len(x)) for x in wins]
        want = 1 / (1 + math.exp(-(max(means, default=0) - 0.7)))
        text = "".join(f" ({w.upper() if w != 'straße' else w}),\n" for w in chosen)
        assert model.score(text) == pytest.approx(want, rel=1e-4)
        assert model.score(text, {}) == model.score(text)


def test_parts_and_cache_change_nothing(monkeypatch):
    model = Model(np.random.default_rng(3).standard_normal(1 << toxicity.BITS).astype(np.float32), 0.0)
    text = " ".join(f"w{i % 97}x" for i in range(1_000))
    want = model.score(text)
    monkeypatch.setattr(toxicity, "PART", 11)
    monkeypatch.setattr(toxicity, "CACHE", 5)
    assert model.score(text) == want


def test_gradient_moves_to_the_marked_words():
    rng = np.random.default_rng(4)
    plain = [f"{a}{b}" for a in ("lo", "mi", "sa", "te") for b in ("ran", "pel", "tos", "vin", "gar")]
    texts, labels = [], []
    for i in range(400):
        words = list(rng.choice(plain, rng.integers(20, 120)))
        if i % 4 == 0:
            words[rng.integers(len(words))] = "vexor" + str(rng.choice(["en", "us", "ia", "ol"]))
        texts.append([words[k : k + 8] for k in range(0, len(words), 8)])
        labels.append(int(i % 4 == 0))
    model = toxicity.train(texts, np.array(labels))
    assert model.score("loran mipel vexorqqq " + "satos " * 300) > 0.5 > 0.2 > model.score("loran mipel " + "satos " * 300)  # an ending never seen


def test_edges(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 1), (1, None, 1), (3, 0, 0), (3, 1, 0)], "doc_id long, toxic int, quality int")
    docs = spark.createDataFrame([(i, "vexing words here" if i % 2 else "plain words here", "x", 1) for i in range(60)] + [(None, "plain", None, 2), (70, None, None, 3), (71, "", None, 4), (72, " ,.\n", None, 5), (5, "again " * 3, "y", 6)], "doc_id long, text string, score string, predicted int")
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == 65 and {r.doc_id for r in got if r.text in (None, "", " ,.\n")} == {70, 71, 72}
    assert len({r.score for r in got if r.doc_id in (70, 71, 72)}) == 1
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 60 and r.text.endswith("here"))
    for few in (labels.limit(0), labels.where("toxic = 0")):
        assert all(0 <= r.score <= 1 for r in toxicity.scored(docs, toxicity.fit(docs, few)).collect())
    assert toxicity.scored(docs.limit(0), model).collect() == []
    assert toxicity.fit(docs, labels, F.lit(False)).table.any() == np.False_


def test_a_repeated_id_teaches_once(spark):
    """One id has most rows; the training task gets one of them, so the sample stays bounded."""
    docs = spark.createDataFrame([(1, f"vexing text {i}") for i in range(3_000)] + [(i, "vexing words" if i % 2 else "plain words") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.score("vexing") > 0.3 > model.score("plain")
    few = toxicity.fit(docs, labels, sample=(2, 2))
    assert np.isfinite(few.table).all()
