import math
import re
from collections import Counter

import numpy as np

from tidemark.llm import langid

FOREIGN = [
    "W Krakowie padał wczoraj deszcz, a mieszkańcy spieszyli się do domów, niosąc zakupy i parasole. Stary zegar na wieży wybił dziewiątą, kiedy ostatni tramwaj odjechał.",
    "Eilen illalla satoi kovasti, ja ihmiset kiiruhtivat koteihinsa kantaen ostoksiaan ja sateenvarjojaan. Vanha kello tornissa löi yhdeksän, kun viimeinen raitiovaunu lähti.",
    "Dün akşam çok yağmur yağdı ve insanlar alışverişlerini ve şemsiyelerini taşıyarak evlerine koştular. Kuledeki eski saat dokuzu vurduğunda son tramvay duraktan ayrıldı.",
    "Tegnap este nagyon esett az eső, és az emberek hazasiettek a bevásárlással és az esernyőikkel. A toronyban a régi óra kilencet ütött, amikor az utolsó villamos elindult.",
]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, ~langid.held_out("doc_id"))
    rows = langid.predict(docs, model).where(langid.held_out("doc_id")).collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert not any(r.rejected for r in rows) and all(0 <= r.score <= 1 for r in rows)


def test_edge_cases(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog " * 5, "en"), ("der Hund und die Katze " * 5, "de"), ("the dog", "en"), ("und die", "de"), ("x" * 3_000_000, None)])]
    rows += [(10, None, "en"), (11, "", "en"), (12, "123 -- 77", "de"), (12, "123 -- 77", "de"), (None, "the dog and", "en"), (13, "日本語 漢字", None)]
    df = spark.createDataFrame([(*r, 0.5, True) for r in rows], "doc_id long, text string, lang string, share double, learn boolean")
    got = langid.predict(df, langid.fit(df)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[2].lang_pred == "en" and by[3].lang_pred == "de" and by[None].lang_pred == "en"
    assert all((by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True) for i in (10, 11, 12))
    assert by[13].rejected and by[13].lang_pred in ("en", "de")
    empty = langid.fit(df.limit(0))
    assert langid.predict(df.limit(0), empty).count() == 0
    assert {r.lang_pred for r in langid.predict(df, empty).collect()} == {"und"}


def test_unlearned_languages_are_rejected_and_clean_texts_stay(spark):
    """Latin-script texts of other languages and random letters, also with one of them among the rows to learn from."""
    rng = np.random.default_rng(0)
    noise = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(80))
    foreign = spark.createDataFrame([(-1 - i, t) for i, t in enumerate([*FOREIGN, noise])], "doc_id long, text string")
    for sf, most in (("sf0.01", 0), ("sf0.1", 2)):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text", "lang")
        odd = spark.createDataFrame([(-9, FOREIGN[0][::-1], "en")], "doc_id long, text string, lang string")
        model = langid.fit(docs.where(~langid.held_out("doc_id")).union(odd))
        got = langid.predict(docs.where(langid.held_out("doc_id")).select("doc_id", "text").union(foreign), model).where("rejected").collect()
        assert {r.doc_id for r in got if r.doc_id < 0} == {-1, -2, -3, -4, -5}
        assert sum(r.doc_id >= 0 for r in got) <= most


def grams_of(text):
    """Hashed n-grams of one to three letters by plain integers; None without a letter."""
    letters = re.sub(r"[\W\d_]+", " ", text.lower()).lstrip()
    if not letters:
        return None
    a, b, top = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 1 << 64
    c = [32, *map(ord, letters), 32]
    two = [(x * b + y) % top for x, y in zip(c, c[1:])]
    out = Counter()
    for g in [*c[1:-1], *((x + (b >> 3)) % top for x in two), *((x * b + y) % top for x, y in zip(two, c[2:]))]:
        mixed = g * a % top
        out[(mixed ^ (mixed >> 29)) * a % top >> (64 - langid.BITS)] += 1
    return out


def test_answers_against_brute_force(spark):
    """Document frequencies, TF-IDF, cosines and rejection of every text of a table, in plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    short = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate([*FOREIGN, "a", "zz qq", "xkcd wvut", "the", "12 34", None])], "doc_id long, text string, lang string")
    docs = docs.union(short)
    model = langid.fit(docs)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    found = {d: grams_of(t) if t is not None else None for d, t, _ in rows}
    known = [found[d] for d, _, lang in rows if lang is not None and found[d]]
    df = Counter(g for x in known for g in x)
    idf = [math.log((1 + len(known)) / (1 + df[g])) + 1 for g in range(1 << langid.BITS)]
    assert np.allclose(model.idf, idf, rtol=1e-5)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    rejected = 0
    for d, _, _ in rows:
        x, r = found[d], got[d]
        if x is None:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        v = {g: math.log1p(n) * idf[g] for g, n in x.items()}
        norm = math.sqrt(sum(y * y for y in v.values()))
        cosines = [sum(y * float(c[g]) for g, y in v.items()) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        near = cosines[best] / math.sqrt(sum(sorted((float(y) ** 2 for y in model.centroids[best]), reverse=True)[: len(v)]))
        limit = model.least[best] * len(v) / (len(v) + langid.FEW)
        assert abs(r.score - cosines[best]) < 1e-4
        if sorted(cosines)[-1] - sorted(cosines)[-2] > 1e-4:
            assert r.lang_pred == model.langs[best]
            assert abs(near - limit) < 1e-4 or r.rejected == (near < limit)
        rejected += r.rejected
    assert 4 <= rejected < 20
