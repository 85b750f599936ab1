"""Spelling variants against plain loops over every pair of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows, one_in=199, least_letters=6, least=5):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_letters:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= least}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(n, times=5):
    out = {}
    for w, k in n.items():
        by = sorted((-m, v) for v, m in n.items() if near(w, v))
        form = by[0][1] if by and -by[0][0] >= times * k else None
        out[w] = [form, k, len(by), n[form] if form else None]
    def root(w):
        return w if out[w][0] is None else root(out[w][0])
    return {(w, f, root(w), k, m, fn) for w, (f, k, m, fn) in out.items()}


def got(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_counts_equal_plain_loops(spark, monkeypatch):
    """Parts that end within runs, capitals, letters of both alphabets, other scripts, nulls, empty texts, repeated rows,
    and columns whose names clash with the result's."""
    monkeypatch.setattr(variants, "PART", 7)  # seen here only; tasks have their own
    rng = np.random.default_rng(5)
    parts = ["Kraftwerk", "Ärgernis", "école×e", "Жelly", "straße", "CAFÉs", "a", "÷÷", "x1y", "\U0001f600lamp", "étoile"]
    rows = [(int(i), " -\n".join(rng.choice(parts, 40))) for i in range(30)]
    rows += [(None, "lantern " * 9), (None, None), (4, ""), (5, " ,.\t"), (6, "zz" * 50_000), (7, "abcdef" * 3), *[(8, "copies copied")] * 6]
    docs = spark.createDataFrame([(k, x, "w", 1) for k, x in rows], "doc_id long, text string, word string, n int")
    for one_in in (199, 3, 0):
        assert {r.word: r.n for r in variants.counted(docs, one_in=one_in, least_letters=3, least=2).collect()} == brute_counts(rows, one_in, 3, 2)
    for text in (x for _, x in rows if x):
        assert b" ".join(w for ws in variants._runs(text) for w in ws).decode("latin-1").split() == [r.translate(LOWER) for r in re.findall("[A-Za-zÀ-ÿ]+", text)]


@pytest.mark.parametrize("seed", range(3))
def test_groups_equal_all_pairs(spark, seed):
    """Few letters, so that words have many neighbours, doubled letters and ties."""
    rng = np.random.default_rng(seed)
    n = {}
    for _ in range(400):
        w = "".join(rng.choice(list("abéÿ"), rng.integers(1, 7)))
        n[w] = int(rng.choice([5, 5, 25, 30, 200, 1000, 20_000]))
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    want = brute_groups(n)
    assert got(variants.grouped(df)) == want and max(k[4] for k in want) > 3
    assert any(f and r != f for _, f, r, _, _, _ in want)


def test_a_long_chain_of_forms(spark):
    words = {"a" * 6 + "b" * i: 5**i for i in range(1, 14)}
    found = {r.word: r.root for r in variants.grouped(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert set(found.values()) == {"a" * 6 + "b" * 13}


def test_a_full_filter_costs_rows_only(spark, monkeypatch):
    df = spark.createDataFrame([("lantern", 50), ("lanterns", 5), ("lamtern", 10), ("pattern", 7)], "word string, n long")
    ones = np.full(1 << 13, 255, np.uint8)
    every = {(r.word, r.near) for r in variants.neighbours(df, "ab", ones).collect()}
    assert all(near(a, b) for a, b in every) and len(every) == variants.neighbours(df, "ab", ones).count()
    want = got(variants.grouped(df))
    monkeypatch.setattr(variants, "_filter", lambda words, bits: ones)
    assert got(variants.grouped(df)) == want == {("lantern", None, "lantern", 50, 2, None), ("lanterns", "lantern", "lantern", 5, 1, 50), ("lamtern", "lantern", "lantern", 10, 1, 50), ("pattern", None, "pattern", 7, 0, None)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variants.grouped(variants.counted(docs)).collect() == []
    with pytest.raises(ValueError):
        variants.grouped(spark.createDataFrame([], "word string, n long"), 1)
