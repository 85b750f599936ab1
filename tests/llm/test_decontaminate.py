import random
import re

from tidemark.llm import decontaminate


def plain(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).strip()


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_finds_every_exact_passage(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
    items = [(r.item_id, f" {plain(r.text)} ") for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in f" {plain(r.text)} "}
    assert len(want) >= 26 and got == want
    kept = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_edits_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(6, 30)))) for i in range(12)]
    docs = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randrange(40))]
        if i % 2:
            item = list(items[rng.randrange(12)][1])
            for _ in range(rng.randrange(0, 10)):
                item[rng.randrange(len(item))] = rng.choice(["", "x", "yy", " "])
            text.insert(rng.randrange(len(text) + 1), "".join(item))
        docs.append((i, "!! ".join(text).upper() if i % 3 == 0 else " ".join(text)))
    want = {}
    for d, text in docs:
        for i, item in items:
            if (n := distance(plain(item), plain(text))) <= int(len(plain(item)) * 0.05):
                want[d, i] = n
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for at_once in (8 << 20, 300):
        monkeypatch.setattr(decontaminate, "AT_ONCE", at_once)
        got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.matches(df, bench).collect()}
        assert got.keys() == want.keys() and got == want and len(want) > 12


def test_no_length_or_budget_loses_a_match(spark):
    """Items of 12 to 60 letters with every number of edits that their budget allows, spread or side by side, in the middle
    and at the ends of texts."""
    rng = random.Random(5)
    letters = lambda n, of="abcdefghij": "".join(rng.choice(of) for _ in range(n))
    for rate, lengths in ((0.05, range(12, 61)), (0.12, range(12, 61, 6))):
        items = [(m, letters(m)) for m in lengths]
        docs = []
        for m, item in items:
            for k in range(int(m * rate) + 1):
                for spread in range(4):
                    text = list(item)
                    for e in range(k):
                        at = m // 2 + e if spread == 3 else round((e + 1) * m / (k + 1))
                        text[min(at, m - 1)] = ("x", "", text[min(at, m - 1)] + "y", "x")[spread]
                    docs.append((len(docs), ("", letters(30, "klmn"))[len(docs) % 2] + "".join(text) + ("", letters(30, "klmn"))[len(docs) // 2 % 2], m))
        want = {(d, i): n for d, text, _ in docs for i, item in items if (n := distance(item, text)) <= int(i * rate)}
        assert {(d, m) for d, _, m in docs} <= want.keys()
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.matches(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), bench, rate=rate).collect()}
        assert got == want


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "?!", 1), (4, "so Go home", 1), (4, "so Go home", 1), (None, "x " * 500_000 + "a quick brown fox jumps over it", 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, None), (8, ""), (9, "go"), (10, "A quick, brown fox; jumps over"), (11, "om")], "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.item_id) for r in decontaminate.matches(docs, bench).collect()))
    assert got == [(0, 10), (4, 9), (4, 9)]
    assert decontaminate.matches(docs.limit(0), bench).count() == 0 == decontaminate.matches(docs, bench.limit(0)).count()
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [1, 2, 3]
