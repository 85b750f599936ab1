import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import similar


def sets_of(rows, n=5):
    out = {}
    for d, text in rows:
        words = (text or "").encode().lower().split()
        out[d] = frozenset(b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()
    return out


def alike_pairs(rows, similarity=0.8):
    """(a, b) of different sets with at least the similarity, by an index of all shingles."""
    ids, where = {}, {}
    for d, s in sets_of(rows).items():
        ids.setdefault(s, d)
    for s, d in ids.items():
        for x in s:
            where.setdefault(x, []).append(s)
    pairs = []
    for s, d in ids.items():
        for other, shared in Counter(o for x in s for o in where[x] if ids[o] > d).items():
            if shared >= similarity * (len(s) + len(other) - shared) - 1e-9:
                pairs.append((d, ids[other]))
    return pairs


def groups_of(rows, pairs):
    group = {d: d for d, _ in rows}
    first = {}
    for d, s in sets_of(rows).items():
        pairs = [*pairs, (first.setdefault(s, d), d)]

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        group[b] = a
    return {d: top(d) for d in group}


def test_links_of_all_documents(spark):
    """All pairs of sf0.1 with a similarity of 0.8 or more: nearly all are joined, and nothing else is."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    pairs = alike_pairs(rows)
    found = {r.doc_id: r.component_id for r in similar.similar_groups(docs).collect()}
    joined = sum(found[a] == found[b] for a, b in pairs)
    assert len(pairs) > 30 and joined >= 0.95 * len(pairs)
    true = groups_of(rows, pairs)
    assert all(true[d] == true[c] for d, c in found.items())


def test_one_of_each_of_similar_texts(spark):
    """Texts of known similarity: copies of 0.9 and over are found, those under 0.6 stay."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in rng.integers(0, 50_000, 400 * 60)]
    rows, near, far = [], [], []
    for d in range(60):
        text = words[d * 400 : d * 400 + 400]
        rows.append((d, " ".join(text)))
        for k, (edits, kept) in enumerate(((3, near), (30, far))):
            copy = list(text)
            for at in np.linspace(5, 390, edits).astype(int):
                copy[at] = f"x{at}"
            kept.append(1000 * (k + 1) + d)
            rows.append((kept[-1], " ".join(copy)))
    rows += [(5000 + i, rows[0][1]) for i in range(40)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, w0 int, own int")
    left = {r.doc_id for r in similar.one_of_each(df).collect()}
    assert {*range(60)} <= left and {*far} <= left and not any(i >= 5000 for i in left)
    assert not left & {*near}


def copies(rng, n, edits):
    text = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(text))]
    for d in range(1, n):
        copy = list(text)
        for at in rng.choice(np.arange(4, 396, 8), edits, replace=False):
            copy[at] = f"x{d}x{at}"
        rows.append((d, " ".join(copy)))
    return rows


def test_dense_groups(spark):
    """Hundreds of differing copies, near the limit on both sides: 8 edits leave 0.82 of the original, 9 leave 0.80."""
    for edits in (7, 8, 10):
        rows = copies(np.random.default_rng(edits), 301, edits)
        want = groups_of(rows, alike_pairs(rows))
        found = {r.doc_id: r.component_id for r in similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert all(want[d] == want[c] for d, c in found.items())
        assert sum(found[d] == c for d, c in want.items()) >= 0.98 * len(rows)


def test_large_neighbourhood_is_checked_by_cells(spark, monkeypatch):
    rows = copies(np.random.default_rng(4), 200, 5)
    monkeypatch.setattr(similar, "CELL_TEXTS", 16)
    found = {r.component_id for r in similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {0}


def test_nulls_empty_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "One two"), (5, "one TWO"), (6, "one"), (7, "a b c d e f"), (7, "q r s t u v"), (8, "q r s t u v"), (9, "w " * 300_000), (None, "one")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, same int")
    found = sorted((r.doc_id, r.component_id) for r in similar.similar_groups(df).collect())
    assert found == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7), (7, 7), (8, 7), (9, 9)]
    assert similar.similar_groups(df.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in similar.one_of_each(df).collect()) == ["1", "4", "6", "7", "9", "None"]


def test_contracted_links_join_the_same(spark):
    """Links of many members to many firsts against their union in plain Python: the same parts, with far fewer links."""
    draw, groups = random.Random(5), [(range(0, 20), range(20, 300)), (range(300, 303), range(303, 310)), (range(400, 401), range(401, 402))]
    links = {(f, m) for firsts, members in groups for m in members for f in draw.sample(list(firsts), min(15, len(firsts)))}
    columns = [c + n for c in "ab" for n in ("", "1", "2", "3")]
    rows = spark.createDataFrame([(a, 0, 0, -a, b, 0, 0, -b) for a, b in links], ", ".join(f"{c} long" for c in columns))
    found = [(r.a, r.b) for r in similar.contracted(rows).collect()]

    def parts(pairs):
        of = {x: x for pair in links for x in pair}
        for a, b in pairs:
            old, new = of[a], of[b]
            of = {x: new if y == old else y for x, y in of.items()}
        return sorted(sorted(x for x in of if of[x] == y) for y in set(of.values()))

    assert parts(found) == parts(links) and all(a < b for a, b in found)
    assert len(found) < len(links) / 5 and similar.contracted(rows.limit(0)).count() == 0


def test_sets_go_out_to_cells_that_are_apart(spark, monkeypatch):
    """Near copies of one text in many cells: after two tables of cells nearly nothing is left to send, and what a plain
    check of all pairs joins is joined."""
    rows = copies(np.random.default_rng(6), 240, 4) + [(1000 + d, t.replace("w", "v")) for d, t in copies(np.random.default_rng(7), 60, 9)]
    monkeypatch.setattr(similar, "CELL_TEXTS", 8)
    sent, linked = [], similar._linked
    monkeypatch.setattr(similar, "_linked", lambda asked, *rest: sent.append(asked.agg(F.sum(F.size("cells"))).first()[0] or 0) or linked(asked, *rest))
    found = {r.doc_id: r.component_id for r in similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = groups_of(rows, alike_pairs(rows))
    assert all(want[d] == want[c] for d, c in found.items()) and sum(found[d] == c for d, c in want.items()) >= 0.98 * len(rows)
    assert len(sent) <= 3 and sum(sent) < 4 * len(rows), sent
