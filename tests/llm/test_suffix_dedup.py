import hashlib
import random
from collections import Counter

import pytest

from tidemark.llm import blocks, suffix_dedup


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(t[j : j + length] for _, t in data for j in range(len(t) - length + 1))
    out = []
    for i, t in data:
        gone = bytearray(len(t))
        for j in range(len(t) - length + 1):
            if times[t[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for j in range(len(t)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("group_bytes", [8 << 20, 20_000])
def test_against_brute_force(spark, sf_dir, monkeypatch, group_bytes):
    monkeypatch.setattr(blocks.dealt, "__defaults__", (group_bytes,))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, suffix_dedup.dedup(docs).collect()))
    assert got == brute(rows, 400) and sum(r[3] for r in got) > 10


def made(rng):
    rows = [(i, "".join(rng.choice("abé") for _ in range(rng.randrange(60)))) for i in range(80)]
    common = "".join(rng.choice("xyz") for _ in range(45))
    rows += [(200 + i, "".join(rng.choice("abc") for _ in range(20)) + common + "".join(rng.choice("abc") for _ in range(rng.randrange(30)))) for i in range(30)]
    return rows + [(300, None), (301, ""), (302, "z" * 500), (303, "pq" * 90), (304, rows[3][1] + "!"), (304, rows[3][1] + "!")]


def test_small_strings_and_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(blocks.dealt, "__defaults__", (700,))
    rows = made(random.Random(5))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, grp int, key string")
    for length, anchor in ((12, 5), (30, 8)):
        got = suffix_dedup.dedup(df, length=length, anchor=anchor, with_text=True).collect()
        assert sorted(tuple(r)[:5] for r in got) == brute(rows, length)
        assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert suffix_dedup.dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize(("most", "piece", "in_sort"), [(2000, 1 << 20, 3 << 20), (2, 100, 200), (0, 64, 3 << 20)])
def test_every_way_gives_the_same(monkeypatch, most, piece, in_sort):
    """The stages without Spark: anchors of many contexts, pieces of long texts, sorting in parts."""
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    monkeypatch.setattr(suffix_dedup, "SORTED", in_sort)
    rows, length, anchor, buckets = made(random.Random(7)), 12, 5, 3
    groups = [pa.table({"grp": pa.array([g] * len(rows[g::4]), pa.int32()), "id": [r[0] for r in rows[g::4]], "data": pa.array([(r[1] or "").encode() for r in rows[g::4]], pa.binary())}) for g in range(4)]
    by = lambda t, c, v: t.filter(pa.compute.equal(t[c], v))
    anchors = pa.concat_tables(suffix_dedup._anchors(g, length, anchor, buckets) for g in groups)
    codes = pa.concat_tables(suffix_dedup._codes(by(anchors, "bucket", b)) for b in range(buckets))
    sent = pa.concat_tables(suffix_dedup._sent(g, by(codes, "grp", i), length, anchor, buckets) for i, g in enumerate(groups))
    answers = pa.concat_tables(suffix_dedup._shard(by(anchors, "bucket", b), by(sent, "bucket", b), length, anchor) for b in range(buckets))
    out = pa.concat_tables(suffix_dedup._kept(g, by(answers, "grp", i), length, anchor, False) for i, g in enumerate(groups))
    assert sorted(tuple(r.values()) for r in out.to_pylist()) == brute(rows, length)


def test_an_anchor_with_very_many_contexts(spark):
    """A passage with other surroundings in more texts than a shard takes contexts of one anchor, and one in two texts."""
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, rare, n = letters(80), letters(70), suffix_dedup.MOST_CONTEXTS + 200
    rows = [(i, letters(40 + i % 50) + passage + letters(50)) for i in range(n)]
    rows += [(n, letters(90) + rare + letters(9)), (n + 1, rare + letters(80)), (n + 2, passage[20:] + letters(60)), (n + 3, letters(200))]
    got = sorted(map(tuple, suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), length=60, anchor=16).collect()))
    assert got == brute(rows, 60) and sum(r[2] >= 80 for r in got) >= n
