import hashlib
import random
from collections import Counter

import pytest

from tidemark.llm import blocks, substring_dedup


def brute(rows, window):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    times = Counter(tuple(w[j : j + window]) for _, w in split for j in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = set()
        for j in range(len(w) - window + 1):
            if times[tuple(w[j : j + window])] > 1:
                gone.update(range(j, j + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("group_bytes", "piece"), [(8 << 20, 1 << 20), (20_000, 500)])
def test_against_brute_force(spark, sf_dir, monkeypatch, group_bytes, piece):
    monkeypatch.setattr(blocks, "PIECE", piece)
    monkeypatch.setattr(blocks.dealt, "__defaults__", (group_bytes,))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, substring_dedup.dedup(docs).collect()))
    assert got == brute(rows, 35) and sum(r[2] for r in got) > 1000


def test_edge_cases_and_small_windows(spark, monkeypatch):
    monkeypatch.setattr(blocks.dealt, "__defaults__", (300,))
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "z " * 500), (104, rows[5][1] + " é"), (104, rows[5][1] + " é")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, grp int, data string")
    for window in (4, 9):
        got = substring_dedup.dedup(df, window=window, with_text=True).collect()
        assert sorted(tuple(r)[:4] for r in got) == brute(rows, window)
        assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert substring_dedup.dedup(df.limit(0)).count() == 0
