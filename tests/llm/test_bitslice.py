import math

import pytest

from tidemark.llm import bitslice


def brute(rows, queries, k):
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in queries:
        if q in whole:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [100, 8192])
def test_against_brute_force(spark, sf_dir, monkeypatch, block_rows):
    monkeypatch.setattr(bitslice, "BLOCK_ROWS", block_rows)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = bitslice.top_k(vectors, vectors.where("vec_id % 50 = 0")).collect()
    assert sorted(map(tuple, got)) == brute(rows, [i for i, _ in rows if i % 50 == 0], 10)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.5]), (1, [0.5, -0.5]), (2, [0.5, -0.5]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (8, []), (None, [1.0, 1.0]), (9, [-3.7, 900.25]), (10, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rank int, query_id int")
    for k in (1, 2, 50):
        assert sorted(map(tuple, bitslice.top_k(df, df, k).collect())) == brute(rows, [i for i, _ in rows if i is not None], k)
    assert bitslice.top_k(df.limit(0), df).count() == 0 and bitslice.top_k(df, df.limit(0)).count() == 0
