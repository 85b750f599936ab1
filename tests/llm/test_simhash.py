import numpy as np
import xxhash

from tidemark.llm import simhash

SCHEMA = "doc_id long, text string, node string, fingerprint string"


def brute(rows, n=3, radius=3):
    fps = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (doc, _), g in zip(rows, group):
        least[g] = min(doc, least.get(g, doc))
    return sorted((doc, f"{f:016x}", least[g]) for (doc, _), f, g in zip(rows, fps, group))


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "One"), (4, "one"), (5, "a b c d"), (5, "a b c d"), (6, " \t "), (7, "é É x"), (8, "w " * 300_000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    assert sorted(map(tuple, simhash.near_duplicates(df).collect())) == brute(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.near_duplicates(spark.createDataFrame([(None, "a b c d e")], "doc_id long, text string")).collect()[0].component_id is None


def test_links_hold_together_planted_chains(spark):
    rng = np.random.default_rng(1)
    chain = [int(rng.integers(0, 2**63))]
    for _ in range(200):
        x = chain[-1]
        for bit in rng.choice(64, int(rng.integers(1, 4)), replace=False):
            x ^= 1 << int(bit)
        chain.append(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in dict.fromkeys(chain)]
    df = spark.createDataFrame([(x,) for x in signed], "simhash long")
    from tidemark.llm.components import components

    roots = components(simhash.links(df), "a", "b").collect()
    assert len(roots) == len(signed) and len({r.root for r in roots}) == 1


def test_large_cell_keeps_every_group():
    base = np.uint64(0x123456789ABCDEF0)
    fp = np.unique(np.array([base ^ np.uint64(1 << i) ^ np.uint64(1 << j) for i in range(20) for j in range(20, 40)], np.uint64))
    a, b = map(np.concatenate, zip(*simhash._cell_links(np.zeros(len(fp), np.int64), fp, 3)))
    assert len(a) == len(fp) - 1 and (np.bitwise_count(a ^ b) <= 3).all()
