import zlib
from collections import Counter

from tidemark.llm import sharding


def test_every_row_once_near_equal_bytes_gapless(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = sharding.shard(docs, str(tmp_path / "m"), 40).collect()
    want = {r.doc_id: (len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == want and len(rows) == len(want)
    load = Counter()
    for r in rows:
        load[r.shard] += r["size"]
    assert sorted(load) == list(range(40)) and max(load.values()) < 1.01 * min(load.values())
    for s in range(40):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_growth_moves_slots_only_into_the_new_shard(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = str(tmp_path / "m")
    rows = sharding.records(docs)
    sharding.store_map(sharding.first_map(sharding.slot_loads(rows), 10), path)
    old = sharding.load_map(spark, path)
    sharding.store_map(sharding.grown_map(old, 10), path)
    before = {r.vslot: r.shard for r in sharding.load_map(spark, path, 1).collect()}
    after = {r.vslot: (r.shard, r.bytes) for r in sharding.load_map(spark, path).collect()}
    assert before.keys() == after.keys() and all(a in (before[v], 10) for v, (a, _) in after.items())
    share = sum(b for s, b in after.values() if s == 10) / sum(b for _, b in after.values())
    assert 0.06 < share <= 1 / 11


def test_edge_cases(spark, tmp_path):
    docs = spark.createDataFrame([(None, None, 1, 2), (None, "", 1, 2), (5, "é", 1, 2), (5, "é", 1, 2), (6, "x" * 100_000, 1, 2)], "doc_id long, text string, shard int, bytes int")
    rows = sharding.shard(docs, str(tmp_path / "a"), 3).collect()
    assert len(rows) == 5 and sorted(r["size"] for r in rows) == [16, 16, 18, 18, 100_016]
    assert sharding.shard(docs.limit(0), str(tmp_path / "b"), 3).count() == 0


def test_deal_against_brute_force(spark, tmp_path):
    """Slots' bytes summed and dealt in plain Python, largest first to the shard that holds least; positions count on by
    virtual slot."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    records = {r.doc_id: r for r in sharding.records(docs, 256).collect()}
    bytes_of, n_of = Counter(), Counter()
    for r in records.values():
        bytes_of[r.vslot] += r["size"]
        n_of[r.vslot] += 1
    held, shard_of, begin, counts = [0] * 7, {}, {}, Counter()
    for v in sorted(bytes_of, key=lambda v: (-bytes_of[v], -v)):
        shard_of[v] = held.index(min(held))
        held[shard_of[v]] += bytes_of[v]
    for v in sorted(shard_of):
        begin[v] = counts[shard_of[v]]
        counts[shard_of[v]] += n_of[v]
    rows = sharding.shard(docs, str(tmp_path / "m"), 7, 256).collect()
    assert {r.doc_id: r.shard for r in rows} == {d: shard_of[r.vslot] for d, r in records.items()}
    for r in rows:
        v = records[r.doc_id].vslot
        assert begin[v] <= r.slot < begin[v] + n_of[v]
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
