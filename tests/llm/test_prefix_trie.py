"""The trie of conversations' prefixes against plain dictionaries."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture
def many_parts(spark):
    """Tables this small in more than one partition, and rounds of merging that meet two at a time."""
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in held.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def brute(rows, lent=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if lent else 0
        base = c - int(np.fmod(c, 100))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends, parent, depth, chars = defaultdict(list), defaultdict(list), {"": None}, {"": 0}, {"": 0}
    for c, turns in built.items():
        key = ""
        members[key].append(c)
        for role, text in turns:
            below = hashlib.sha256(f"{key}{len(role)} {role}{text}".encode()).hexdigest()
            parent[below], depth[below], chars[below], key = key, depth[key] + 1, len(text), below
            members[key].append(c)
        ends[key].append(c)
    kids, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        kids[parent[k]] += 1
    for k, m in members.items():
        at = k
        while at is not None:
            saved[at] += (len(m) - 1) * chars[k]
            leaves[at] += k not in kids
            at = parent[at]
    return sorted((min(m), depth[k], min(members[parent[k]]) if k else -1, len(m), kids[k] if k in kids else 0, leaves[k], saved[k], ",".join(map(str, sorted(ends[k])))) for k, m in members.items())


def got(df, lent=True):
    runs = prefix_trie.runs(df)
    runs = prefix_trie.rebuilt(runs) if lent else runs.select("conv_id", F.col("start").alias("own"), "start", "digests", "chars", "whole")
    nodes, ends = prefix_trie.trie(runs)
    listed = defaultdict(list)
    for r in ends.orderBy("block").collect():
        assert len(r.ends) <= prefix_trie.BLOCK
        listed[bytes(r.node)] += r.ends
    found = prefix_trie.with_parents(nodes).join(prefix_trie.ends_sha256(ends), "node", "left").collect()
    for r in found:
        ids = ",".join(map(str, listed[bytes(r.node)]))
        assert (r.ends_sha256 or hashlib.sha256(b"").hexdigest()) == hashlib.sha256(ids.encode()).hexdigest()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved, ",".join(map(str, listed[bytes(r.node)]))) for r in found)


@pytest.mark.parametrize("seed", range(2))
def test_random_conversations(spark, seed, many_parts, monkeypatch):
    """Few texts, so that prefixes are shared; gaps and nulls in turns, null roles and texts, conversations without a base,
    exact copies, repeated rows, columns with names of the result's."""
    monkeypatch.setattr(prefix_trie, "FAN", 2)
    monkeypatch.setattr(prefix_trie, "DEPTHS", 3)
    rng = np.random.default_rng(seed)
    rows = []
    for c in (*range(0, 60), *range(130, 180), 10**12 + 7):
        for turn in range(int(rng.integers(1, 9))):
            rows.append((c, None if turn == 0 and rng.random() < 0.3 else turn * 2, [None, "", "user", "bot"][rng.integers(4)], [None, "", "a b", "äöü \U0001f600"][rng.integers(4)]))
    rows += [(c, t, "user", f"same {t}") for c in range(300, 330) for t in range(4)] + [rows[3]] * 3 + [(None, 1, "user", "nobody's")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"node": F.lit("x"), "part": F.lit(1), "digest": F.lit(2)}).repartition(3)
    keyed = [(c, t, r, x) for c, t, r, x in rows]
    # turns that stand at one place are ordered by digest, not by text: make these unambiguous
    seen, unique = set(), []
    for r in keyed:
        if (r[0], r[1]) not in seen or r in unique:
            unique.append(r)
            seen.add((r[0], r[1]))
    assert got(spark.createDataFrame(unique, SCHEMA).repartition(3)) == brute(unique)
    assert got(spark.createDataFrame(unique, SCHEMA), lent=False) == brute(unique, lent=False)
    assert prefix_trie.runs(df).where("conv_id IS NULL").count() == 0


def test_one_conversation_with_most_turns(spark, many_parts, monkeypatch):
    """It crosses runs and partitions; another one follows it for 1,500 turns; the base of its hundred is short."""
    rows = [(107, t, "user", f"turn {t % 900}") for t in range(4_000)] + [(150, t, "user", f"turn {t % 900}" if t < 1_500 else "other") for t in range(1_600)]
    rows += [(c, t, "bot", f"{c} {t}") for c in (100, 101, 120, 230) for t in range(2)] + [(31, 0, "bot", "alone")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    runs = prefix_trie.runs(df)
    assert runs.agg(F.max("n")).first()[0] <= prefix_trie.RUN and runs.where("conv_id = 107").count() > 7 and runs.agg(F.sum("n")).first()[0] == len(rows)
    want = brute(rows)
    assert got(df) == want
    monkeypatch.setattr(prefix_trie, "TOGETHER", 2)  # hashes of runs are folded in blocks
    assert got(df) == want
    assert got(df, lent=False) == brute(rows, lent=False)


def test_many_ends_at_one_node(spark, many_parts):
    rows = [(c, t, "user", f"copy {t}") for c in range(0, 4_000) for t in range(2)]
    assert got(spark.createDataFrame(rows, SCHEMA), lent=False) == brute(rows, lent=False)


def test_texts_of_nodes_and_empty_tables(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, None, "there"), (2, 0, "user", "hi"), (2, 1, "bot", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    nodes, _ = prefix_trie.trie(prefix_trie.runs(df).withColumn("own", F.col("start")))
    assert {(r.depth, r.role, r.text, r.n_convs) for r in prefix_trie.with_texts(nodes, df).collect()} == {(0, None, None, 2), (1, "user", "hi", 2), (2, "", "there", 1), (2, "bot", "", 1)}
    assert got(df.limit(0)) == []
    assert got(spark.createDataFrame([(5, None, None, None)], SCHEMA)) == brute([(5, None, None, None)])
