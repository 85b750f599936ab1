"""Components: small graphs are folded in a few stages, larger ones go by rounds of stars, with the same roots."""

import numpy as np
import pytest

from tidemark.llm import components as c


def by_hand(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def graphs():
    rng = np.random.default_rng(7)
    yield [(i, i + 1) for i in range(-150, 150)]  # a path
    yield [(1_000, i) for i in range(300)]  # a star whose centre is the greatest
    yield [(int(a), int(b)) for a, b in rng.integers(-(1 << 62), 1 << 62, 40)[rng.integers(0, 40, (35, 2))] if a != b]


@pytest.mark.parametrize("small", [0, c.SMALL])
def test_roots(spark, monkeypatch, small):
    monkeypatch.setattr(c, "SMALL", small)
    for edges in graphs():
        df = spark.createDataFrame([*edges, (edges[0][0], None), (5, 5)], "a long, b long").repartition(3)
        found = c.components(df, "a", "b").collect()
        assert len(found) == len({r.node for r in found})
        assert {r.node: r.root for r in found} == by_hand(edges)


def test_no_edges(spark):
    assert c.components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_small_graph_takes_few_jobs(spark):
    """A path took 97 jobs by rounds (SMALL = 0), each stage of as many tasks as a shuffle has partitions."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    status, group = spark.sparkContext.statusTracker(), "small-graph"
    spark.sparkContext.setJobGroup(group, group)
    try:
        assert len(c.components(edges, "a", "b").collect()) == 201
        jobs = status.getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 6
