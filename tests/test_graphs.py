"""Cycles of graphs against plain peeling, and how many rounds they take."""

import random

from coursewright.operators import trees


def peeled(edges):
    edges = set(edges)
    while True:
        targets = {(k, d) for k, _, d in edges}
        left = {(k, s, d) for k, s, d in edges if (k, s) in targets}
        if left == edges:
            return {(k, d) for k, _, d in edges}
        edges = left


def found(spark, edges):
    vertices = sorted({(k, v) for k, *ends in edges for v in ends})
    out = trees.acyclic_remainder(
        spark.createDataFrame(vertices, "doc_id long, vertex long"), spark.createDataFrame(edges, "doc_id long, src long, dst long"), ["doc_id"]
    )
    return {(r.doc_id, r.vertex) for r in out.collect()}


def test_random_graphs(spark):
    rng = random.Random(8)
    edges = []
    for k in range(150):
        n = rng.randrange(2, 14)
        edges += [(k, rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 2 * n))]
    for k in range(150, 180):  # each vertex has one predecessor: cycles and trees
        edges += [(k, rng.randrange(20), v) for v in range(20)]
    for k in range(180, 200):  # no cycle, many predecessors
        edges += [(k, *sorted(rng.sample(range(9), 2))) for _ in range(20)]
    assert found(spark, edges) == peeled(edges)


def test_a_long_chain_takes_logarithmic_rounds(spark, monkeypatch):
    n, jobs = 10_000, []
    real = trees.stage
    monkeypatch.setattr(trees, "stage", lambda df: jobs.append(1) or real(df))
    chain = [(1, i, i + 1) for i in range(n)]
    ring = [(2, i, (i + 1) % n) for i in range(n)] + [(2, 7, n + i) for i in range(3)]
    assert found(spark, chain + ring) == {(2, v) for v in range(n + 3)}
    assert len(jobs) < 40


def test_no_edges_and_loops(spark):
    assert found(spark, [(1, 5, 5), (1, 5, 6), (1, 4, 6), (2, 5, 6)]) == {(1, 5), (1, 6)}
    none = spark.createDataFrame([], "doc_id long, src long, dst long")
    assert trees.acyclic_remainder(spark.createDataFrame([(1, 1)], "doc_id long, vertex long"), none, ["doc_id"]).count() == 0
