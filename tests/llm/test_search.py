"""Exact top-k search against SQL and a plain version."""

import numpy as np
from compare import compare
from pyspark.sql import functions as F

from coursewright.llm import queries, topk_search


def plain(rows, asked, k):
    out = []
    for q, x in {(q, tuple(x)) for q, x in asked}:
        scored = [(-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in rows if i != q and len(y) == len(x)]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found(spark, rows, asked, k=5):
    schema = "id long, terms array<long>"
    got = topk_search.topk_search(spark.createDataFrame(rows, schema), spark.createDataFrame(asked, schema), k)
    return sorted(tuple(r) for r in got.collect())


def test_query(spark, duck, sf):
    ok, message = compare(spark, duck, "op2", queries.QUERIES["op2_topk_search"], queries.SQL["op2_topk_search"], sf)
    assert ok, message


def test_ties_lengths_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 7)
    monkeypatch.setattr(topk_search, "RANGE_BLOCKS", 3)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 4)
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.integers(-3, 4, 4).tolist()) for i in range(150)]
    rows += [(900, [1, 1, 1]), (901, [2, 0, 0]), (902, []), (903, []), (904, [1 << 40, 1, -(1 << 20), 7])]
    asked = rows[:150:15] + [(900, [1, 1, 1]), (900, [1, 1, 1]), (902, []), (7777, [9]), (904, [1 << 20, 1 << 20, 5, 1])]
    assert found(spark, rows, asked) == plain(rows, asked, 5)
    assert found(spark, rows, []) == [] and found(spark, [], asked) == []


def test_pruning_leaves_blocks_out():
    rng = np.random.default_rng(4)
    centers = rng.integers(-200, 200, (40, 16))
    terms = [centers[b] + rng.integers(-5, 6, (50, 16)) for b in range(40)]
    ids = [np.arange(50) + 50 * b for b in range(40)]
    low, high = np.stack([t.min(axis=0) for t in terms]), np.stack([t.max(axis=0) for t in terms])
    scores, best, scored = topk_search.search_blocks(np.asarray([-1] * 40), centers, ids, terms, low, high, 5)
    want = np.concatenate(terms) @ centers.T
    for q in range(40):
        order = sorted(range(2000), key=lambda i: (-want[i, q], i))[:5]
        assert best[q].tolist() == order and scores[q].tolist() == [want[i, q] for i in order]
    assert scored < 40 * 40 / 4


def test_unsound_vectors_take_no_part(spark):
    rows = [(1, [0.5, -0.001]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("terms", F.lit("clash"))
    assert sorted(tuple(r) for r in topk_search.integer_vectors(table).collect()) == [(1, [128, -1]), (6, [])]
