"""Nearest vectors of many queries against a plain version."""

import numpy as np
import pytest

from coursewright.operators import review as R

VECTORS, QUERIES = "vec_id long, embedding array<float>", "name string, query array<double>"


@pytest.mark.parametrize("slices, query_slices", [(None, 1), (3, 4)])
def test_more_queries_than_a_plan_could_hold(spark, slices, query_slices):
    rng = np.random.default_rng(4)
    vectors = rng.integers(-8, 9, (120, 6)).astype(float)
    vectors[60:90] = vectors[7]  # equal vectors: the smaller id first
    vectors[11] = 0
    queries = rng.integers(-8, 9, (1200, 6)).astype(float)
    queries[5] = 0
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], VECTORS)
    asked = spark.createDataFrame([(f"q{i}", q.tolist()) for i, q in enumerate(queries)], QUERIES)
    got = {}
    for r in R.similarity_topk(docs, asked, "name", 5, slices, query_slices).orderBy("name", "rank").collect():
        got.setdefault(r.name, []).append((r.vec_id, round(r.score, 9)))
    assert len(got) == 1199 and "q5" not in got
    for i, q in enumerate(queries):
        if i != 5:
            dots, squares = vectors @ q, (vectors * vectors).sum(1) * (q @ q)
            best = {n: float(dots[n] / np.sqrt(squares[n])) for n in range(120) if n != 11}
            found = got[f"q{i}"]
            assert [s for _, s in found] == pytest.approx(sorted(best.values(), reverse=True)[:5], abs=1e-8)
            assert all(abs(best[n] - s) < 1e-8 for n, s in found)
            assert all(a < b for (a, s), (b, t) in zip(found, found[1:]) if {a, b} <= {7, *range(60, 90)})


def test_odd_vectors_take_no_part(spark):
    odd = [(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [0.0, 0.0]), (7, [1.0]), (8, [])]
    docs = spark.createDataFrame(odd, VECTORS)
    asked = spark.createDataFrame([("a", [2.0, 0.0]), ("b", None), ("c", [0.0, 0.0]), (None, [0.0, 1.0])], QUERIES)
    got = sorted((r.name or "", r.vec_id, r.score) for r in R.similarity_topk(docs, asked, "name").collect())
    assert got == [("", 1, 0.0), ("a", 1, 1.0)]
    assert R.similarity_topk(docs.limit(0), asked, "name").count() == R.similarity_topk(docs, asked.limit(0), "name").count() == 0
