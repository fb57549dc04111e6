"""Milestones against one walk over each document's lessons."""

import random

import pytest
from pyspark.sql import functions as F

from coursewright.operators import study


def walked(lessons, size):
    number, n, last, out = 0, 0, None, {}
    for position, unit, level in sorted(lessons):
        if n >= size or (n >= 2 and level != last):
            number, n = number + 1, 0
        out[unit] = number
        n, last = n + 1, level
    return out


@pytest.mark.parametrize("block, size", [(512, 4), (2, 4), (3, 3), (4, 1)])
def test_milestones_are_the_walk(spark, monkeypatch, block, size):
    monkeypatch.setattr(study, "MILESTONE_BLOCK", block)
    rng = random.Random(block)
    plan, want = [], {}
    for d in range(25):
        own = [(p, f"{d}/{p}", rng.choice(["beginner", "intermediate", None])) for p in range(rng.randrange(1, 45)) if d % 2 or rng.random() < 0.8]
        plan += [(d, u, p, level) for p, u, level in own]
        want |= {(d, u): m for u, m in walked(own, size).items()}
    out = study.group_milestones(spark.createDataFrame(plan, "doc_id long, unit_id string, position long, difficulty string"), size)
    assert {(r.doc_id, r.unit_id): r.milestone for r in out.collect()} == want
    assert out.columns == ["doc_id", "unit_id", "milestone"]


def test_one_document_is_spread(spark):
    n = 300_000
    plan = spark.range(n).select(
        F.lit(7).cast("long").alias("doc_id"), F.col("id").cast("string").alias("unit_id"), F.col("id").alias("position"), F.lit("beginner").alias("difficulty")
    )
    out = study.group_milestones(plan)
    assert out.where(F.col("milestone") == F.expr("CAST(unit_id AS BIGINT) div 4")).count() == n
    assert "Python" not in out._jdf.queryExecution().toString() and "MapInPandas" not in out._jdf.queryExecution().toString()
    assert study.group_milestones(plan.limit(0)).count() == 0
