"""Matchings in rounds against one walk over all rows."""

import random

from pyspark.sql import functions as F

from coursewright.operators import book as B
from coursewright.operators import matching as M


def test_dominant_pairs_are_the_greedy_ones(spark):
    rng = random.Random(2)
    pairs = [(k, a, b, rng.randrange(1, 4)) for k in range(30) for a in range(7) for b in range(6) if rng.random() < 0.4]
    want = set()
    for k, a, b, _ in sorted(pairs, key=lambda p: (p[0], -p[3], p[1], p[2])):
        if not any(x == k and (a == y or b == z) for x, y, z in want):
            want.add((k, a, b))
    df = spark.createDataFrame(pairs, "k long, a long, b long, n long")
    assert {tuple(r) for r in M.dominant_pairs(df, ["k"], "a", "b", "n").select("k", "a", "b").collect()} == want
    assert M.dominant_pairs(df.limit(0), ["k"], "a", "b", "n").count() == 0


def test_a_document_with_many_overlaps(spark):
    n = 3000
    segments = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("segment"), F.col("id").cast("string").alias("node_id"))
    units = spark.range(n).select(
        F.lit(1).cast("long").alias("doc_id"), (n - 1 - F.col("id")).alias("unit_ord"), F.concat(F.lit("u"), n - 1 - F.col("id")).alias("unit_id"),
        F.col("id").cast("string").alias("node_id"),
    )
    out = B.assign_units_by_overlap(segments, units)
    assert out.where(F.col("unit_id") == F.concat(F.lit("u"), n - 1 - F.col("segment"))).count() == n


def served(asks, offers):
    """asks: (at, first, second, fixed) of one group; offers: (queue, place, offer)."""
    used, out = set(), {}
    for at, first, second, fixed in sorted(asks):
        chosen = fixed
        for name in () if fixed is not None else (first, second):
            left = [o for q, p, o in sorted(offers) if q == name and name is not None and o not in used]
            if left:
                chosen = left[0]
                break
        if chosen is not None:
            used.add(chosen)
            out[at] = chosen
    return out


def test_served_in_order_is_the_walk(spark):
    rng = random.Random(5)
    asks, offers, want = [], [], set()
    for k in range(60):
        names = ["a", "b", "c", None][: rng.randrange(2, 5)]
        own = [(rng.choice("abc"), p, 100 + p) for p in range(rng.randrange(12))]
        given = [
            (at, rng.choice(names), rng.choice(names), 100 + rng.randrange(14) if rng.random() < 0.2 else None) for at in range(rng.randrange(1, 16))
        ]
        asks += [(k, *a) for a in given]
        offers += [(k, *o) for o in own]
        want |= {(k, at, o) for at, o in served(given, own).items()}
    out = M.served_in_order(
        spark.createDataFrame(asks, "k long, at long, first string, second string, fixed long"),
        spark.createDataFrame(offers, "k long, queue string, place long, offer long"), "k",
    )
    assert {(r.k, r.at, r.offer) for r in out.collect()} == want


def test_a_title_that_all_share_is_served_at_once(spark):
    n = 5000
    book = spark.range(n).select(
        F.lit(1).alias("course_id"), F.col("id").alias("ord"), F.lit(None).cast("string").alias("unit_id"), F.lit("Intro").alias("title"), F.lit("").alias("unit_title")
    )
    course = spark.range(n).select(
        F.lit(1).alias("course_id"), F.col("id").alias("lesson_id"), F.lit(None).cast("string").alias("plan_id"), F.lit("intro ").alias("title"), (F.col("id") % 3).alias("display_order")
    )
    got = {r["ord"]: r.lesson_id for r in B.resolve_lessons(book, course).collect()}
    assert got == dict(enumerate(sorted(range(n), key=lambda i: (i % 3, i))))


def test_groups_are_served_without_rounds(spark, monkeypatch):
    rng = random.Random(9)
    sizes = {1: 3, 2: 40, 3: 7, 4: 25}
    asks = [(k, at, rng.choice("abc"), rng.choice(["b", None]), 5 + at if at % 6 == 5 else None) for k, n in sizes.items() for at in range(n)]
    offers = [(k, "abc"[p % 3], p, p) for k, n in sizes.items() for p in range(n)]
    nulls = [(None, 0, "a", None, None), (1, None, "a", None, None), (2, None, "a", None, 77)]
    args = (
        spark.createDataFrame(asks + nulls, "k long, at long, first string, second string, fixed long"),
        spark.createDataFrame([*offers, (None, "a", 0, 9), (1, None, 0, 9)], "k long, queue string, place long, offer long"), "k",
    )
    want = {(2, None, 77)}
    for k in sizes:
        want |= {(k, at, o) for at, o in served([a[1:] for a in asks if a[0] == k], [o[1:] for o in offers if o[0] == k]).items()}
    staged = []
    plain = M.stage
    monkeypatch.setattr(M, "stage", lambda df: staged.append(1) or plain(df))
    assert {(r.k, r.at, r.offer) for r in M.served_in_order(*args).collect()} == want
    assert len(staged) <= 2
    monkeypatch.setattr(M, "GROUP_ROWS", 30)  # groups 2 and 4 in rounds
    assert {(r.k, r.at, r.offer) for r in M.served_in_order(*args).collect()} == want
    monkeypatch.setattr(M, "GROUP_ROWS", 0)
    assert {(r.k, r.at, r.offer) for r in M.served_in_order(*args).collect()} == want
