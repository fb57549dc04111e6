"""Periodic runs against a version that tries every period at every place."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from coursewright.llm import periodic, queries


def made_texts(seed, n):
    """Random words over small alphabets, powers, Fibonacci words, runs next to runs."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        ws, letters = [], rng.choice([1, 2, 2, 3, 6])
        for _ in range(rng.randrange(1, 6)):
            block = [f"w{rng.randrange(letters)}" for _ in range(rng.randrange(1, rng.choice([3, 9, 40])))]
            ws += block * rng.randrange(1, 9) + block[: rng.randrange(len(block) + 1)]
        out.append(ws)
    a, b = ["a"], ["a", "b"]
    while len(b) < 400:
        a, b = b, b + a
    out += [b, ["x"] * 700, ["x"] * 5, ["x"] * 6, list("abababa"), list("abababab"), b * 4 + a]
    return out


def found(texts):
    data = "\n".join(texts).encode()
    ends = np.cumsum([0, *[len(t.encode()) + 1 for t in texts]])
    ends[-1] -= 1
    start, length, period, owner, count = periodic.find_runs(np.frombuffer(data, np.uint8), ends)
    got = [[] for _ in texts]
    for s, n, q, o in zip(start.tolist(), length.tolist(), period.tolist(), owner.tolist(), strict=True):
        got[o].append((s, n, q))
    return got, count.tolist()


@pytest.mark.parametrize("appended", [1 << 16, 7, 64])
def test_runs_on_made_texts(monkeypatch, appended):
    monkeypatch.setattr(periodic, "_APPENDED", appended)
    texts = made_texts(3, 150 if appended > 60 else 40)
    got, count = found([" ".join(ws) for ws in texts])
    assert count == [len(ws) for ws in texts]
    for ws, runs in zip(texts, got, strict=True):
        assert runs == brute.periodic_runs(ws), ws


def test_a_very_long_text_is_linear():
    once = [f"p{i}" for i in range(5000)]
    ws = ["z"] * 150_000 + once * 40 + ["y", "x"] * 60_000
    (runs,), _ = found([" ".join(ws)])
    assert runs == [(0, 150_000, 1), (150_000, 200_000, 5000), (350_000, 120_000, 2)]


def test_operator_keeps_rows_and_columns(spark):
    rows = [
        (1, "a b a b a b a b a b c", "x", 1), (1, "a b a b a b a b a b c", "x", 1), (None, "q q q q q q q", None, 2), (2, None, "y", 3),
        (3, "", "", 4), (4, " \t\n\r", "", 5), (5, "é é é é é é é", "z", 6),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, place int").withColumn("start", F.array(F.lit(1.5)))
    out = periodic.periodic_runs(docs)
    assert out.columns == ["doc_id", "text", "place", "start", "runs", "collapsed", "n_words"]
    got = sorted((r.place, r.text, [tuple(x) for x in r.runs], r.collapsed, r.n_words, r.start) for r in out.collect())
    assert [g[2:5] for g in got] == [
        ([(0, 10, 2)], "a b c", 11), ([(0, 10, 2)], "a b c", 11), ([(0, 7, 1)], "q", 7), ([], "", 0), ([], "", 0), ([], "", 0),
        ([], "é é é é é é é", 6),
    ]
    assert all(g[5] == [1.5] for g in got)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_query_against_plain(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    changed = 0
    for r in queries.QUERIES["op13_periodic_runs"](spark, sf).collect():
        ws = brute.words_of(docs[r.doc_id])
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and ws:
            changed += 1
            g = h // 10
            a = g % len(ws)
            p = 1 + (len(ws) - a) // (3 + g % 8)
            ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
        runs = brute.periodic_runs(ws) if len(ws) < 1500 else None
        if runs is None:
            continue
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2])) if runs else None
        want = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == want
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == sha(brute.collapsed(ws, runs))
    assert changed > 10
