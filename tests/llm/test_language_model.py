"""Language-model scores: exact counts and base, a normalised model, better than the base on held-out texts."""

import math
import zlib
from collections import Counter

import brute
import numpy as np
from pyspark.sql import functions as F

from coursewright.llm import language_model, queries


def tokens(text):
    return [*brute.words_of(brute.lower(text)), None]


def base_of(rows):
    """rows: (id, text, learned) -> {id: (n, known, total, base)}."""
    counts = Counter(w for _, t, learned in rows if learned for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    floor = math.log10(total + 0.5 * (distinct + 1))
    return {
        i: (len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total, sum(math.log10(counts[w] + 0.5) - floor for w in tokens(t))) for i, t, _ in rows
    }


def check(rows, got):
    want = base_of(rows)
    assert set(want) == {r.doc_id for r in got}
    for r in got:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert math.isfinite(r.score) and r.score <= 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 5 != 1) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.QUERIES["op12_lm_scoring"](spark, sf).collect()
    check(rows, got)
    assert {r.doc_id: not r.held_out for r in got} == {i: learned for i, _, learned in rows}
    for held in (True, False):
        own = [r for r in got if r.held_out is held]
        assert sum(r.score for r in own) > sum(r.base_score for r in own)
    held = [r for r in got if r.held_out]
    assert sum(r.score > r.base_score for r in held) >= 0.8 * len(held)


def test_rare_words_are_joined(spark, sf, monkeypatch):
    """With hardly any frequent words, most counts are joined; the results are the same rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    learned = F.col("doc_id") % 3 != 0
    rows = [(r.doc_id, r.text, r.doc_id % 3 != 0) for r in docs.collect()]
    many = {r.doc_id: r for r in language_model.score_texts(docs, learned).collect()}
    monkeypatch.setattr(language_model, "FREQUENT", 600)
    few = language_model.score_texts(docs, learned).collect()
    check(rows, few)
    for r in few:
        assert abs(r.score - many[r.doc_id].score) < 1e-3 * abs(r.score)


def test_probabilities_of_every_next_word_add_up(spark):
    """After any history, the learned words and one unseen word for each shared slot have probability 1 together."""
    words = [f"w{i}" for i in range(900)]
    texts = [" ".join(words[(i * 7 + j * j) % 900] for j in range(60)) for i in range(80)] + [" ".join(words)]
    rows = [(i, t, True) for i, t in enumerate(texts)]
    probes = [(1000 + i, f"w3 w5 {w}", False) for i, w in enumerate(words)]
    prefix = [(5000, "w3 w5", False)]
    docs = spark.createDataFrame(rows + probes + prefix, "doc_id long, text string, learned boolean")
    got = {r.doc_id: r for r in language_model.score_texts(docs, F.col("learned")).collect()}
    counts = language_model.token_counts(docs.where("learned"))
    model = language_model.train(docs.where("learned").select("text"), counts, F.pmod(F.xxhash64("text"), F.lit(language_model.ROUNDS)))
    hashes = language_model._token_hashes(np.frombuffer(b"w3 w5", np.uint8), np.array([0, 5]))[0]
    v = model.vocabulary
    total = 0.0
    for probe in [f"w3 w5 {w}" for w in words] + ["w3 w5"]:
        h, first = language_model._token_hashes(np.frombuffer(probe.encode(), np.uint8), np.array([0, len(probe)]))
        slot = v.slots(h, v.find(h))
        p = 1.0
        for _, _, values, sums, outcome in language_model._predict(model, language_model._features(h, first), slot):
            p *= values[2, outcome[2]] / sums[2]
        n = v.count[v.find(h)[2]]
        total += p * (1 if slot[2] < language_model.OWN * language_model.SLOTS else (n + 0.5) / v.mass[slot[2]])
    assert 0.9 < total <= 1.0001 and len(hashes) == 3  # the rest is that of unseen words and empty slots
    assert all(math.isfinite(r.score) for r in got.values())


def test_edges(spark):
    rows = [(1, "a b a", True, "x"), (1, "a b a", True, "x"), (None, "A\tB", None, "y"), (2, None, False, None), (3, "", True, ""), (4, "x" * 70_000 + " a", False, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learned boolean, token string").withColumn("score", F.lit("old")).withColumn("none", F.lit(7))
    out = language_model.score_texts(docs, F.col("learned"))
    assert out.columns == ["doc_id", "learned", "token", "none", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.token, r.none) for r in out.collect())
    assert got == [(0, 3, 3, 9, "y", 7), (1, 4, 4, 9, "x", 7), (1, 4, 4, 9, "x", 7), (2, 1, 1, 9, None, 7), (3, 1, 1, 9, "", 7), (4, 3, 2, 9, "z", 7)]
    nothing = language_model.score_texts(docs, F.lit(False)).collect()
    assert [(r.n_known, r.train_tokens) for r in nothing] == [(0, 0)] * 6 and all(math.isfinite(r.score) for r in nothing)
    assert language_model.score_texts(docs.limit(0), F.col("learned")).count() == 0
