"""The alignment ratio against the standard library's matcher."""

import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from coursewright.functions import alignment
from coursewright.plans import review as plans


def texts(seed, n):
    rng = random.Random(seed)
    made = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(n):
        letters = rng.choice(["ab", "abc ", "abcdefgh ij", "aé日本𝄞b ", "abcdefghijklmnopqrstuvwxyz      ABCDEFG,."])
        a = made(rng.randrange(rng.choice([6, 40, 700])), letters)
        b = list(a)
        for _ in range(rng.randrange(8)):
            p = rng.randrange(len(b) + 1)
            b[p : p + rng.randrange(9)] = made(rng.randrange(9), letters)
        yield a, "".join(b) if rng.random() < 0.6 else made(rng.randrange(700), letters)


@pytest.mark.parametrize("small", [0, 1500])
def test_ratio_on_made_texts(monkeypatch, small):
    monkeypatch.setattr(alignment, "_SMALL", small)
    for a, b in texts(4, 500):
        assert alignment.ratio(a, b) == SequenceMatcher(a=a, b=b).ratio(), (a, b)


def test_every_page_pair(spark, sf):
    pairs = {(r.doc_id, r.page): r for r in plans.pairs(spark, sf).where("review_status = 'reviewed'").collect()}
    got = plans.QUERIES["text_similarity"](spark, sf).collect()
    assert len(got) == len(pairs) > 100
    for r in got:
        p = pairs[r.doc_id, r.page]
        want = SequenceMatcher(a=p.actual_text, b=p.generated_text).ratio()
        known = set(p.generated_text.lower().split())
        lost = list(dict.fromkeys(t for t in p.actual_text.lower().split() if t not in known))
        assert r.ratio == round(want, 6)
        assert (r.missing_count, r.missing_examples) == (len(lost), " ".join(lost[:20]))
        assert r.has_text_loss == (want < 0.92 or bool(lost))
    assert 0 < sum(r.ratio < 1 for r in got) < len(got)


def test_a_page_of_a_megabyte_finishes(spark, sf):
    text = " ".join(r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect())
    text = (text * (1 + 1_000_000 // len(text)))[:1_000_000]
    started = time.time()
    assert 0.9 < alignment.ratio(text, text.replace(" the ", " ")) < 1
    assert 0 < alignment.ratio(text, text[::-1]) < 0.9
    assert time.time() - started < 60


def test_nulls_and_empty_texts(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("", ""), ("", "x")], "a string, b string")
    assert [r[0] for r in df.select(alignment.matching_ratio(F.col("a"), F.col("b"))).collect()] == [None, None, 1.0, 0.0]
