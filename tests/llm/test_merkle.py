"""The Merkle manifest against a plain version."""

import zlib

import brute
import pytest
from pyspark.sql import functions as F

from coursewright.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def proved(spark, rows, tampered=None):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("tree", F.lit(1)).withColumn("at", F.lit("x"))
    carry = {"changed": merkle.leaf_digest(*[F.col(c) if c != "text" else F.upper("text") for c in merkle.FIELDS])}
    found = merkle.manifest(docs, carry=carry)
    out = found.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("path"))).alias("proof"), merkle.fold(F.col("changed"), F.col("path")).alias("folded"))
    return [tuple(r) for r in out.collect()]


def key(row):
    return (row[0] is not None, row[0] or 0, *row[1:])


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [1, 1], [300, 1, 16, 33], [1] * 17 + [20], [4200, 3]])
def test_made_trees(spark, sizes):
    rows = [
        (None if i == 3 else i * 7 % 4211, None if s == 1 else f"s{'é' if s % 2 else ''}{s}", "en" if i % 2 else None, i, None if i % 5 == 0 else f"text Ä {i} {s}")
        for s, n in enumerate(sizes) for i in range(n)
    ]
    want = brute.merkle(rows, lambda r: None if r[4] is None else r[4].upper())
    assert sorted(proved(spark, rows), key=key) == sorted(want, key=key)


def test_repeated_rows_and_ties(spark):
    same = (5, "a", "en", 1, "equal")
    rows = [same] * 40 + [(5, "a", "en", 1, "other"), (None, "a", None, None, None), (None, None, None, None, "")]
    assert sorted(proved(spark, rows), key=key) == sorted(brute.merkle(rows, lambda r: None if r[4] is None else r[4].upper()), key=key)
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame([same], SCHEMA), carry={"path": F.lit(1)})


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*merkle.FIELDS).collect()]
    hurt = lambda r: brute.lower(r[4]) if r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else None
    want = brute.merkle(rows, hurt)
    got = [tuple(r) for r in queries.QUERIES["op11_merkle_manifest"](spark, sf).collect()]
    assert sorted(got) == sorted((*w, w[5] == w[3]) for w in want)
    assert 0 < sum(not g[6] for g in got) < len(got) / 2
