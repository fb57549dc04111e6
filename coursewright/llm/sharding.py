"""Rendezvous sharding: the key and the list of weighted shards decide where a row lives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursewright.session import stage

#: Rows numbered together by one window partition.
BUCKET_ROWS = 100_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the best draw for ``key``; a null key is a key of its own.

    Each shard draws u in (0, 1) from a digest of (key, shard) and scores -ln(u) / weight;
    the smallest score wins, ties to the smaller shard.  A new shard only takes rows for
    which its own draw is best, so no row moves between old shards.
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("every shard needs a weight above 0")
    name = F.coalesce(key.cast("string"), F.lit("\u0000"))
    draws = []
    for shard, weight in enumerate(weights):
        digest = F.substring(F.md5(F.concat_ws("/", name, F.lit(str(shard)))), 1, 13)
        u = (F.conv(digest, 16, 10).cast("double") + 0.5) / float(1 << 52)
        draws.append(F.struct((-F.log(u) / weight).alias("score"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*draws))["shard"] if len(draws) > 1 else F.lit(0)


def shard_rows(
    docs: DataFrame, weights: Sequence[float], *, key: str = "doc_id", text: str = "text",
    grown: Sequence[float] | None = None, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Every row of ``docs`` as (key, size, text_crc32, law, shard, slot, grown_shard).

    ``size`` is the UTF-8 length of the text plus 1 (null text: 1), ``slot`` numbers the
    rows of a shard from 0 without gaps, ``grown_shard`` is the shard under ``grown``
    (default: one more shard of weight 1).  Rows that repeat a key share its shard and have
    slots of their own.  An empty table gives an empty result; other columns are ignored.

    Only narrow rows are staged.  They are numbered inside (shard, bucket) and shifted by the
    sizes of the buckets before; buckets are drawn by row, so a key that many rows repeat is
    spread as well.
    """
    grown = [*weights, 1.0] if grown is None else grown
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stage(
        docs.select(
            F.col(key).alias("key"),
            (F.octet_length(body).cast("long") + 1).alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            rendezvous(F.col(key), weights).alias("shard"),
            rendezvous(F.col(key), grown).alias("grown_shard"),
            F.xxhash64(key, F.monotonically_increasing_id()).alias("draw"),
        )
    )
    buckets = max(1, -(-rows.count() // (bucket_rows * len(weights))))
    rows = rows.withColumn("bucket", F.pmod("draw", F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        rows.groupBy("shard", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("key", "text_crc32", "size", "draw")
    numbered = rows.withColumn("at", F.row_number().over(inside).cast("long") - 1)
    return numbered.join(base, ["shard", "bucket"]).select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("base") + F.col("at")).alias("slot"),
        "grown_shard",
    )
