"""Review of generated pages, ranked text search and nearest vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursewright.functions import text as X
from coursewright.functions.alignment import matching_ratio
from coursewright.operators.search import first_place

SIMILAR = 0.92


def join_rendered_pages(actual: DataFrame, generated: DataFrame) -> DataFrame:
    """Page by page; ``canonical_missing`` where nothing was generated."""
    g = generated.select("doc_id", "page", F.col("page_text").alias("generated_text"))
    joined = actual.select("doc_id", "page", F.col("page_text").alias("actual_text")).join(g, ["doc_id", "page"], "left")
    return joined.withColumn(
        "review_status", F.when(F.col("generated_text").isNull(), "canonical_missing").otherwise("reviewed")
    )


def missing_tokens(actual: Column, generated: Column) -> Column:
    """Distinct tokens of the actual text that the generated one lacks, in order."""
    return F.array_except(X.tokens(F.lower(actual)), X.tokens(F.lower(generated)))


def page_counts(pairs: DataFrame) -> DataFrame:
    """Characters and tokens of both texts of reviewed pages."""
    def of(side: str) -> list[Column]:
        text = F.col(f"{side}_text")
        return [F.length(text).alias(f"text_char_count_{side}"), F.size(X.tokens(F.lower(text))).alias(f"token_count_{side}")]

    return pairs.where(F.col("review_status") == "reviewed").select("doc_id", "page", *of("actual"), *of("generated"))


def text_similarity(pairs: DataFrame, minimum: float = SIMILAR, max_missing: int = 0, examples: int = 20) -> DataFrame:
    """Alignment ratio and lost tokens of reviewed pages; two empty pages match fully.

    ``missing_examples`` shows the first ``examples`` lost tokens, ``missing_count`` counts all.
    Pages are aligned one by one where they lie; a page's texts are all that a task holds.
    """
    lost = missing_tokens(F.col("actual_text"), F.col("generated_text"))
    scored = pairs.where(F.col("review_status") == "reviewed").select(
        "doc_id",
        "page",
        matching_ratio("actual_text", "generated_text", digits=None).alias("exact"),
        F.size(lost).alias("missing_count"),
        F.array_join(F.slice(lost, 1, examples), " ").alias("missing_examples"),
    )
    low = (F.col("exact") < minimum) | (F.col("missing_count") > max_missing)
    return scored.select("doc_id", "page", F.round("exact", 6).alias("ratio"), "missing_count", "missing_examples", low.alias("has_text_loss"))


def review_verdict(reviews: DataFrame, key: str) -> DataFrame:
    """Per document: the worst verdict of its reviewed pages, and the counts in one line."""
    ok = F.col("review_status") == "reviewed"
    n = {v: F.count_if(F.col("verdict") == v) for v in ("approved", "needs_revision", "rejected")}
    done = F.count_if(ok)
    return reviews.groupBy(key).agg(
        F.when(done == 0, "needs_revision")
        .when(F.count_if(ok & (F.col("verdict") == "rejected")) > 0, "rejected")
        .when(F.count_if(ok & (F.col("verdict") == "needs_revision")) > 0, "needs_revision")
        .otherwise("approved")
        .alias("verdict"),
        F.format_string(
            "Reviewed %d page(s): %d reviewed, %d skipped/errors; %d approved, %d needs_revision, %d rejected.",
            F.count("*"), done, F.count("*") - done, n["approved"], n["needs_revision"], n["rejected"],
        ).alias("summary"),
    )


def search_text(
    df: DataFrame, column: str, key: str, terms: Sequence[str], filters: Mapping[str, object], limit: int, offset: int = 0
) -> DataFrame:
    """Rows by descending count of the terms, with the place of the first hit, both of whole words.

    This reads all texts; ``search.search`` answers from a stored index.
    """
    kept = reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), filters.items(), df)
    counts = [X.count_mentions(F.col(column), F.lit(t)) for t in terms]
    places = [first_place(F.col(column), t) for t in terms]
    scored = kept.select(
        key, reduce(lambda a, b: a + b, counts).cast("long").alias("score"), (F.least(*places) if len(places) > 1 else places[0]).alias("first_hit")
    )
    return scored.where(F.col("score") > 0).orderBy(F.col("score").desc(), key).offset(offset).limit(limit)


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """Mean vector per group; sums combine map-side per (group, dimension)."""
    flat = vectors.select(group, F.posexplode("embedding").alias("d", "v"))
    means = flat.groupBy(group, "d").agg(F.avg(F.col("v").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("d", "m")))
    return means.groupBy(group).agg(F.transform(ordered, lambda p: p["m"]).alias("query"))


def _total(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def _measured(df: DataFrame, vector: str, size: str) -> DataFrame:
    """``df`` with the length of ``vector``; without vectors that have no direction."""
    length = F.sqrt(_total(F.transform(vector, lambda x: x.cast("double") * x.cast("double"))))
    return df.withColumn(size, length).where((F.col(size) > 0) & (F.col(size) < float("inf")))


def similarity_topk(
    vectors: DataFrame, queries: DataFrame, on: str, k: int = 5, slices: int | None = None, query_slices: int = 1
) -> DataFrame:
    """The ``k`` nearest of all vectors to each query (``on``, query), by cosine, ties to the smaller vec_id.

    Any number of queries meets all vectors in the cells of a grid: vectors are dealt over
    ``slices`` (the number of shuffle partitions by default) and sent once for each of the
    ``query_slices``, queries are sent once for each of the ``slices``.  Raise ``query_slices``
    with the queries, so that a cell's queries fit a task.  Lengths are taken once a vector, and the rank
    filter prunes per task before its shuffle.  Every pair is scored: the result is exact.
    Vectors and queries that are null, hold null or a number that is not finite, or have length
    zero take no part; a pair of unequal dimensions has no score.
    """
    slices = slices or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = _measured(vectors.select("vec_id", "embedding"), "embedding", "_size")
    left = left.withColumn("_slice", dealt("vec_id", slices)).withColumn("_part", each(query_slices))
    right = _measured(queries.select(on, "query"), "query", "_length")
    right = right.withColumn("_part", dealt(on, query_slices)).withColumn("_slice", each(slices))
    dot = _total(F.zip_with("embedding", "query", lambda x, y: x.cast("double") * y.cast("double")))
    met = left.join(right, ["_slice", "_part"]).select(on, "vec_id", (dot / (F.col("_size") * F.col("_length"))).alias("score"))
    w = Window.partitionBy(on).orderBy(F.col("score").desc(), "vec_id")
    return met.where("score IS NOT NULL").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
