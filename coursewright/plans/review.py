"""Review, search, vectors, cards and artifact tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursewright.operators import annotate as A
from coursewright.operators import book as B
from coursewright.operators import review as R
from coursewright.operators import search as I
from coursewright.operators import structure as S
from coursewright.plans.structure import nodes
from coursewright.session import stage
from coursewright.sources import sinks as K
from coursewright.sources.tables import table
from coursewright.streaming.streams import new_folder


def pairs(s, sf):
    """Generated text loses a word in every third document; every fifth page was not generated."""
    actual = stage(S.page_contexts(nodes(s, sf)).select("doc_id", "page", "page_text"))
    generated = actual.where(F.col("page") % 5 != 4).withColumn(
        "page_text", F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("page_text", " (?:le|the|der|el) ", " ")).otherwise(F.col("page_text"))
    )
    return R.join_rendered_pages(actual, generated)


def missing(s, sf):
    p = pairs(s, sf).where(F.col("review_status") == "reviewed")
    lost = R.missing_tokens(F.col("actual_text"), F.col("generated_text"))
    return p.select("doc_id", "page", F.size(lost).alias("n"), F.array_join(lost, " ").alias("tokens"))


def verdicts(s, sf):
    k = F.length("actual_text") % 7
    reviews = pairs(s, sf).withColumn(
        "verdict",
        F.when(F.col("review_status") == "reviewed", F.when(k == 0, "rejected").when(k < 3, "needs_revision").otherwise("approved")),
    )
    return R.review_verdict(reviews, "doc_id")


def nearest(s, sf):
    v = table(s, sf, "embeddings")
    return R.similarity_topk(v, R.centroids(v, "label"), "label").select("label", "vec_id", "rank", F.round("score", 6).alias("score"))


def seeds(s, sf):
    hits = A.Annotator().register("definition", A.detect_definitions).run(nodes(s, sf))
    equations = nodes(s, sf).where(F.col("node_type") == "equation").select(
        F.when(F.col("seq") % 2 == 0, F.concat(F.lit(" Eq "), "node_id")).alias("label"), F.col("text").alias("latex")
    )
    return B.flashcard_seeds(hits, equations)


def _profiles(s, sf):
    return nodes(s, sf).groupBy("doc_id", "node_type").agg(F.count("*").alias("n"))


def artifacts(s, sf):
    folder = new_folder(s, "artifacts")
    K.write_artifacts(_profiles(s, sf), folder)
    return K.read_artifacts(s, folder, table(s, sf, "labels").select("doc_id"))


def replaced(s, sf):
    folder = new_folder(s, "artifacts")
    K.write_artifacts(_profiles(s, sf), folder)
    new = table(s, sf, "labels").select("doc_id", F.lit("label").alias("node_type"), (F.col("quality") + 10).cast("long").alias("n"))
    K.replace_by_document(s, folder, new)
    return s.read.parquet(folder).drop("bucket")


def exported(s, sf):
    folder = new_folder(s, "export")
    K.write_json_export({"profiles": _profiles(s, sf)}, folder)
    return s.read.schema("doc_id long, node_type string, n long").json(f"{folder}/profiles")


def searched(s, sf):
    """An index of all documents; every seventh is removed, every fifth comes again in capitals and with a word more."""
    folder = new_folder(s, "index")
    docs = table(s, sf, "documents").select("doc_id", "text", "lang", "source")
    I.add(docs, folder, fields=["lang", "source"])
    I.remove(docs.where("doc_id % 7 = 0"), folder)
    I.add(docs.where("doc_id % 5 = 0").withColumn("text", F.concat(F.lit("The end. "), F.upper("text"))), folder, fields=["lang", "source"])
    again = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("The end. "), F.upper("text"))).otherwise(F.col("text")))
    found = I.search(s, folder, ["The", "and"], [("lang", "in", ["en", "de"]), ("source", "ne", "src3")], 30, 3)
    return I.with_snippets(found, again).select(
        F.col("id").alias("doc_id"), "score", "first_hit", "snippet", F.array_join("highlights", " ").alias("highlights")
    )


QUERIES = {
    "join_rendered_pages": lambda s, sf: pairs(s, sf).select("doc_id", "page", "review_status"),
    "missing_tokens": missing,
    "page_counts": lambda s, sf: R.page_counts(pairs(s, sf)),
    "text_similarity": lambda s, sf: R.text_similarity(pairs(s, sf)),
    "review_verdict": verdicts,
    "search_text": lambda s, sf: R.search_text(table(s, sf, "documents"), "text", "doc_id", ["the", "and"], {"lang": "en"}, 20, 5),
    "search_index": searched,
    "similarity_topk": nearest,
    "flashcard_seeds": seeds,
    "quiz_points": lambda s, sf: table(s, sf, "lineitem").groupBy(F.col("l_suppkey").alias("quiz_id")).agg(
        F.sum("l_quantity").alias("total_points"), F.count("*").alias("n_questions")
    ),
    "read_artifacts": artifacts,
    "replace_by_document": replaced,
    "write_json_export": exported,
}
