"""Annotation of every node of the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursewright.operators import annotate as A
from coursewright.operators import structure as S
from coursewright.plans.structure import nodes
from coursewright.session import stage

OUT = ["node_id", "ord", "confidence", "term", "body", "kind"]


def single(name, fn):
    def run(s, sf):
        return A.Annotator().register(name, fn).run(nodes(s, sf)).select(*OUT)

    return run


def captioned(s, sf, base=None):
    return stage(S.attach_captions(stage(nodes(s, sf)) if base is None else base).select("doc_id", "node_id", "seq", "node_type", "text", "caption"))


def associations(fn):
    return lambda s, sf: fn(captioned(s, sf)).select("node_id", "confidence", "term", "body")


def key_terms(s, sf):
    hits = A.Annotator().register("key_term", A.key_term_candidates).run(nodes(s, sf))
    return A.first_occurrence_terms(hits).select("doc_id", *OUT)


def annotations(s, sf, base=None):
    return A.annotate(captioned(s, sf, base))


QUERIES = {
    "detect_definitions": single("definition", A.detect_definitions),
    "detect_examples": single("example", A.detect_examples),
    "detect_exercises": single("exercise", A.detect_exercises),
    "detect_objectives": single("objective", A.detect_objectives),
    "detect_summaries": single("summary", A.detect_summaries),
    "detect_callouts": single("callout", A.detect_callouts),
    "detect_cross_refs": single("cross_reference", A.detect_cross_refs),
    "detect_key_terms": single("key_term", A.key_term_candidates),
    "first_occurrence_terms": key_terms,
    "figure_nearby_text": associations(A.figure_nearby_text),
    "equation_nearby_text": associations(A.equation_nearby_text),
    "register_detector": lambda s, sf: annotations(s, sf).groupBy("doc_id", "type", "detector").agg(
        F.count("*").alias("n"), F.max("confidence").alias("top")
    ),
    "dedupe_annotations": lambda s, sf: A.dedupe_annotations(annotations(s, sf)).select(
        "node_id", "type", "confidence", "term", "body"
    ),
}
