"""Concepts of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursewright.functions import text as X
from coursewright.operators import annotate as A
from coursewright.operators import concepts as C
from coursewright.operators import structure as S
from coursewright.plans.annotations import annotations
from coursewright.plans.structure import nodes
from coursewright.plans.units import unit_nodes
from coursewright.session import stage
from coursewright.sources.tables import table

LISTS = ("node_ids", "unit_ids", "aliases")


def deduped(s, sf, base=None):
    return A.dedupe_annotations(annotations(s, sf, base))


def pages(s, sf):
    return S.page_contexts(nodes(s, sf))


def raw(s, sf):
    """Both strategies, staged: every concept operator reads it several times."""
    return stage(
        C.run_strategies(
            {
                "annotations": (C.concepts_from_annotations, deduped(s, sf)),
                "text_patterns": (C.text_pattern_concepts, pages(s, sf)),
            }
        )
    )


def merged(s, sf):
    return C.score_importance(C.merge_concepts(raw(s, sf)).drop(*LISTS))


def merged_lists(s, sf):
    """The merged concepts; their lists as lines of one text."""
    return C.merge_concepts(raw(s, sf)).withColumns({c: F.array_join(c, "\n") for c in LISTS})


def links(s, sf):
    return C.concept_nodes(C.concepts_from_annotations(deduped(s, sf)))


def relations(s, sf):
    return C.concept_cooccurrence(stage(links(s, sf)))


def members(s, sf, placed=None):
    return (unit_nodes(s, sf) if placed is None else placed).select("doc_id", "node_id", "unit_id", F.col("seq").alias("unit_seq"))


def mentions(s, sf):
    """How often each document's first word occurs in its text."""
    docs = table(s, sf, "documents").select("doc_id", "text", F.get(X.tokens(F.col("text")), F.lit(0)).alias("term"))
    return docs.where(F.col("term").isNotNull()).select(
        "doc_id", "term", X.count_mentions(F.col("text"), F.col("term")).cast("long").alias("n")
    )


def named(s, sf):
    both = raw(s, sf)
    related = C.concept_cooccurrence(stage(C.concept_nodes(both)))
    kept = C.merge_concepts(both).where(F.col("category") == "definition")
    return C.name_relations(related, kept).select("source_id", "target_id", "source_name", "target_name")


QUERIES = {
    "concepts_from_annotations": lambda s, sf: C.concepts_from_annotations(deduped(s, sf)).select(
        "node_id", "name", "category", "importance"
    ),
    "text_pattern_concepts": lambda s, sf: C.text_pattern_concepts(pages(s, sf)).select(
        "doc_id", "name", "category", "importance", "mentions"
    ),
    "count_mentions": mentions,
    "merge_concepts": merged_lists,
    "score_importance": merged,
    "map_concepts_to_units": lambda s, sf: C.map_concepts_to_units(links(s, sf), members(s, sf)).select("concept_id", "unit_id"),
    "concept_cooccurrence": relations,
    "same_name_relation": lambda s, sf: C.same_name_relation(raw(s, sf)),
    "name_relations": named,
    "register_concept_strategy": lambda s, sf: raw(s, sf).groupBy("doc_id", F.col("emit.strategy").alias("strategy")).agg(
        F.count("*").alias("n"), F.sum("mentions").alias("mentions")
    ),
}
