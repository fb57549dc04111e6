"""Learning units of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursewright.operators import structure as S
from coursewright.operators import trees as R
from coursewright.operators import units as U
from coursewright.plans.annotations import annotations
from coursewright.plans.structure import nodes
from coursewright.session import stage


def unit_nodes(s, sf, base=None):
    """Nodes with their units; ``base`` are the corpus's nodes where a plan has staged them already."""
    base = stage(nodes(s, sf)) if base is None else base
    return U.build_units(stage(S.repair_heading_levels(base.drop("parent_id"))))


def unit_table(s, sf, placed=None):
    return U.unit_profile(unit_nodes(s, sf) if placed is None else placed)


def typed_units(s, sf, placed=None):
    return stage(U.unit_types(stage(unit_table(s, sf, placed))))


def units(s, sf, placed=None):
    """Units with type and parent, staged for the tree operators; ``placed`` are nodes with units, staged already."""
    return stage(U.unit_parents(typed_units(s, sf, placed)))


def unit_tree(placed):
    return stage(R.closure(placed, ["doc_id"], "unit_id", "parent_id", 3))


def scoped(s, sf):
    return U.scope_annotations(annotations(s, sf), unit_nodes(s, sf)).select(
        "unit_id", "node_id", "list_kind", "ord", "summary"
    )


def rollup(s, sf):
    placed = units(s, sf)
    return U.rollup_unit_tree(placed, unit_tree(placed)).drop("doc_id")


def section_of(s, sf):
    placed = units(s, sf)
    return U.section_of_unit(placed, unit_tree(placed)).drop("doc_id")


def cards(s, sf):
    placed = units(s, sf)
    tree = unit_tree(placed)
    lessons = placed.where(F.col("unit_type") == "lesson").select("doc_id", "unit_id", "words")
    return U.section_cards(
        placed, U.rollup_unit_tree(placed, tree), tree, lessons.where(F.col("words") % 2 == 0),
        lessons.where(F.col("words") % 3 != 0), min_lessons=1,
    ).drop("doc_id")


def navigation(s, sf):
    placed = units(s, sf)
    return R.preorder(placed, ["doc_id"], "unit_id", "parent_id", "seq", unit_tree(placed)).where(
        F.col("depth") < 3
    ).select("unit_id", "position", "depth")


QUERIES = {
    "unit_table": lambda s, sf: unit_table(s, sf),
    "build_units": lambda s, sf: unit_nodes(s, sf).select("unit_id", "node_id", "role"),
    "unit_study_time": lambda s, sf: unit_table(s, sf).select("unit_id", "words", "minutes"),
    "unit_difficulty": lambda s, sf: unit_table(s, sf).groupBy("doc_id", "difficulty").agg(F.count("*").alias("n")),
    "unit_types": lambda s, sf: U.unit_types(stage(unit_table(s, sf))).select("unit_id", "unit_type"),
    "unit_parents": lambda s, sf: U.unit_parents(typed_units(s, sf)).select("unit_id", "unit_type", "parent_id"),
    "unit_parents_lexical": lambda s, sf: U.unit_parents(typed_units(s, sf), "lexical").select("unit_id", "parent_id"),
    "scope_annotations_to_units": scoped,
    "rollup_unit_tree": rollup,
    "section_of_unit": section_of,
    "section_cards": cards,
    "navigation_order": navigation,
}
