"""Study plans, cards and presets of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursewright.operators import study as P
from coursewright.operators import units as U
from coursewright.plans.graph import numbered, prerequisites
from coursewright.plans.units import unit_nodes, unit_table, unit_tree, units
from coursewright.session import stage


def plan(s, sf):
    """Units in document order as plan lessons."""
    placed = stage(unit_table(s, sf))
    return stage(
        numbered(placed).withColumnRenamed("k", "position").join(
            placed.select("doc_id", "unit_id", "title", "difficulty", "minutes", "words"), ["doc_id", "unit_id"]
        )
    )


def batched(s, sf):
    p = plan(s, sf)
    return stage(p.join(P.group_milestones(p), ["doc_id", "unit_id"]))


def done(p):
    return p.where(F.col("words") % 2 == 0)


def topological(s, sf):
    placed = units(s, sf)
    edges = prerequisites(placed).select("doc_id", F.col("prerequisite_id").alias("src"), F.col("unit_id").alias("dst"))
    return P.balanced_topological_order(placed.withColumn("ord", F.col("seq")), edges)


def milestone_status(s, sf):
    p = batched(s, sf)
    return P.milestone_status(p, done(p))


def progress_summary(s, sf):
    p = plan(s, sf)
    return P.progress_summary(p, done(p))


def cards(s, sf):
    placed = units(s, sf)
    p = numbered(placed).withColumnRenamed("k", "position")
    status = F.when(F.col("words") % 5 == 0, "MASTERED").when(F.col("words") % 5 == 1, "in_progress").when(
        F.col("words") % 5 == 2, "viewed"
    )
    progress = placed.select("doc_id", "unit_id", status.alias("status")).where(F.col("status").isNotNull())
    return P.lesson_cards(p, placed, U.section_of_unit(placed, unit_tree(placed)), progress)


def configured(name):
    return lambda s, sf: P.apply_config(stage(cards(s, sf)), P.preset(name)).drop("doc_id")


def practice_cards(s, sf):
    placed = units(s, sf)
    section = stage(U.section_of_unit(placed, unit_tree(placed)))
    exercises = stage(
        unit_nodes(s, sf).where(F.col("role") == "exercise").select("doc_id", "unit_id", "node_id", "seq", "text").join(
            section, ["doc_id", "unit_id"]
        )
    )
    heads = section.select("doc_id", "section_id").distinct().join(
        placed.select("doc_id", F.col("unit_id").alias("section_id"), F.col("seq").alias("section_seq")), ["doc_id", "section_id"]
    )
    progress = exercises.where(F.length("text") % 3 == 0).select(
        "node_id", F.lit("practiced").alias("status"), (F.length("text") % 4).cast("long").alias("attempts"),
        (F.length("text") % 10).cast("double").alias("best_score"),
    )
    return P.practice_cards(
        exercises.select("doc_id", "section_id", "node_id", "seq", F.col("text").alias("title")), heads, progress
    ).drop("doc_id")


def quiz_cards(s, sf):
    """One quiz for every unit with exercises; every second one was taken."""
    placed = units(s, sf)
    quizzes = placed.where(F.col("n_exercise") > 0).select(
        "doc_id", F.concat(F.lit("q/"), "unit_id").alias("quiz_id"), "unit_id", "seq", "title", (F.col("n_exercise") * 10).alias("total_points")
    )
    taken = placed.where((F.col("n_exercise") > 0) & (F.col("words") % 2 == 0)).select(
        F.concat(F.lit("q/"), "unit_id").alias("quiz_id"), F.lit("Completed").alias("status"), (F.col("words") % 100).cast("double").alias("score")
    )
    return P.quiz_cards(quizzes, U.section_of_unit(placed, unit_tree(placed)), taken).drop("doc_id")


QUERIES = {
    "quiz_cards": quiz_cards,
    "balanced_topological_order": topological,
    "group_milestones": lambda s, sf: batched(s, sf).select("unit_id", "milestone"),
    "classify_lessons": lambda s, sf: P.classify_lessons(plan(s, sf)).select("unit_id", "position", "lesson_type"),
    "plan_totals": lambda s, sf: P.milestone_totals(batched(s, sf)),
    "milestone_status": milestone_status,
    "progress_summary": progress_summary,
    "order_by_strategy": lambda s, sf: plan(s, sf).orderBy(*P.sort_columns("by_difficulty")).select("unit_id", "difficulty"),
    "lesson_cards": lambda s, sf: cards(s, sf).drop("doc_id"),
    "apply_study_config": configured("compact"),
    "apply_study_config_linear": configured("linear"),
    "practice_cards": practice_cards,
}
