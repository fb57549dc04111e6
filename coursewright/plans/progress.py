"""Learner analytics over the course tree and the progress facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursewright.functions import status as S
from coursewright.operators import progress as P
from coursewright.operators import tables as O
from coursewright.plans.tables import cards
from coursewright.sources import tables as T


def latest(s, sf):
    return O.latest_per_key(T.progress_events(s, sf), ["user_id", "lesson_id"], "event_id")


def enrolled(s, sf):
    """A learner takes every section a progress fact of theirs touches."""
    touched = T.progress_events(s, sf).select("user_id", "lesson_id").distinct()
    return touched.join(T.lessons(s, sf).select("lesson_id", "section_id"), "lesson_id").select(
        "user_id", "section_id"
    ).distinct()


def attach_lessons(s, sf):
    return P.attach_lessons(enrolled(s, sf), T.lessons(s, sf), latest(s, sf))


def attach_practices(s, sf):
    practices = T.practices(s, sf)
    return P.attach_practices(enrolled(s, sf), practices, P.practice_totals(T.attempts(s, sf), practices))


def attach_quizzes(s, sf):
    return P.attach_quizzes(enrolled(s, sf), T.quizzes(s, sf), T.quiz_results(s, sf))


def squares(s, sf):
    return P.progress_squares(attach_lessons(s, sf), attach_practices(s, sf), attach_quizzes(s, sf))


def items(s, sf):
    return P.section_items(T.lessons(s, sf), T.practices(s, sf), T.quizzes(s, sf))


def complete(s, sf):
    return P.section_mastered(T.dense_progress(s, sf), T.lessons(s, sf))


def unlock_wave(s, sf):
    return P.unlock_wave(complete(s, sf), P.next_section(T.sections(s, sf)), items(s, sf))


def initial_progress(s, sf):
    enrolments = T.table(s, sf, "supplier").select(
        F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").cast("long").alias("unit_id")
    )
    return P.initial_progress(enrolments, T.sections(s, sf), items(s, sf))


def study_page(s, sf):
    sections = T.sections(s, sf)
    c = cards(s, sf)
    return P.study_pages(
        squares(s, sf),
        sections,
        P.unit_totals(T.lessons(s, sf), sections),
        c.where(F.col("user_id").isNotNull() & ~F.col("is_generated")),
        c.where(F.col("user_id").isNotNull() & F.col("is_generated")),
    )


QUERIES = {
    "join_hierarchy": lambda s, sf: P.join_hierarchy(T.lessons(s, sf), T.sections(s, sf), T.course_units(s, sf)),
    "resolve_parent_key": lambda s, sf: P.resolve_parent_key(T.practices(s, sf), "practice_id", T.sections(s, sf)),
    "attach_progress": attach_lessons,
    "attach_practices": attach_practices,
    "attach_quizzes": attach_quizzes,
    "flag_exists": lambda s, sf: O.flag_exists(
        T.lessons(s, sf).select("lesson_id"), T.progress_events(s, sf), "lesson_id", "has_notes"
    ),
    "practice_totals": lambda s, sf: P.practice_totals(T.attempts(s, sf), T.practices(s, sf)),
    "score_attempt": lambda s, sf: T.attempts(s, sf).join(
        T.practices(s, sf).select("practice_id", "required_correct"), "practice_id"
    ).select(
        "event_id",
        S.practice_passed(F.col("score"), F.col("required_correct")).alias("passed"),
        S.quiz_passed(F.col("score") * 50).alias("quiz_passed"),
    ),
    "progress_squares": squares,
    "status_histogram": lambda s, sf: P.status_histogram(squares(s, sf), "user_id"),
    "mastery_pct": lambda s, sf: P.mastery(squares(s, sf), "user_id", "section_id"),
    "unit_totals": lambda s, sf: P.unit_totals(T.lessons(s, sf), T.sections(s, sf)),
    "section_mastered": complete,
    "next_section": lambda s, sf: P.next_section(T.sections(s, sf)),
    "unlock_wave": unlock_wave,
    "initial_progress": initial_progress,
    "study_page": study_page,
    "status_ladders": lambda s, sf: T.progress_events(s, sf).select(
        "event_id",
        S.lesson_status(F.col("status"), F.col("completed_at")).alias("lesson"),
        S.map_card_status(F.col("status")).alias("card"),
        S.quiz_status(F.col("score")).alias("quiz"),
    ),
    "format_duration": lambda s, sf: T.lessons(s, sf).select(
        "lesson_id", S.format_duration((F.col("lesson_id") % 400).cast("int")).alias("label")
    ),
}
