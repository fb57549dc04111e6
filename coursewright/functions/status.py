"""Status ladders and labels as column expressions.

Stored statuses are folded to lower case, and a stored ``locked`` means locked.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six item statuses.
STATUSES = ("not_started", "attempted", "familiar", "practiced", "mastered", "locked")
PASSING_SCORE = 70.0


def lesson_status(status: Column, completed_at: Column) -> Column:
    s = F.lower(status)
    return (
        F.when(s == "locked", "locked")
        .when(completed_at.isNotNull(), "mastered")
        .when(s == "in_progress", "attempted")
        .when(s == "viewed", "familiar")
        .otherwise("not_started")
    )


def practice_status(status: Column, attempts: Column, best: Column, required: Column) -> Column:
    s = F.lower(status)
    return (
        F.when(s == "locked", "locked")
        .when((required > 0) & (F.coalesce(best, F.lit(0.0)) >= required) & attempts.isNotNull(), "mastered")
        .when(F.coalesce(attempts, F.lit(0)) > 0, "practiced")
        .when(s == "in_progress", "attempted")
        .otherwise("not_started")
    )


def quiz_status(score: Column, passing: float = PASSING_SCORE) -> Column:
    return F.when(score >= passing, "mastered").when(score.isNotNull(), "attempted").otherwise("not_started")


def goal_status(score: Column, completed_at: Column) -> Column:
    return (
        F.when(completed_at.isNotNull(), "mastered").when(score.isNotNull(), "attempted").otherwise("not_started")
    )


def sidebar_status(status: Column) -> Column:
    return (
        F.when(status == "mastered", "completed")
        .when(status.isin("practiced", "familiar", "attempted"), "in_progress")
        .otherwise("not_started")
    )


def action_label(status: Column) -> Column:
    return (
        F.when(status == "mastered", "Review")
        .when(status.isin("attempted", "practiced", "familiar"), "Continue")
        .otherwise("Start")
    )


def progress_label(required: Column, total: Column) -> Column:
    return F.when(total > 0, F.format_string("Score %d/%d to pass", required, total)).otherwise("")


def format_duration(minutes: Column) -> Column:
    hours = F.floor(minutes / 60).cast("int")
    rest = minutes % 60
    return (
        F.when(minutes <= 0, "")
        .when(minutes < 60, F.format_string("%d min", minutes))
        .when(rest == 0, F.format_string("%d hr", hours))
        .otherwise(F.format_string("%d hr %d min", hours, rest))
    )


def practice_passed(score: Column, required: Column) -> Column:
    return F.when(required > 0, score >= required).otherwise(score > 0)


def quiz_passed(score: Column, passing: float = PASSING_SCORE) -> Column:
    return score >= passing


def pct(part: Column, whole: Column) -> Column:
    """Percentage to two places, halves to even; 0 when there is nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(part / whole * 100, 2))


def combined_status(process: Column, book: Column) -> Column:
    return F.when(book == "failed", "failed").when(book.isin("pending", "processing"), "processing").otherwise(process)


def status_message(process: Column, book: Column) -> Column:
    status = combined_status(process, book)
    busy = book.isin("pending", "processing")
    return (
        F.when((process == "completed") & busy, "Primary pipeline completed; book pipeline is still running")
        .when(
            (book == "failed") | ((process == "completed") & (status == "failed")),
            "Book pipeline failed; call /process/retry to retry",
        )
        .when(status == "completed", "Document processing already completed")
        .when(status == "failed", "Document processing failed; call /process/retry to retry")
        .otherwise("Document processing already started")
    )


def map_difficulty(value: Column) -> Column:
    v = F.lower(value)
    return F.when(v.isin("intermediate", "advanced"), v).otherwise("beginner")


def difficulty_rank(value: Column) -> Column:
    # Basic 0, intermediate 1, advanced 2.
    return F.when(value == "advanced", 2).when(value == "intermediate", 1).otherwise(0)


def map_card_status(status: Column) -> Column:
    s = F.lower(status)
    return F.when(s.isin("in_progress", "completed", "mastered", "practiced", "attempted"), s).otherwise("not_started")


def checkpoint_type(max_rank: Column) -> Column:
    return F.when(max_rank >= 2, "practice").when(max_rank >= 1, "quiz").otherwise("self_test")
