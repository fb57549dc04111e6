"""Run-ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursewright.functions import status as S
from coursewright.operators import runs as R
from coursewright.sources import tables as T

TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def moded(s, sf):
    """Runs with a mode: errors make a retry, every ninth run was reset."""
    return T.runs(s, sf).withColumn(
        "run_mode",
        F.when(F.col("run_id") % 9 == 0, "reprocess").when(F.col("retry_count") > 0, "retry").otherwise("process"),
    ).withColumn("failed_stage", F.when(F.col("run_id") % 2 == 0, F.col("failed_stage")))


def resume(s, sf):
    return moded(s, sf).select(
        "run_id", R.resume_stage(F.col("run_mode"), F.col("failed_stage"), F.col("last_completed_stage")).alias("stage")
    )


def pending_work(s, sf):
    runs = moded(s, sf).select(
        "doc_id",
        "run_id",
        R.resume_stage(F.col("run_mode"), F.col("failed_stage"), F.col("last_completed_stage")).alias("wanted"),
    )
    return R.pending_work(runs, R.saved_parts(T.stage_logs(s, sf), T.runs(s, sf)))


def runs_with_stages(s, sf):
    return R.runs_with_stages(T.runs(s, sf), T.stage_logs(s, sf))


def stage_log_summary(s, sf):
    out = R.stage_log_summary(T.stage_logs(s, sf).withColumn("doc_id", T.document_of_run(s, sf)), "doc_id", "stage", "result")
    return out.select(
        "doc_id", "stage", "result", "n",
        F.date_format("first_seen", TS).alias("first_seen"), F.date_format("last_seen", TS).alias("last_seen"),
    )


def advance(s, sf):
    names = F.array(*[F.lit(v) for v in ("pipeline_ok", "book_ok", "error", "restart")])
    outcomes = T.runs(s, sf).select(
        "run_id", F.element_at(names, (F.floor(F.col("run_id") / 3) % 4 + 1).cast("int")).alias("outcome")
    )
    return R.advance_run_state(T.runs(s, sf), outcomes)


def missing_agents(s, sf):
    names = F.array(*[F.lit(v) for v in ("keywords", "summaries", "flashcards", "quizzes", "practice")])
    done = T.table(s, sf, "lineitem").select(
        F.col("l_orderkey").alias("lesson_id"),
        F.element_at(names, (F.col("l_linenumber") % 5 + 1).cast("int")).alias("kind"),
    )
    return R.missing_agents(done, "lesson_id")


def combined(s, sf):
    pair = T.runs(s, sf).select(
        "run_id",
        "status",
        F.when(F.col("run_id") % 5 == 1, "failed")
        .when(F.col("run_id") % 5 == 2, "pending")
        .when(F.col("run_id") % 5 == 3, "completed")
        .alias("book"),
    )
    return pair.select(
        "run_id",
        S.combined_status(F.col("status"), F.col("book")).alias("combined"),
        S.status_message(F.col("status"), F.col("book")).alias("message"),
    )


QUERIES = {
    "resume_stage": resume,
    "pending_work": pending_work,
    "superseded_runs": lambda s, sf: R.superseded_runs(T.runs(s, sf)),
    "runs_with_stages": runs_with_stages,
    "stage_log_summary": stage_log_summary,
    "advance_run_state": advance,
    "missing_agents": missing_agents,
    "combined_status": combined,
}
