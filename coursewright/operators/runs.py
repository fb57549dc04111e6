"""The run ledger: resumption, retries, supersession and stage logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursewright.operators.sequence import ordered_join
from coursewright.sources.tables import STAGES

# Each stage and the stage a run resumes from when it must redo it.
RESUME_AT = {
    "parser": "parser", "normalizer": "parser", "page_grouping": "page_grouping", "enricher": "page_grouping",
    "unit_builder": "page_grouping", "concept_extractor": "page_grouping", "graph_builder": "graph_builder",
    "sequence_builder": "sequence_builder", "pipeline": "sequence_builder",
}
# The agent kinds a lesson must complete.
AGENT_KINDS = ("flashcards", "keywords", "practice", "quizzes", "summaries")


def _lookup(pairs: dict[str, str], key: Column, default: str) -> Column:
    mapping = F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])
    return F.coalesce(F.try_element_at(mapping, key), F.lit(default))


def resume_stage(run_mode: Column, failed_stage: Column, last_completed: Column) -> Column:
    """Where a run starts: its failed stage, else the one after the last completed."""
    after = {a: RESUME_AT[b] for a, b in zip(STAGES, STAGES[1:], strict=False)}
    after[STAGES[-1]] = "sequence_builder"
    retry = F.when(failed_stage.isNotNull(), _lookup(RESUME_AT, failed_stage, "parser")).otherwise(
        _lookup(after, F.coalesce(last_completed, F.lit("")), "parser")
    )
    return F.when(run_mode == "retry", retry).otherwise("parser")


def pending_work(runs: DataFrame, saved: DataFrame) -> DataFrame:
    """Wanted stage per run, or ``parser`` when a part it needs was not saved.

    ``saved`` flags (document, units, concepts, graph) per doc_id.
    """
    parts = ["document", "units", "concepts", "graph"]
    rows = runs.join(saved, "doc_id", "left").na.fill(False, parts)
    document, units, concepts, graph = (F.col(c) for c in parts)
    ready = (
        F.when(F.col("wanted") == "page_grouping", document)
        .when(F.col("wanted") == "graph_builder", document & units & concepts)
        .when(F.col("wanted") == "sequence_builder", document & units & concepts & graph)
        .otherwise(True)
    )
    return rows.select("doc_id", "run_id", "wanted", F.when(ready, F.col("wanted")).otherwise("parser").alias("stage"))


def saved_parts(logs: DataFrame, runs: DataFrame) -> DataFrame:
    """Parts a document has from its successful stages."""
    done = logs.where(F.col("result") == "success").join(runs.select("run_id", "doc_id"), "run_id")

    def has(stage: str) -> Column:
        return F.bool_or(F.col("stage") == stage)

    return done.groupBy("doc_id").agg(
        has("normalizer").alias("document"),
        has("unit_builder").alias("units"),
        has("concept_extractor").alias("concepts"),
        has("graph_builder").alias("graph"),
    )


def superseded_runs(runs: DataFrame) -> DataFrame:
    """Pending runs older than the newest run of their document become cancelled."""
    newest = runs.groupBy("doc_id").agg(F.max("run_id").alias("_newest"))
    old = (F.col("status") == "pending") & (F.col("run_id") < F.col("_newest"))
    return runs.join(newest, "doc_id").select(
        "run_id", "doc_id", F.when(old, "cancelled").otherwise(F.col("status")).alias("status")
    )


def runs_with_stages(runs: DataFrame, logs: DataFrame) -> DataFrame:
    """Each run with its ordered stages; a run without logs gets one synthetic stage."""
    line = F.concat_ws(":", "stage", "result")
    listed = logs.groupBy("run_id").agg(
        F.count("*").cast("int").alias("n"), ordered_join(line, F.struct("created_at", "log_id"), ">").alias("stages")
    )
    return runs.select("run_id", "status").join(listed, "run_id", "left").select(
        "run_id",
        "status",
        F.coalesce("n", F.lit(1)).alias("n_stages"),
        F.coalesce("stages", F.concat(F.lit("pipeline:"), F.col("status"))).alias("stages"),
    )


def stage_log_summary(logs: DataFrame, *keys: str) -> DataFrame:
    return logs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen")
    )


def advance_run_state(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Apply one outcome per run: pipeline_ok, book_ok, error or restart."""
    rows = runs.join(outcomes, "run_id", "left")
    outcome, status = F.col("outcome"), F.col("status")
    spent = F.col("retry_count") + 1 >= F.col("max_retries")
    pending = status == "pending"
    waiting = (status == "processing") & F.coalesce(F.col("last_completed_stage") == "pipeline", F.lit(False))
    requeue = (outcome == "restart") & (status == "processing") & ~waiting
    retried = pending & (outcome == "error") & ~spent
    new_status = (
        F.when(pending & (outcome == "pipeline_ok"), "processing")
        .when(waiting & (outcome == "book_ok"), "completed")
        .when(pending & (outcome == "error") & spent, "failed")
        .when(requeue, "pending")
        .otherwise(status)
    )
    return rows.select(
        "run_id",
        new_status.alias("status"),
        F.when(F.coalesce(retried | requeue, F.lit(False)), "retry").otherwise("process").alias("run_mode"),
        (F.col("retry_count") + F.when(F.coalesce(retried, F.lit(False)), 1).otherwise(0)).alias("retry_count"),
        F.when(pending & (outcome == "pipeline_ok"), "pipeline")
        .otherwise(F.col("last_completed_stage"))
        .alias("last_completed_stage"),
    )


def missing_agents(completions: DataFrame, key: str, kinds: Sequence[str] = AGENT_KINDS) -> DataFrame:
    """Required kinds a lesson has not completed, and its completed/failed status."""
    required = F.array(*[F.lit(k) for k in sorted(kinds)])
    missing = F.array_except(required, F.collect_set("kind"))
    return completions.groupBy(key).agg(
        F.array_join(missing, ",").alias("missing"),
        F.when(F.size(missing) == 0, "completed").otherwise("failed").alias("status"),
    )
