"""Readers for the base tables and the course/progress/run views derived from them.

The derivations are total functions of the rows: every row of a base table takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(spark: SparkSession, sf_dir: str, name: str) -> Column:
    """The number of rows of a base table, read from its file footers; its keys are 0 to one less."""
    return F.lit(table(spark, sf_dir, name).count())


# ---- course tree -----------------------------------------------------------------


def courses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").select(
        F.col("r_regionkey").cast("long").alias("course_id"), F.col("r_name").alias("title")
    )


def course_units(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("unit_id"),
        F.col("n_regionkey").cast("long").alias("course_id"),
        F.col("n_name").alias("title"),
    )


def sections(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("section_id"),
        F.col("c_nationkey").cast("long").alias("unit_id"),
        F.col("c_name").alias("title"),
        F.col("c_custkey").alias("display_order"),
        F.col("c_mktsegment").alias("segment"),
    )


def lessons(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("lesson_id"),
        F.col("o_custkey").alias("section_id"),
        F.col("o_orderpriority").alias("title"),
        (F.col("o_orderkey") % 90).cast("int").alias("minutes"),
        F.col("o_orderkey").alias("display_order"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderstatus").alias("kind"),
    )


def practices(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("practice_id"),
        F.expr("p_partkey * 3 div 4").alias("section_id"),
        F.col("p_name").alias("title"),
        (F.col("p_size") % 10).cast("int").alias("required_correct"),
        F.lit(10).alias("total_questions"),
        F.col("p_partkey").alias("display_order"),
    )


def quizzes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("quiz_id"),
        (F.col("s_suppkey") * 15).alias("section_id"),
        F.col("s_name").alias("title"),
    )


# ---- progress facts --------------------------------------------------------------


def lesson_of_event(spark: SparkSession, sf: str) -> Column:
    """A hundred lessons for each user, over all lessons there are."""
    return (F.col("user_id") * 100 + F.col("event_id") * 7 % 100) % rows_of(spark, sf, "orders")


def document_of_run(spark: SparkSession, sf: str) -> Column:
    """Three runs in a row work on one document; the documents are taken in steps of seven."""
    return F.expr("run_id div 3") * 7 % rows_of(spark, sf, "documents")


def progress_events(spark: SparkSession, sf: str) -> DataFrame:
    """One row per progress write; later ``event_id`` wins."""
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        "event_id",
        "ts",
        "user_id",
        lesson_of_event(spark, sf).alias("lesson_id"),
        F.when(kind == "view", "viewed")
        .when(kind == "click", "in_progress")
        .when(kind == "purchase", "mastered")
        .when(kind == "error", "locked")
        .otherwise("not_started")
        .alias("status"),
        F.when(kind == "purchase", F.col("ts")).alias("completed_at"),
        (F.col("value") / 5).alias("score"),
    )


def dense_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Three learners over every lesson: the input of mastery and unlocking."""
    return lessons(spark, sf).select(
        F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("user_id"),
        "lesson_id",
        "section_id",
    ).withColumn(
        "status",
        F.when(
            ((F.col("section_id") + F.col("user_id")) % 3 == 0) | (F.col("lesson_id") % 4 == 0), "mastered"
        ).otherwise("in_progress"),
    )


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Practice submissions; the other event types carry no submission."""
    return (
        table(spark, sf, "events")
        .where(F.col("event_type").isin("purchase", "click"))
        .select(
            "event_id",
            "ts",
            "user_id",
            ((F.col("user_id") * 13 + F.col("event_id") * 11 % 14) % rows_of(spark, sf, "part")).alias("practice_id"),
            (F.col("value") / 50).alias("score"),
        )
    )


def quiz_results(spark: SparkSession, sf: str) -> DataFrame:
    """Latest quiz score per (user, quiz)."""
    return (
        table(spark, sf, "events")
        .where(F.col("event_type").isin("signup", "error"))
        .groupBy("user_id", ((F.col("user_id") + F.col("event_id") % 3) % rows_of(spark, sf, "supplier")).alias("quiz_id"))
        .agg(
            F.max_by("value", "event_id").alias("score"),
            F.max("ts").alias("completed_at"),
        )
    )


# ---- run ledger ------------------------------------------------------------------

# The stage names in order.
STAGES = (
    "parser", "normalizer", "page_grouping", "enricher", "unit_builder",
    "concept_extractor", "graph_builder", "sequence_builder", "pipeline",
)


def stage_logs(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in STAGES])
    return table(spark, sf, "events").select(
        F.col("event_id").alias("log_id"),
        F.expr("event_id div 5").alias("run_id"),
        F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("stage"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("result"),
        F.col("value").alias("duration"),
        F.col("ts").alias("created_at"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """One row per run: status from its worst stage, retries from its errors."""
    logs = stage_logs(spark, sf)
    failed = F.col("result") == "error"
    return logs.groupBy("run_id").agg(
        F.when(F.count_if(failed) == 0, "completed")
        .when(F.count_if(failed) == 1, "pending")
        .when(F.count_if(failed) == 2, "processing")
        .otherwise("failed")
        .alias("status"),
        F.count_if(failed).cast("int").alias("retry_count"),
        F.lit(3).alias("max_retries"),
        F.max_by("stage", F.when(~failed, F.col("log_id"))).alias("last_completed_stage"),
        F.max_by("stage", F.when(failed, F.col("log_id"))).alias("failed_stage"),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("updated_at"),
    ).withColumn("doc_id", document_of_run(spark, sf))


# ---- roles -----------------------------------------------------------------------


def role_of_user(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("role")
    )


def role_permissions(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("c_mktsegment").alias("role"), F.col("o_orderpriority").alias("permission"))
        .distinct()
    )
