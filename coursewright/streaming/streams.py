"""Incremental forms of the merges: each writes small deltas, and reading folds them.

Sinks append one folder per micro-batch (overwritten when a batch is retried), so a
restart neither loses nor doubles rows.  What a merge must remember lies in the state store by
key: a batch looks up its own keys, and no batch reads what earlier ones wrote.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursewright.functions import status as S
from coursewright.operators import progress as P
from coursewright.operators import tables as O
from coursewright.session import shared_folder


#: Keeps keyed state on disk, with changes uploaded to the checkpoint; an executor's memory does not bound it.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drain(
    stream: DataFrame, each: Callable[[DataFrame, int], None], folder: str, mode: str = "append", provider: str | None = None
) -> None:
    """Run a stream over everything available now; ``provider`` names the state store of this query alone."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, provider or before)
    try:
        query = (
            stream.writeStream.foreachBatch(each)
            .outputMode(mode)
            .option("checkpointLocation", f"{folder}/_checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        conf.set(PROVIDER, before)
    query.awaitTermination()


def append_delta(folder: str) -> Callable[[DataFrame, int], None]:
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/delta/batch={batch}")


def read_delta(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/delta")


def registry(lines: DataFrame, folder: str) -> None:
    """New registry lines become pending documents once.

    Sources seen are keys of the state store, for good: a source is never registered again.
    Null and blank lines are no sources.
    """
    fresh = lines.select(F.trim("value").alias("source")).where(F.col("source") != "").dropDuplicates(["source"])
    drain(fresh.withColumn("status", F.lit("pending")), append_delta(folder), folder, provider=ROCKSDB)


def progress(events: DataFrame, folder: str) -> None:
    """Last write per (user, lesson); deltas hold only the keys a batch touched."""
    state = events.groupBy("user_id", "lesson_id").agg(
        F.max("event_id").alias("event_id"), F.max_by(F.struct("status", "score"), "event_id").alias("v")
    )
    drain(state.select("user_id", "lesson_id", "event_id", "v.*"), append_delta(folder), folder, "update")


def current_progress(spark: SparkSession, folder: str) -> DataFrame:
    return O.latest_per_key(
        read_delta(spark, folder), ["user_id", "lesson_id"], "event_id",
        columns=["user_id", "lesson_id", "event_id", "status", "score"],
    )


def attempts(events: DataFrame, folder: str) -> None:
    """Attempts, best and latest score per (user, practice)."""
    state = events.groupBy("user_id", "practice_id").agg(
        F.count("*").alias("attempts"), F.max("score").alias("best_score"), F.max_by("score", "event_id").alias("last_score")
    )
    drain(state, append_delta(folder), folder, "update")


def current_attempts(spark: SparkSession, folder: str, practices: DataFrame) -> DataFrame:
    """The delta with most attempts is the newest of its key."""
    newest = O.latest_per_key(
        read_delta(spark, folder), ["user_id", "practice_id"], "attempts",
        columns=["user_id", "practice_id", "attempts", "best_score", "last_score"],
    )
    passed = S.practice_passed(F.col("last_score"), F.col("required_correct"))
    return newest.join(practices.select("practice_id", "required_correct"), "practice_id").select(
        "user_id", "practice_id", "attempts", "best_score", F.when(passed, "mastered").otherwise("attempted").alias("status")
    )


def expire_stale(beats: DataFrame, folder: str, seconds: int = 300, delay: str = "1 hour") -> None:
    """Requests without a heartbeat for ``seconds`` fail: a session window closes when the watermark passes it."""
    sessions = (
        beats.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", f"{seconds} seconds").alias("s"), "target_id")
        .agg(F.count("*").alias("beats"))
    )
    drain(
        sessions.select("target_id", F.col("s.end").alias("expired_at"), "beats", F.lit("failed").alias("status")),
        append_delta(folder), folder,
    )


def stage_log(events: DataFrame, folder: str) -> None:
    """Stage events to log rows, summed per day and stage under a watermark (updates as they come)."""
    daily = (
        events.withWatermark("created_at", "1 day")
        .groupBy(F.window("created_at", "1 day").alias("w"), "stage")
        .agg(F.count("*").alias("n"), F.count_if(F.col("result") == "error").alias("errors"))
    )
    drain(daily.select(F.col("w.start").alias("day"), "stage", "n", "errors"), append_delta(folder), folder, "update")


def unlock(writes: DataFrame, lessons: DataFrame, nexts: DataFrame, items: DataFrame, folder: str) -> None:
    """When a section becomes mastered, emit the next section's rows once.

    The state store holds each mastered (user, lesson) once and a count per (user, section).  A
    lesson mastered again changes no count, so a section is complete in exactly one batch.  Only
    lessons of ``lessons`` count, as it stands when the stream starts.
    """
    scope = lessons.select("section_id", "lesson_id").distinct()
    totals = scope.groupBy("section_id").agg(F.count("*").alias("total"))
    counted = writes.where("status = 'mastered'").select("user_id", "section_id", "lesson_id")
    counted = counted.join(scope, ["section_id", "lesson_id"], "left_semi").dropDuplicates(["user_id", "section_id", "lesson_id"])
    mastered = counted.groupBy("user_id", "section_id").agg(F.count("*").alias("mastered"))

    def each(df: DataFrame, batch: int) -> None:
        complete = df.join(totals, "section_id").withColumn("complete", F.col("mastered") == F.col("total"))
        append_delta(folder)(P.unlock_wave(complete, nexts, items), batch)

    drain(mastered, each, folder, "update", ROCKSDB)
