"""Streams over all events, drained with ``availableNow``."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursewright.operators import progress as P
from coursewright.plans.progress import items
from coursewright.sources import tables as T
from coursewright.streaming import streams as M

TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def feed(s, df, files, per_batch):
    """``df`` as files of a folder and as a stream over them."""
    folder = M.new_folder(s, "feed")
    df.repartition(files).write.parquet(folder)
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def registry(s, sf):
    src, folder = M.new_folder(s, "lines"), M.new_folder(s, "registry")
    urls = T.table(s, sf, "pages").select(F.regexp_replace("url", "^https?://|[?#].*$", "").alias("value"))
    urls.unionByName(urls).repartition(4).write.text(src)
    M.registry(s.readStream.option("maxFilesPerTrigger", 1).text(src), folder)
    return M.read_delta(s, folder).select("source", "status")


def progress(s, sf):
    folder = M.new_folder(s, "progress")
    M.progress(feed(s, T.progress_events(s, sf), 3, 1), folder)
    return M.current_progress(s, folder)


def attempts(s, sf):
    folder = M.new_folder(s, "attempts")
    M.attempts(feed(s, T.attempts(s, sf), 3, 1), folder)
    return M.current_attempts(s, folder, T.practices(s, sf))


def stale(s, sf):
    folder = M.new_folder(s, "stale")
    beats = T.table(s, sf, "events").select(F.col("user_id").alias("target_id"), F.col("ts").cast("timestamp").alias("ts"))
    M.expire_stale(feed(s, beats, 2, 100), folder)
    return M.read_delta(s, folder).select("target_id", F.date_format("expired_at", TS).alias("expired_at"), "beats", "status")


def stage_log(s, sf):
    folder = M.new_folder(s, "stage-log")
    logs = T.stage_logs(s, sf).withColumn("created_at", F.col("created_at").cast("timestamp"))
    M.stage_log(feed(s, logs, 2, 100), folder)
    rows = M.read_delta(s, folder).groupBy("day", "stage").agg(F.max_by(F.struct("n", "errors"), "n").alias("v"))
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "stage", "v.*")


def unlock(s, sf):
    folder = M.new_folder(s, "unlock")
    lessons = T.lessons(s, sf).select("lesson_id", "section_id")
    M.unlock(feed(s, T.dense_progress(s, sf), 3, 1), lessons, P.next_section(T.sections(s, sf)), items(s, sf), folder)
    return M.read_delta(s, folder).select("user_id", "section_id", "kind", "item_id", "status")


QUERIES = {
    "stream_registry": registry,
    "stream_progress": progress,
    "stream_attempts": attempts,
    "expire_stale_requests": stale,
    "stream_stage_log": stage_log,
    "stream_unlock": unlock,
}
