"""Keyed merges, filters, ordering and sets on the course and progress tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from coursewright.functions import text as X
from coursewright.operators import tables as O
from coursewright.sources import tables as T

TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def cards(s, sf):
    """Flashcards: sign-up events are shared cards (no owner)."""
    e = T.table(s, sf, "events")
    return e.select(
        F.col("event_id").alias("card_id"),
        F.when(F.col("event_type") != "signup", F.col("user_id")).alias("user_id"),
        (F.col("event_id") % 5).alias("course_id"),
        (F.col("event_id") % 25).alias("unit_id"),
        T.lesson_of_event(s, sf).alias("lesson_id"),
        F.col("event_type").isin("click", "signup").alias("is_generated"),
        F.col("ts").alias("created_at"),
    )


def upsert_last_wins(s, sf):
    base = T.dense_progress(s, sf).select("user_id", "lesson_id", "status")
    return O.upsert_last_wins(base, T.progress_events(s, sf), ["user_id", "lesson_id"], "event_id")


def insert_if_absent(s, sf):
    base = T.dense_progress(s, sf).select("user_id", "lesson_id")
    return O.insert_if_absent(base, T.progress_events(s, sf).select("user_id", "lesson_id"), ["user_id", "lesson_id"])


def conditional_upsert(s, sf):
    latest = O.latest_per_key(
        T.progress_events(s, sf), ["user_id", "lesson_id"], "event_id", columns=["user_id", "lesson_id", "status"]
    )
    new = T.dense_progress(s, sf).select("user_id", "lesson_id", F.lit("not_started").alias("status"))
    return O.conditional_upsert(latest, new, ["user_id", "lesson_id"], F.col("status") == "locked", ["status"])


def cascade_delete(s, sf):
    doomed = T.course_units(s, sf).join(
        T.courses(s, sf).where(F.col("title") == "ASIA").select("course_id"), "course_id", "left_semi"
    )
    kept = O.cascade_delete(
        doomed,
        "unit_id",
        [
            ("sections", T.sections(s, sf), "section_id", "unit_id"),
            ("lessons", T.lessons(s, sf), "lesson_id", "section_id"),
            ("practices", T.practices(s, sf), "practice_id", "section_id"),
            ("quizzes", T.quizzes(s, sf), "quiz_id", "section_id"),
        ],
    )
    ids = {"sections": "section_id", "lessons": "lesson_id", "practices": "practice_id", "quizzes": "quiz_id"}
    return reduce(
        lambda a, b: a.unionByName(b),
        [df.select(F.lit(n).alias("table_name"), F.col(ids[n]).alias("id")) for n, df in kept.items()],
    )


def _accounts(s, sf):
    src = T.table(s, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))
    seen = T.table(s, sf, "orders").where(F.col("o_totalprice") > 400000).select(F.col("o_custkey").alias("user_id")).distinct()
    dst = src.join(seen, "user_id", "left_semi").select((F.col("user_id") + 1000000).alias("user_id"), "email")
    return src, dst


def promote_missing(s, sf):
    return O.promote_missing(*_accounts(s, sf), "email", "user_id")


def rekey_roles(s, sf):
    src, dst = _accounts(s, sf)
    return O.rekey(T.role_of_user(s, sf), src, dst, "email", "user_id")


def _log_rows(s, sf):
    return T.stage_logs(s, sf).select("run_id", "log_id", "stage", "result")


def snapshot_before_delete(s, sf):
    return O.snapshot_digest(O.snapshot_before_delete(_log_rows(s, sf), "run_id"), "run_id")


def restore_snapshot(s, sf):
    logs = _log_rows(s, sf)
    snap = O.snapshot_before_delete(logs, "run_id")
    failed = T.runs(s, sf).where(F.col("status") == "failed").select("run_id")
    left = logs.join(failed, "run_id", "left_anti")
    back = snap.join(failed, "run_id", "left_semi")
    return O.restore_snapshot(back, O.snapshot_digest(back, "run_id"), left, "run_id", "log_id")


def filter_either_key(s, sf):
    units = T.course_units(s, sf).where(F.col("course_id") == 2).select("unit_id")
    urgent = T.lessons(s, sf).where(F.col("title") == "1-URGENT").select("lesson_id")
    return O.filter_either_key(cards(s, sf), "unit_id", units, "lesson_id", urgent).select("card_id")


def filter_in(s, sf):
    failed = T.runs(s, sf).where(F.col("status") == "failed").select("run_id")
    return O.filter_in(T.stage_logs(s, sf), "run_id", failed).select("log_id", "run_id", "stage")


def filter_live(s, sf):
    e = T.table(s, sf, "events")
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    ts = F.col("ts").cast("timestamp_ntz")
    kept = F.make_dt_interval(days=F.lit(7))
    return e.select(
        "event_id", O.live(ts + kept, now).alias("live")
    )


def filter_stale(s, sf):
    req = T.runs(s, sf).select(
        "run_id",
        F.when(F.col("status") == "processing", "in_progress").otherwise(F.col("status")).alias("status"),
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
        F.when(F.col("run_id") % 4 != 0, F.col("updated_at").cast("timestamp_ntz")).alias("updated_at"),
    )
    now = F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")
    return req.where(O.stale(F.col("status"), F.col("updated_at"), F.col("created_at"), now)).select("run_id", "status")


def permissions(s, sf):
    return O.distinct_through(T.role_of_user(s, sf), T.role_permissions(s, sf), "user_id", "role", "permission")


def nest_children(s, sf):
    roles = T.role_of_user(s, sf).select("role").distinct()
    nested = O.nest_children(roles, T.role_permissions(s, sf), "role", "permission")
    return nested.select("role", F.size("children").alias("n"), F.array_join("children", "|").alias("permissions"))


def join_bridge_ordered(s, sf):
    """Lessons of each section, newest first."""
    joined = T.sections(s, sf).select("section_id", "unit_id").join(T.lessons(s, sf), "section_id")
    newest = joined.orderBy("section_id", F.col("created_at").desc(), F.col("lesson_id").desc())
    return newest.select("unit_id", "section_id", "lesson_id")


def latest_run_for_document(s, sf):
    docs = T.table(s, sf, "documents").select("doc_id")
    newest = O.latest_per_key(T.runs(s, sf), ["doc_id"], "run_id", columns=["doc_id", "run_id", "status"])
    return docs.join(newest, "doc_id")


def latest_per_key(s, sf):
    opened = T.progress_events(s, sf).where(~F.col("status").isin("not_started", "locked"))
    return O.latest_per_key(opened, ["user_id"], "ts", "event_id", columns=["user_id", "ts", "event_id", "lesson_id"]).select(
        "user_id", "lesson_id", F.date_format("ts", TS).alias("opened_at")
    )


def union_all(s, sf):
    labelled = [
        T.lessons(s, sf).select(F.lit("lesson").alias("kind"), F.col("lesson_id").alias("id"), "section_id"),
        T.practices(s, sf).select(F.lit("practice").alias("kind"), F.col("practice_id").alias("id"), "section_id"),
        T.quizzes(s, sf).select(F.lit("quiz").alias("kind"), F.col("quiz_id").alias("id"), "section_id"),
    ]
    return reduce(lambda a, b: a.unionByName(b), labelled)


def coverage(s, sf):
    expected = T.lessons(s, sf).select("section_id", "lesson_id")
    found = T.progress_events(s, sf).select("lesson_id").distinct().join(expected, "lesson_id")
    return O.coverage(expected, found, ["section_id"], "lesson_id")


def expand_ranges(s, sf):
    ranges = T.stage_logs(s, sf).select(
        F.col("run_id"),
        F.col("log_id"),
        (F.col("log_id") % 7).cast("int").alias("a"),
        (F.col("log_id") % 7 + F.floor(F.col("duration")).cast("long") % 5 - 1).cast("int").alias("b"),
    )
    return O.expand_ranges(ranges, ["run_id"], "a", "b", "log_id")


def target_keys(s, sf):
    ids = T.stage_logs(s, sf).groupBy("run_id").agg(F.collect_list(F.col("log_id") % 3).alias("ids"))
    return ids.select(
        "run_id", X.target_key("delete_document_process_runs|v1|process_ids=", F.col("ids")).alias("target_key")
    )


QUERIES = {
    "upsert_last_wins": upsert_last_wins,
    "insert_if_absent": insert_if_absent,
    "conditional_upsert": conditional_upsert,
    "cascade_delete": cascade_delete,
    "promote_missing": promote_missing,
    "rekey_roles": rekey_roles,
    "snapshot_before_delete": snapshot_before_delete,
    "restore_snapshot": restore_snapshot,
    "filter_by_key": lambda s, sf: T.lessons(s, sf).where(F.col("section_id") == 7).select("lesson_id", "title"),
    "filter_in": filter_in,
    "filter_optional_criteria": lambda s, sf: cards(s, sf).where(
        O.optional_criteria(
            {"is_generated": True, "user_id": None, "course_id": 3, "unit_id": None}, null_means_null=["user_id"]
        )
    ).select("card_id", "course_id", "unit_id"),
    "filter_visible": lambda s, sf: cards(s, sf).where(O.visible("user_id", 8, "unit_id", 3)).select("card_id", "user_id"),
    "filter_either_key": filter_either_key,
    "search_by_name": lambda s, sf: O.search_by_name(
        T.table(s, sf, "part"), "p_name", "%RING%", "p_retailprice", "p_partkey", 20
    ).select("p_partkey", "p_name"),
    "filter_like_contains": lambda s, sf: T.table(s, sf, "pages").where(F.col("url").contains("example.org")).select(
        "page_id", "url"
    ),
    "filter_by_type": lambda s, sf: T.stage_logs(s, sf).where(
        (F.col("stage") == "enricher") & (F.col("result") == "error")
    ).select("log_id", "run_id"),
    "filter_live": filter_live,
    "filter_stale": filter_stale,
    "join_many_to_many": permissions,
    "has_permission": lambda s, sf: O.has_permission(permissions(s, sf), "user_id", "permission", "1-URGENT"),
    "nest_children": nest_children,
    "join_bridge_ordered": join_bridge_ordered,
    "latest_run_for_document": latest_run_for_document,
    "max_id_per_key": lambda s, sf: T.runs(s, sf).groupBy("doc_id").agg(F.max("run_id").alias("run_id")),
    "latest_per_key": latest_per_key,
    "order_content": lambda s, sf: T.lessons(s, sf).orderBy("section_id", "display_order").select(
        "section_id", "display_order", "lesson_id", "title"
    ),
    "paginate": lambda s, sf: O.paginate(T.lessons(s, sf).select("lesson_id", "title"), "lesson_id", 100, 50),
    "fifo_batch": lambda s, sf: O.fifo_batch(T.runs(s, sf), F.col("status") == "pending", "run_id").select("run_id"),
    "sample_rows": lambda s, sf: O.sample_rows(T.lessons(s, sf), ["title"], "lesson_id", 25).select("title", "lesson_id"),
    "union_all": union_all,
    "coverage": coverage,
    "expand_ranges": expand_ranges,
    "target_keys": target_keys,
    "iso_times": lambda s, sf: T.table(s, sf, "events").select(
        "event_id", X.iso_utc(F.col("ts")).alias("iso")
    ),
}
