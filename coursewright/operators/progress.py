"""Learner status, mastery, unlocking and study pages for a whole population."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursewright.functions import status as S
from coursewright.operators import sequence as Q

#: Learners of a unit who are listed by one task, parts of a unit's items that meet the lists by themselves, and rows of such a part.
CHUNK, STRIPS, TILES = 16128, 32, 64
#: Learners of a list: Parquet packs so many differing values in one run, so that the runs of an item's learners are the same
#: bytes as those of the item before.  Items of a task: few, so that it holds few units and the writer's dictionaries last.
RUN, TASK_ITEMS = 504, 16384


def join_hierarchy(lessons: DataFrame, sections: DataFrame, units: DataFrame) -> DataFrame:
    """lesson → section → unit → course keys.

    No broadcast is forced: the section table grows with the data, and Spark
    broadcasts the smaller side itself when its measured size allows.
    """
    return (
        lessons.select("lesson_id", "section_id", "minutes")
        .join(sections.select("section_id", "unit_id"), "section_id")
        .join(units.select("unit_id", "course_id"), "unit_id")
    )


def resolve_parent_key(items: DataFrame, item: str, sections: DataFrame) -> DataFrame:
    return items.select(item, "section_id").join(sections.select("section_id", "unit_id"), "section_id")


def attach_lessons(enrolled: DataFrame, lessons: DataFrame, progress: DataFrame) -> DataFrame:
    """Every lesson of the sections a learner takes, with status and labels."""
    rows = enrolled.join(lessons, "section_id").join(
        progress.select("user_id", "lesson_id", "status", "completed_at"), ["user_id", "lesson_id"], "left"
    )
    status = S.lesson_status(F.col("status"), F.col("completed_at"))
    return rows.select(
        "user_id",
        "section_id",
        F.col("lesson_id").alias("item_id"),
        "title",
        "display_order",
        "minutes",
        S.format_duration(F.col("minutes")).alias("duration_label"),
        status.alias("status"),
        S.sidebar_status(status).alias("sidebar_status"),
    )


def practice_totals(attempts: DataFrame, practices: DataFrame) -> DataFrame:
    """Attempts, best score and the latest pass/fail status per (user, practice)."""
    folded = attempts.groupBy("user_id", "practice_id").agg(
        F.count("*").alias("attempts"),
        F.max("score").alias("best_score"),
        F.max_by("score", "event_id").alias("last_score"),
    )
    passed = S.practice_passed(F.col("last_score"), F.col("required_correct"))
    return folded.join(practices.select("practice_id", "required_correct"), "practice_id").select(
        "user_id",
        "practice_id",
        "attempts",
        "best_score",
        F.when(passed, "mastered").otherwise("attempted").alias("status"),
    )


def attach_practices(enrolled: DataFrame, practices: DataFrame, totals: DataFrame) -> DataFrame:
    rows = enrolled.join(practices, "section_id").join(totals, ["user_id", "practice_id"], "left")
    status = S.practice_status(F.col("status"), F.col("attempts"), F.col("best_score"), F.col("required_correct"))
    return rows.select(
        "user_id",
        "section_id",
        F.col("practice_id").alias("item_id"),
        "title",
        "display_order",
        F.coalesce("attempts", F.lit(0)).alias("attempts"),
        F.coalesce("best_score", F.lit(0.0)).alias("best_score"),
        status.alias("status"),
        S.action_label(status).alias("action_label"),
        S.progress_label(F.col("required_correct"), F.col("total_questions")).alias("progress_label"),
        S.sidebar_status(status).alias("sidebar_status"),
    )


def attach_quizzes(enrolled: DataFrame, quizzes: DataFrame, results: DataFrame) -> DataFrame:
    rows = enrolled.join(quizzes, "section_id").join(results, ["user_id", "quiz_id"], "left")
    status = S.quiz_status(F.col("score"))
    return rows.select(
        "user_id",
        "section_id",
        F.col("quiz_id").alias("item_id"),
        "title",
        "score",
        status.alias("status"),
        S.goal_status(F.col("score"), F.col("completed_at")).alias("goal_status"),
        S.action_label(status).alias("action_label"),
    )


def progress_squares(lessons: DataFrame, practices: DataFrame, quizzes: DataFrame) -> DataFrame:
    """All items of a learner in one list; quizzes take order 0 and their goal status."""
    parts = [
        lessons.select("user_id", "section_id", F.lit("lesson").alias("kind"), "item_id", "display_order", "status"),
        practices.select("user_id", "section_id", F.lit("practice").alias("kind"), "item_id", "display_order", "status"),
        quizzes.select(
            "user_id",
            "section_id",
            F.lit("quiz").alias("kind"),
            "item_id",
            F.lit(0).cast("long").alias("display_order"),
            F.col("goal_status").alias("status"),
        ),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def status_histogram(squares: DataFrame, *keys: str) -> DataFrame:
    """One count per status, zeros included."""
    return squares.groupBy(*keys).agg(
        *[F.count_if(F.col("status") == name).alias(f"n_{name}") for name in S.STATUSES]
    )


def mastery(squares: DataFrame, *keys: str) -> DataFrame:
    done = F.count_if(F.col("status") == "mastered")
    return squares.groupBy(*keys).agg(
        F.count("*").alias("total"), done.alias("completed"), S.pct(done, F.count("*")).alias("mastered_pct")
    )


def unit_totals(lessons: DataFrame, sections: DataFrame) -> DataFrame:
    return (
        lessons.groupBy("section_id")
        .agg(F.count("*").alias("n"), F.sum("minutes").alias("m"))
        .join(sections.select("section_id", "unit_id"), "section_id")
        .groupBy("unit_id")
        .agg(F.sum("n").alias("total_lessons"), F.sum("m").alias("total_minutes"))
    )


def section_mastered(progress: DataFrame, lessons: DataFrame) -> DataFrame:
    """(user, section) pairs with the mastered count, the total and whether they agree."""
    totals = lessons.groupBy("section_id").agg(F.count("*").alias("total"))
    done = progress.groupBy("user_id", "section_id").agg(
        F.count_if(F.col("status") == "mastered").alias("mastered")
    )
    return done.join(totals, "section_id").withColumn("complete", F.col("mastered") >= F.col("total"))


def next_section(sections: DataFrame) -> DataFrame:
    """Each section with the next one of its unit; blocks keep large units off one task."""
    nexts = Q.following(sections, ["unit_id"], "display_order", "_next", ["section_id"])
    return nexts.select("unit_id", "section_id", F.col("_next.section_id").alias("next_section_id"))


def section_items(lessons: DataFrame, practices: DataFrame, quizzes: DataFrame) -> DataFrame:
    return (
        lessons.select("section_id", F.lit("lesson").alias("kind"), F.col("lesson_id").alias("item_id"))
        .unionByName(practices.select("section_id", F.lit("practice").alias("kind"), F.col("practice_id").alias("item_id")))
        .unionByName(quizzes.select("section_id", F.lit("quiz").alias("kind"), F.col("quiz_id").alias("item_id")))
    )


def unlock_wave(complete: DataFrame, nexts: DataFrame, items: DataFrame) -> DataFrame:
    """Rows to unlock: the items of the section after each mastered one."""
    opened = (
        complete.where("complete")
        .select("user_id", "section_id")
        .join(nexts.where(F.col("next_section_id").isNotNull()), "section_id")
        .select("user_id", F.col("next_section_id").alias("section_id"))
    )
    return opened.join(items, "section_id").select(
        "user_id",
        "section_id",
        "kind",
        "item_id",
        # Quizzes carry no status.
        F.when(F.col("kind") != "quiz", "not_started").alias("status"),
    )


def initial_progress(enrolments: DataFrame, sections: DataFrame, items: DataFrame) -> DataFrame:
    """Progress rows of new enrolments: a unit's first section is open, the rest locked.

    The rows are the product of a unit's learners and items, so they are many and their order decides how large
    they are when written: they come list by list, then item by item, each item with the learners of the list.
    """
    first = sections.groupBy("unit_id").agg(F.min_by("section_id", "display_order").alias("first_section"))
    placed = items.join(sections.select("section_id", "unit_id"), "section_id").join(first, "unit_id")
    # The learners of a unit meet its items as lists of ``RUN``, in strips of the items: no key of the
    # join holds a unit, and only lists and items move, not their product.
    chunks = enrolments.groupBy("unit_id").agg(F.ceil(F.count("*") / CHUNK).alias("_chunks"))
    dealt = enrolments.join(chunks, "unit_id").withColumn("_chunk", F.pmod(F.xxhash64("user_id"), F.col("_chunks")))
    listed = dealt.groupBy("unit_id", "_chunk").agg(F.array_sort(F.collect_list(F.struct("user_id"))).alias("_all"))
    starts = F.sequence(F.lit(1), F.size("_all"), F.lit(RUN))
    lists = listed.select("unit_id", F.explode(F.transform(starts, lambda at: F.slice("_all", at, RUN))).alias("_users"))
    strips = lists.select("unit_id", "_users", F.explode(F.sequence(F.lit(0), F.lit(STRIPS - 1))).alias("_strip"))
    by, code = ["unit_id", "_strip"], F.xxhash64("section_id", "kind", "item_id")
    items_dealt = placed.select(
        "unit_id",
        F.pmod(code, F.lit(STRIPS)).cast("int").alias("_strip"),
        F.pmod(F.shiftright(code, 32), F.lit(TILES)).alias("_tile"),
        F.struct("section_id", "kind", "item_id", (F.col("section_id") == F.col("first_section")).alias("opened")).alias("_item"),
    )
    tasks = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-items.count() // TASK_ITEMS))
    tiles = items_dealt.repartition(tasks, *by).groupBy(*by, "_tile").agg(F.array_sort(F.collect_list("_item")).alias("_items"))
    met = strips.repartition(tasks, *by).hint("merge").join(tiles, by)
    # A function of arrays is not compiled into the join and the second explode: those three in one would hold
    # all rows of a list at a time.
    status = lambda i: F.when(i["kind"] != "quiz", F.when(i["opened"], "not_started").otherwise("locked"))
    each = F.transform("_items", lambda i: F.struct(i["section_id"].alias("section_id"), i["kind"].alias("kind"), i["item_id"].alias("item_id"), status(i).alias("status")))
    rows = met.select("unit_id", "_users", F.explode(each).alias("_item"))
    return rows.select("unit_id", "_item", F.explode("_users").alias("_user")).select(
        F.col("_user.user_id").alias("user_id"), "unit_id", "_item.section_id", "_item.kind", "_item.item_id", "_item.status"
    )


def study_pages(
    squares: DataFrame, sections: DataFrame, totals: DataFrame, noted: DataFrame, carded: DataFrame
) -> DataFrame:
    """One row per (user, unit): progress, totals and the notes / flashcards flags."""
    per_unit = mastery(squares.join(sections.select("section_id", "unit_id"), "section_id"), "user_id", "unit_id")
    keys = ["user_id", "unit_id"]
    notes = noted.select(*keys).distinct().withColumn("has_notes", F.lit(True))
    cards = carded.select(*keys).distinct().withColumn("has_flashcards", F.lit(True))
    return (
        per_unit.join(totals, "unit_id")
        .join(notes, keys, "left")
        .join(cards, keys, "left")
        .na.fill(False, ["has_notes", "has_flashcards"])
    )
