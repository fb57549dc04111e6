"""Study plans: order, milestones, lesson cards and presets.

Ordering under prerequisites is sequential by nature: it runs per document on one narrow
row per unit (id, rank, order), never on texts.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursewright.functions import status as S
from coursewright.operators import sequence as Q
from coursewright.session import stage

MILESTONE_SIZE = 4
#: Lessons of a block of the scan that numbers milestones, and blocks of a larger one.
MILESTONE_BLOCK = 512


def pick_order(ranks: list[int], targets: list[list[int]], waiting: list[int]) -> list[int]:
    """Ready units first come first served, but avoid a third equal rank in a row, then prefer easier.

    Scores depend on the rank only, so three queues (one per rank) stand for the ready list.
    """
    queues = [deque(), deque(), deque()]
    ticket = 0
    for i, w in enumerate(waiting):
        if w == 0:
            queues[ranks[i]].append((ticket, i))
            ticket += 1
    out: list[int] = []
    last, streak = -1, 0
    while any(queues):
        live = [r for r in range(3) if queues[r]]
        if last < 0:
            rank = min(live, key=lambda r: queues[r][0])
        else:
            score = {r: (0.0 if streak < 2 else -10.0 if r == last else 5.0) + (2 - r) * 0.5 for r in live}
            best = max(score.values())
            rank = min((r for r in live if score[r] == best), key=lambda r: queues[r][0])
        _, i = queues[rank].popleft()
        out.append(i)
        # Only the last five count, which never changes whether the streak is two or more.
        last, streak = rank, streak + 1 if rank == last else 1
        for j in targets[i]:
            waiting[j] -= 1
            if waiting[j] == 0:
                queues[ranks[j]].append((ticket, j))
                ticket += 1
    return out


def balanced_topological_order(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, unit_id, position); units on cycles, and what follows them, are left out.

    ``units``: doc_id, unit_id, ord, difficulty.  ``edges``: doc_id, src, dst.
    """

    def order(rows: list[tuple]) -> list[tuple]:
        index = {r[2]: i for i, r in enumerate(rows)}
        targets = [[index[d] for d in r[4] if d in index] if r[4] is not None else [] for r in rows]
        waiting = [0] * len(rows)
        for found in targets:
            for j in found:
                waiting[j] += 1
        picked = pick_order([r[3] for r in rows], targets, waiting)
        return [(rows[i][0], rows[i][2], at) for at, i in enumerate(picked)]

    out = edges.groupBy("doc_id", F.col("src").alias("unit_id")).agg(F.array_sort(F.collect_list("dst")).alias("targets"))
    narrow = units.select("doc_id", "unit_id", "ord", S.difficulty_rank(F.col("difficulty")).alias("rank"))
    rows = narrow.join(out, ["doc_id", "unit_id"], "left").select("doc_id", "ord", "unit_id", "rank", "targets")
    return Q.per_key(rows, "doc_id", ["ord"], order, "doc_id long, unit_id string, position long")


def _step(state: Column, change: Column, size: int) -> Column:
    """State (n lessons in the milestone at hand, number of it) after one more lesson."""
    new = (state["n"] >= size) | ((state["n"] >= 2) & change)
    return F.struct(F.when(new, 1).otherwise(state["n"] + 1).alias("n"), (state["number"] + F.when(new, 1).otherwise(0)).alias("number"))


def _state(n: Column | int, number: Column | int = 0) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(as_column(n).cast("int").alias("n"), as_column(number).cast("long").alias("number"))


def _after(table: Column, state: Column) -> Column:
    """What a block's table (an end state for each n before it) makes of ``state``."""
    end = F.get(table, state["n"])
    return F.struct(end["n"].alias("n"), (state["number"] + end["number"]).alias("number"))


def _carried(entries: Column, start: Column) -> Column:
    """The state before each of the entries (at, table) in a row."""
    empty = F.array(F.struct(F.lit(0).cast("long").alias("at"), start.alias("state")))
    first = F.struct(start.alias("state"), F.slice(empty, 1, 0).alias("out"))
    return F.aggregate(
        entries, first,
        lambda acc, e: F.struct(
            _after(e["table"], acc["state"]).alias("state"), F.array_append(acc["out"], F.struct(e["at"].alias("at"), acc["state"].alias("state"))).alias("out")
        ),
        lambda acc: acc["out"],
    )


def _block_starts(blocks: DataFrame, states: Column) -> DataFrame:
    """(doc_id, at, start): the state before each block, by composing the tables level by level and handing states down."""
    levels = [blocks]
    entries = lambda df: df.groupBy("doc_id", F.expr(f"at div {MILESTONE_BLOCK}").alias("of")).agg(
        F.array_sort(F.collect_list(F.struct("at", "table"))).alias("entries")
    )
    while (levels[-1].agg(F.max("at")).first()[0] or 0) >= MILESTONE_BLOCK:
        composed = F.transform(states, lambda n: F.aggregate("entries", _state(n), lambda acc, e: _after(e["table"], acc)))
        levels.append(stage(entries(levels[-1]).select("doc_id", F.col("of").alias("at"), composed.alias("table"))))
    carries = levels[-1].select("doc_id", F.lit(0).cast("long").alias("of"), _state(0).alias("start")).distinct()
    for level in reversed(levels):
        met = entries(level).join(carries, ["doc_id", "of"])
        carries = met.select("doc_id", F.explode(_carried(F.col("entries"), F.col("start"))).alias("c"))
        carries = carries.select("doc_id", F.col("c.at").alias("of"), F.col("c.state").alias("start"))
    return carries.withColumnRenamed("of", "at")


def group_milestones(plan: DataFrame, size: int = MILESTONE_SIZE) -> DataFrame:
    """Milestone number of each lesson: a new one at ``size`` lessons, or on a change of difficulty after two.

    A scan over an automaton whose states are the lessons in the milestone at hand, 0 to ``size``.
    What a block of lessons does is a table from each state before it to the state after it and
    the milestones begun; tables of blocks compose as those of larger blocks, level by level, and
    the states go down again.  So a document's lessons are spread over their blocks.
    """
    narrow = plan.select("doc_id", "unit_id", "position", "difficulty")
    seen = Q.previous(narrow, ["doc_id"], "position", "before", ["difficulty"])
    change = F.col("before").isNotNull() & ~F.col("before.difficulty").eqNullSafe(F.col("difficulty"))
    rows = seen.select("doc_id", F.expr(f"position div {MILESTONE_BLOCK}").alias("at"), F.struct("position", "unit_id", change.alias("change")).alias("row"))
    blocks = rows.groupBy("doc_id", "at").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    states = F.sequence(F.lit(0), F.lit(size))
    table = F.transform(states, lambda n: F.aggregate("rows", _state(n), lambda acc, r: _step(acc, r["change"], size)))
    blocks = stage(blocks.withColumn("table", table))
    first = blocks.where("at = 0").withColumn("start", _state(0))  # nothing lies before a document's first block
    later = blocks.where("at > 0")
    met = first if later.isEmpty() else first.unionByName(later.join(_block_starts(blocks.select("doc_id", "at", "table"), states), ["doc_id", "at"]))
    # Each row as a table of its own: the state before it, and one step more.
    each = F.transform("rows", lambda r: F.struct(r["position"].cast("long").alias("at"), F.transform(states, lambda n: _step(_state(n), r["change"], size)).alias("table")))
    numbered = met.select("doc_id", F.explode(F.arrays_zip(F.col("rows").alias("row"), _carried(each, F.col("start")).alias("before"))).alias("e"))
    after = _step(F.col("e.before.state"), F.col("e.row.change"), size)
    return numbered.select("doc_id", F.col("e.row.unit_id").alias("unit_id"), after["number"].alias("milestone"))


def classify_lessons(plan: DataFrame) -> DataFrame:
    sizes = plan.groupBy("doc_id").agg(F.count("*").alias("_n"))
    kind = (
        F.when(F.col("difficulty") == "advanced", "advanced")
        .when(F.col("position") == 0, "introduction")
        .when(F.col("position") == F.col("_n") - 1, "review")
        .otherwise("core")
    )
    return plan.join(sizes, "doc_id").withColumn("lesson_type", kind).drop("_n")


def milestone_totals(plan: DataFrame) -> DataFrame:
    """Per milestone: lessons, minutes, title, description and its checkpoint."""
    rank = F.max(S.difficulty_rank(F.col("difficulty")))
    title = F.concat(F.lit("Milestone "), (F.col("milestone") + 1).cast("string"))
    return plan.groupBy("doc_id", "milestone").agg(
        F.count("*").alias("lessons"),
        F.sum("minutes").alias("minutes"),
        F.greatest(F.lit(5).cast("long"), F.floor(F.sum("minutes") / 4)).alias("checkpoint_minutes"),
        S.checkpoint_type(rank).alias("checkpoint_type"),
        F.when(F.min("difficulty") == F.max("difficulty"), F.initcap(F.min("difficulty")))
        .otherwise("Mixed difficulty")
        .alias("_level"),
    ).select("*", F.concat(title, F.lit(": "), "_level", F.lit(" topics")).alias("description")).drop("_level")


def milestone_status(plan: DataFrame, done: DataFrame) -> DataFrame:
    """Completed lessons of each milestone: none, some or all."""
    hits = done.select("doc_id", "unit_id").distinct().withColumn("_done", F.lit(1))
    counted = plan.join(hits, ["doc_id", "unit_id"], "left").groupBy("doc_id", "milestone").agg(
        F.count("*").alias("lesson_count"), F.count("_done").alias("completed")
    )
    return counted.withColumn(
        "status",
        F.when(F.col("completed") == F.col("lesson_count"), "mastered")
        .when(F.col("completed") > 0, "in_progress")
        .otherwise("not_started"),
    )


def progress_summary(plan: DataFrame, done: DataFrame) -> DataFrame:
    hits = done.select("doc_id", "unit_id").distinct().withColumn("_done", F.lit(1))
    finished = F.count("_done")
    studied = F.coalesce(F.sum(F.when(F.col("_done") == 1, F.col("minutes"))), F.lit(0))
    return plan.join(hits, ["doc_id", "unit_id"], "left").groupBy("doc_id").agg(
        F.count("*").alias("total_items"),
        finished.alias("completed_items"),
        S.pct(finished, F.count("*")).alias("mastery_pct"),
        studied.alias("studied_minutes"),
        F.greatest(F.lit(0).cast("long"), F.sum("minutes") - studied).alias("remaining_minutes"),
    )


@dataclass(frozen=True)
class StudyConfig:
    ordering: str = "by_study_plan"
    minutes: str = "sum_children"
    fixed_minutes: int = 15
    grouping: str = "by_module_level"
    min_lessons: int = 0
    max_depth: int | None = None
    show_difficulty: bool = True
    show_minutes: bool = True
    quiz_placement: str = "at_section_end"
    goal_placement: str = "after_section"


# The named presets.
PRESETS = {
    "default": StudyConfig(),
    "compact": StudyConfig(grouping="flat", show_minutes=False, show_difficulty=False, max_depth=2),
    "quiz_focused": StudyConfig(quiz_placement="inline", goal_placement="at_end"),
    "linear": StudyConfig(min_lessons=1),
}


def preset(name: str) -> StudyConfig:
    if name not in PRESETS:
        raise KeyError(f"unknown preset {name!r}; available: {', '.join(PRESETS)}")
    return PRESETS[name]


def register_preset(name: str, config: StudyConfig) -> None:
    PRESETS[name] = config


def sort_columns(strategy: str) -> list[Column]:
    """Order of lesson cards; ties keep the plan order."""
    first = {
        "by_title_alpha": F.col("title"),
        "by_difficulty": S.difficulty_rank(F.col("difficulty")),
        "by_estimated_time": F.col("minutes"),
    }.get(strategy)
    return [F.col("position")] if first is None else [first, F.col("position")]


def lesson_cards(plan: DataFrame, units: DataFrame, sections: DataFrame, progress: DataFrame) -> DataFrame:
    """Plan lessons with unit, section, page range and card status; lessons without a unit are out.

    ``progress``: doc_id, unit_id, status.
    """
    facts = units.select("doc_id", "unit_id", "title", "difficulty", "minutes", "start_page", "end_page", "description")
    return (
        plan.select("doc_id", "unit_id", "position")
        .join(facts, ["doc_id", "unit_id"])
        .join(sections, ["doc_id", "unit_id"], "left")
        .join(progress, ["doc_id", "unit_id"], "left")
        .select(
            "doc_id",
            "unit_id",
            F.coalesce("section_id", "unit_id").alias("section_id"),
            "title",
            "position",
            F.col("minutes"),
            S.map_difficulty(F.col("difficulty")).alias("difficulty"),
            S.map_card_status(F.coalesce("status", F.lit("not_started"))).alias("status"),
            F.coalesce("start_page", F.lit(0)).alias("start_page"),
            F.coalesce("end_page", F.lit(0)).alias("end_page"),
        )
    )


def apply_config(cards: DataFrame, config: StudyConfig) -> DataFrame:
    """Cards under a preset: minutes by strategy, hidden fields nulled, small sections dropped, ordered."""
    out = cards
    if config.minutes == "fixed_per_lesson":
        out = out.withColumn("minutes", F.lit(config.fixed_minutes).cast("long"))
    if config.grouping == "flat":
        root = cards.groupBy("doc_id").agg(F.min_by("unit_id", "position").alias("_root"))
        out = out.join(root, "doc_id").withColumn("section_id", F.col("_root")).drop("_root")
    if config.min_lessons > 0:
        big = out.groupBy("doc_id", "section_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= config.min_lessons)
        out = out.join(big.select("doc_id", "section_id"), ["doc_id", "section_id"], "left_semi")
    if not config.show_difficulty:
        out = out.withColumn("difficulty", F.lit(None).cast("string"))
    if not config.show_minutes:
        out = out.withColumn("minutes", F.lit(None).cast("long"))
    return out.orderBy("doc_id", *sort_columns(config.ordering))


def practice_cards(exercises: DataFrame, sections: DataFrame, progress: DataFrame) -> DataFrame:
    """Exercises of each section with one running order over sections, status and best score.

    ``exercises``: doc_id, section_id, node_id, seq, title.  ``sections``: doc_id, section_id, section_seq.
    ``progress``: node_id, status, attempts, best_score.
    """
    sizes = sections.join(
        exercises.groupBy("doc_id", "section_id").agg(F.count("*").alias("_n")), ["doc_id", "section_id"], "left"
    ).na.fill(0, ["_n"])
    offsets = Q.scan(sizes, ["doc_id"], "section_seq", {"_before": ("sum", F.col("_n"), False)})
    placed = Q.ordinal(exercises, ["doc_id", "section_id"], "seq", "_at").join(
        offsets.select("doc_id", "section_id", "_before"), ["doc_id", "section_id"]
    )
    return placed.join(progress, "node_id", "left").select(
        "doc_id",
        "section_id",
        "node_id",
        F.col("title"),
        (F.col("_before") + F.col("_at")).alias("position"),
        S.map_card_status(F.coalesce("status", F.lit("not_started"))).alias("status"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"),
        F.coalesce("best_score", F.lit(0.0)).alias("best_score"),
    )


def quiz_cards(quizzes: DataFrame, sections: DataFrame, progress: DataFrame) -> DataFrame:
    """Quizzes placed in their lesson's section, in order, with status and score.

    ``quizzes``: doc_id, quiz_id, unit_id, seq, title, total_points.  ``progress``: quiz_id, status, score.
    """
    placed = Q.ordinal(quizzes, ["doc_id"], "seq", "position").join(sections, ["doc_id", "unit_id"], "left")
    return placed.join(progress, "quiz_id", "left").select(
        "doc_id",
        "quiz_id",
        F.coalesce("section_id", "unit_id").alias("section_id"),
        "title",
        "position",
        "total_points",
        S.map_card_status(F.coalesce("status", F.lit("not_started"))).alias("status"),
        "score",
    )
