"""Learning units: headings open them, content follows, and their tree is rolled up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursewright.functions import text as X
from coursewright.operators import sequence as Q
from coursewright.operators.structure import drop_non_content

# Minutes and points.
WORDS_PER_MINUTE = 250
EXERCISE_MINUTES = 3
# Rank of each unit type, and the string order some callers relied on.
RANKS = {"course": 0, "module": 1, "lesson": 2, "topic": 3}
LEXICAL_RANKS = {"course": 0, "lesson": 1, "module": 2, "topic": 3}


def role_of(node_type: Column) -> Column:
    return (
        F.when(node_type.isin("heading", "figure", "table", "equation"), node_type)
        .when(node_type.isin("exercise", "question"), "exercise")
        .otherwise("text")
    )


def build_units(nodes: DataFrame) -> DataFrame:
    """Unit membership: each content node with its unit (the last heading) and its role."""
    content = drop_non_content(nodes)
    opened = F.when(F.col("node_type") == "heading", F.col("node_id"))
    seen = Q.scan(content, ["doc_id"], "seq", {"unit_id": ("last", opened, True)})
    return seen.where(F.col("unit_id").isNotNull()).withColumn("role", role_of(F.col("node_type")))


def unit_profile(unit_nodes: DataFrame) -> DataFrame:
    """Per unit: counts by role, words, description, study minutes and difficulty."""
    role = F.col("role")
    counts = {r: F.count_if(role == r) for r in ("text", "figure", "table", "equation", "exercise")}
    words = F.sum(F.when(role == "text", X.word_count(F.col("text"))).otherwise(0))
    grouped = unit_nodes.groupBy("doc_id", "unit_id").agg(
        F.min("seq").alias("seq"),
        F.min_by("text", F.when(role == "heading", F.col("seq"))).alias("title"),
        F.min_by("level", F.when(role == "heading", F.col("seq"))).alias("level"),
        F.min(F.when(F.col("page") > 0, F.col("page"))).alias("start_page"),
        F.max("page").alias("end_page"),
        *[c.alias(f"n_{r}") for r, c in counts.items()],
        words.alias("words"),
        F.min_by("text", F.when(role == "text", F.col("seq"))).alias("_first"),
    )
    minutes = (
        F.greatest(F.lit(1), F.bround(F.col("words") / WORDS_PER_MINUTE, 0).cast("int"))
        + F.col("n_exercise") * EXERCISE_MINUTES
        + F.col("n_figure")
        + F.col("n_table")
        + F.col("n_equation")
    )
    average = F.when(F.col("n_text") > 0, F.col("words") / F.col("n_text"))
    score = (
        F.col("n_equation") * 2
        + F.col("n_exercise") * 3
        + F.when(average > 50, 4).when(average > 30, 2).otherwise(0)
    )
    return grouped.select(
        *[c for c in grouped.columns if c != "_first"],
        F.coalesce(X.shorten(F.col("_first"), 200), F.lit("")).alias("description"),
        minutes.cast("long").alias("minutes"),
        F.when(score <= 3, "basic").when(score <= 8, "intermediate").otherwise("advanced").alias("difficulty"),
    )


def unit_types(units: DataFrame) -> DataFrame:
    """course for the first chapter-level heading of a document, else by heading words and level."""
    kind = X.classify_heading(F.col("title"), F.col("level"))
    typed = F.when(kind == "chapter", "module").otherwise(kind)
    first = units.where(F.col("level") == 1).groupBy("doc_id").agg(F.min("seq").alias("_root"))
    return units.join(first, "doc_id", "left").select(
        *units.columns, F.when(F.col("seq") == F.col("_root"), "course").otherwise(typed).alias("unit_type")
    )


def unit_parents(units: DataFrame, order: str = "rank") -> DataFrame:
    """Parent: the nearest earlier unit of a higher type that is still open.

    ``order='lexical'`` ranks the types by name instead.
    """
    ranks = LEXICAL_RANKS if order == "lexical" else RANKS
    rank = F.create_map(*[F.lit(v) for kv in ranks.items() for v in kv])[F.col("unit_type")]
    ranked = units.withColumn("_rank", rank)
    specs: dict[str, Q.ScanSpec] = {
        f"_u{k}": ("last", F.when(F.col("_rank") == k, F.struct("seq", "unit_id")), False) for k in range(4)
    }
    seen = Q.scan(ranked, ["doc_id"], "seq", specs)
    candidates = []
    for k in range(3):
        usable = F.col(f"_u{k}").isNotNull() & (F.col("_rank") > k)
        for j in range(k):
            usable &= ~F.coalesce(F.col(f"_u{j}.seq") > F.col(f"_u{k}.seq"), F.lit(False))
        candidates.append(F.when(usable, F.col(f"_u{k}")))
    return seen.withColumn("parent_id", F.greatest(*candidates)["unit_id"]).drop("_rank", *specs)


def scope_annotations(annotations: DataFrame, unit_nodes: DataFrame) -> DataFrame:
    """Objectives, definitions and examples (with example callouts) of each unit, one row each."""
    kind = (
        F.when((F.col("type") == "objective") & (F.col("body") != ""), "objective")
        .when(F.col("type") == "definition", "definition")
        .when((F.col("type") == "example") | ((F.col("type") == "callout") & (F.col("kind") == "example")), "example")
    )
    summary = (
        F.when(F.col("type") == "objective", F.col("body"))
        .when(F.col("type") == "definition", F.concat_ws(": ", "term", "body"))
        .otherwise(F.when(F.coalesce("term", F.lit("")) != "", F.col("term")).otherwise(F.substring("body", 1, 120)))
    )
    rows = annotations.select("doc_id", "node_id", "emit", "ord", kind.alias("list_kind"), summary.alias("summary"))
    members = unit_nodes.select("doc_id", "node_id", "unit_id", "seq")
    return rows.where(F.col("list_kind").isNotNull()).join(members, ["doc_id", "node_id"])


def rollup_unit_tree(units: DataFrame, tree: DataFrame) -> DataFrame:
    """Per unit, over itself and everything below: units, lessons, exercises, minutes, pages."""
    facts = units.select(
        "doc_id", F.col("unit_id").alias("node"), "unit_type", "n_exercise", "minutes", "start_page", "end_page"
    )
    return (
        tree.join(facts, ["doc_id", "node"])
        .groupBy("doc_id", F.col("ancestor").alias("unit_id"))
        .agg(
            (F.count("*") - 1).alias("descendants"),
            F.count_if(F.col("unit_type") == "lesson").alias("lesson_count"),
            F.sum("n_exercise").alias("exercise_count"),
            F.sum("minutes").alias("total_minutes"),
            F.min("start_page").alias("start_page"),
            F.max("end_page").alias("end_page"),
        )
    )


def section_of_unit(units: DataFrame, tree: DataFrame) -> DataFrame:
    """The nearest module at or above each unit; units outside a module stand for themselves."""
    kinds = units.select("doc_id", F.col("unit_id").alias("ancestor"), F.col("unit_type").alias("_kind"))
    return (
        tree.join(kinds, ["doc_id", "ancestor"])
        .groupBy("doc_id", F.col("node").alias("unit_id"))
        .agg(
            F.coalesce(
                F.min_by("ancestor", F.when(F.col("_kind") == "module", F.col("distance"))),
                F.max_by("ancestor", F.col("distance")),
            ).alias("section_id")
        )
    )


def section_cards(
    units: DataFrame, rollup: DataFrame, tree: DataFrame, done: DataFrame, quizzes: DataFrame, min_lessons: int = 0
) -> DataFrame:
    """One card per module: lessons, practices, quizzes, completed lessons, minutes and pages.

    ``done``: (doc_id, unit_id) of completed lessons; ``quizzes``: (doc_id, unit_id) per quiz.
    """
    lessons = units.where(F.col("unit_type") == "lesson").select("doc_id", F.col("unit_id").alias("node"))
    below = tree.join(lessons, ["doc_id", "node"])
    completed = (
        below.join(done.select("doc_id", F.col("unit_id").alias("node")).distinct(), ["doc_id", "node"])
        .groupBy("doc_id", F.col("ancestor").alias("unit_id"))
        .agg(F.count("*").alias("completed_count"))
    )
    quizzed = (
        below.join(quizzes.select("doc_id", F.col("unit_id").alias("node")), ["doc_id", "node"])
        .groupBy("doc_id", F.col("ancestor").alias("unit_id"))
        .agg(F.count("*").alias("quiz_count"))
    )
    modules = units.where(F.col("unit_type") == "module").select("doc_id", "unit_id", "title", "minutes")
    cards = (
        modules.join(rollup.select("doc_id", "unit_id", "lesson_count", "exercise_count", "start_page", "end_page"), ["doc_id", "unit_id"])
        .join(completed, ["doc_id", "unit_id"], "left")
        .join(quizzed, ["doc_id", "unit_id"], "left")
        .na.fill(0, ["completed_count", "quiz_count"])
    )
    return cards.where(F.col("lesson_count") >= min_lessons)
