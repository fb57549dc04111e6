"""Books: page items, lesson and chapter segmentation, assembly.

Windows inside one page are plain (a page is a bounded sheet); everything that runs
over a document uses the block scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursewright.functions import text as X
from coursewright.operators import sequence as Q
from coursewright.operators.matching import dominant_pairs, paired_in_order, placed_in_queue, served_in_order
from coursewright.operators.structure import NON_CONTENT
from coursewright.session import stage

# Running headers and footers, and texts that only occur in margins.
CHROME_PATTERNS = (
    r"(?i)\bstudy\s+guide\s+for\s+content\s+mastery\b",
    r"(?i)\bchemistry:\s*matter\s+and\s+change\s*[•·]?\s*chapter\s*\d+\b",
    r"(?i)\bname\s+date\s+class(?:\s+\d+)?\b",
    r"(?i)\bcopyright\s+©?\s*glencoe/mcgraw-hill[^\n]*",
)
CHROME_WORDS = ("class", "name", "date", "name date class")
CHROME_PHRASES = (
    ("study guide for content mastery",), ("name date class",), ("copyright", "mcgraw-hill"),
    ("chemistry: matter and change", "chapter"),
)
TOP_MARGIN, BOTTOM_MARGIN = 45.0, 55.0
LESSON_PAGES, CHAPTER_LESSONS = 5, 5
NUMBERED = r"^\s*(\d+)[.)]\s+"
CONTINUATION_GAP = 24.0

PAGE = ["doc_id", "page"]


def dedupe_page_headings(nodes: DataFrame) -> DataFrame:
    """One heading per (page, folded text): the first.  Blank headings stay."""
    folded = X.fold_text(F.col("text"))
    counted = (F.col("node_type") == "heading") & (folded != "")
    heads = nodes.where(counted)
    first = heads.groupBy(*PAGE, folded.alias("_fold")).agg(F.min("seq").alias("seq")).select(*PAGE, "seq")
    return nodes.where(~counted).unionByName(heads.join(first, [*PAGE, "seq"], "left_semi"))


def heading_signals(nodes: DataFrame) -> DataFrame:
    """First chapter heading and first lesson heading of every page."""
    text = X.strip(F.col("text"))
    kind = X.classify_heading(text, F.col("level"))
    usable = (F.col("node_type") == "heading") & (text != "")
    return nodes.groupBy(*PAGE).agg(
        F.min_by(text, F.when(usable & (kind == "chapter"), F.col("seq"))).alias("chapter_heading"),
        F.min_by(text, F.when(usable & (kind == "lesson"), F.col("seq"))).alias("lesson_heading"),
    )


def chunk_of(i: Column, n: Column) -> Column:
    """Chunk of page ``i`` of ``n``: 4 to 6 pages, nearest to 5, larger chunks first."""
    counts = F.filter(F.sequence(F.ceil(n / 6).cast("int"), F.greatest(F.floor(n / 4), F.lit(1)).cast("int")), lambda k: (k * 4 <= n) & (n <= k * 6))
    best = F.array_min(F.transform(counts, lambda k: F.struct(F.abs(n / k - LESSON_PAGES).alias("off"), k.alias("k"))))["k"]
    k = F.when(n <= 6, 1).otherwise(F.coalesce(best, F.greatest(F.lit(1), F.bround(n / LESSON_PAGES, 0).cast("int")))).cast("long")
    base, extra = F.floor(n / k), n % k
    wide = extra * (base + 1)
    return F.when(i < wide, F.floor(i / (base + 1))).otherwise(extra + F.floor((i - wide) / base))


def segment_lessons(pages: DataFrame) -> DataFrame:
    """``lesson`` of every page: new at each lesson heading, else chunks by size.

    ``pages``: doc_id, page, chapter_heading, lesson_heading (one row per page).
    """
    placed = Q.ordinal(pages, ["doc_id"], "page", "page_ord")
    anchor = F.when(F.col("lesson_heading").isNotNull() & (F.col("page_ord") > 0), 1).otherwise(0).cast("long")
    totals = pages.groupBy("doc_id").agg(
        F.count("*").alias("_n"), F.bool_or(F.col("lesson_heading").isNotNull()).alias("_anchored")
    )
    runs = Q.scan(placed, ["doc_id"], "page", {"_run": ("sum", anchor, True)}).join(totals, "doc_id")
    lesson = F.when(F.col("_anchored"), F.col("_run")).otherwise(chunk_of(F.col("page_ord"), F.col("_n")))
    return runs.withColumn("lesson", lesson.cast("long")).drop("_run", "_n", "_anchored")


def lesson_segments(pages: DataFrame) -> DataFrame:
    """Lessons with title, first page and chapter signals."""
    return pages.groupBy("doc_id", "lesson").agg(
        F.min("page").alias("first_page"),
        F.max("page").alias("last_page"),
        F.count("*").alias("n_pages"),
        F.coalesce(
            F.min_by("lesson_heading", F.when(F.col("lesson_heading").isNotNull(), F.col("page"))),
            F.min_by("chapter_heading", F.when(F.col("chapter_heading").isNotNull(), F.col("page"))),
            F.concat(F.lit("Lesson "), (F.col("lesson") + 1).cast("string")),
        ).alias("title"),
        F.min_by("chapter_heading", F.when(F.col("chapter_heading").isNotNull(), F.col("page"))).alias("chapter_heading"),
    )


def segment_chapters(lessons: DataFrame) -> DataFrame:
    """``chapter`` of every lesson: new at each chapter heading, else five lessons each."""
    anchored = lessons.groupBy("doc_id").agg(F.bool_or(F.col("chapter_heading").isNotNull()).alias("_anchored"))
    starts = F.when(F.col("chapter_heading").isNotNull() & (F.col("lesson") > 0), 1).otherwise(0).cast("long")
    runs = Q.scan(lessons, ["doc_id"], "lesson", {"_run": ("sum", starts, True)}).join(anchored, "doc_id")
    chapter = F.when(F.col("_anchored"), F.col("_run")).otherwise(F.floor(F.col("lesson") / CHAPTER_LESSONS))
    return runs.withColumn("chapter", chapter).drop("_run", "_anchored")


def chapter_segments(lessons: DataFrame) -> DataFrame:
    return lessons.groupBy("doc_id", "chapter").agg(
        F.count("*").alias("n_lessons"),
        F.coalesce(
            F.min_by("chapter_heading", F.when(F.col("chapter_heading").isNotNull(), F.col("lesson"))),
            F.concat(F.lit("Chapter "), (F.col("chapter") + 1).cast("string")),
        ).alias("title"),
    )


# ---- items -----------------------------------------------------------------------


def nodes_to_items(nodes: DataFrame) -> DataFrame:
    """Typed items of content nodes; blank text is dropped, and so are text children of form areas.

    ``item_order`` is the place on the page.
    """
    kind = (
        F.when(F.col("node_type").isin("paragraph", "text_item", "note", "callout"), "text")
        .when(F.col("node_type") == "figure", "image")
        .when(F.col("node_type") == "exercise", "question")
        .otherwise(F.col("node_type"))
    )
    forms = nodes.where(F.col("node_type") == "form_area").select("doc_id", F.col("node_id").alias("parent_id"))
    children = nodes.where(F.col("node_type") == "text_item").join(forms, ["doc_id", "parent_id"], "left_semi")
    rows = nodes.where(~F.col("node_type").isin(*NON_CONTENT)).join(
        children.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti"
    )
    items = rows.withColumn("item_type", kind).where(~F.col("item_type").isin("text", "list") | (X.strip(F.col("text")) != ""))
    return reindex(items)


def reindex(items: DataFrame) -> DataFrame:
    w = Window.partitionBy(*PAGE).orderBy("seq")
    return items.withColumn("item_order", (F.row_number().over(w) - 1).cast("int"))


def strip_page_chrome(items: DataFrame, patterns: tuple[str, ...] = CHROME_PATTERNS) -> DataFrame:
    """Text and headings without running headers; dropped when empty, a bare number, or margin furniture.

    Expects ``y_pt`` and ``page_pt`` (points).
    """
    plain = F.col("item_type").isin("text", "heading")
    clean = F.col("text")
    for p in patterns:
        clean = F.regexp_replace(clean, p, " ")
    clean = F.trim(F.regexp_replace(clean, f"{X.WS}+", " "), F.lit(" -•|\t\n"))
    clean = F.when((F.lower(clean) == "class") | clean.rlike(r"^\d+$"), "").otherwise(clean)
    folded = X.fold_text(F.col("text"))
    furniture = folded.isin(*CHROME_WORDS)
    for phrase in CHROME_PHRASES:
        hit = F.lit(True)
        for part in phrase:
            hit &= folded.contains(part)
        furniture |= hit
    margin = (F.col("y_pt") <= TOP_MARGIN) | ((F.col("page_pt") > 0) & (F.col("y_pt") >= F.col("page_pt") - BOTTOM_MARGIN))
    gone = plain & ((margin & furniture) | ((X.strip(F.col("text")) != "") & (clean == "")))
    return items.where(~gone).withColumn("text", F.when(plain, clean).otherwise(F.col("text")))


def drop_heading_echo(items: DataFrame) -> DataFrame:
    """Text equal to the heading just before it (also repeated) is dropped."""
    w = Window.partitionBy(*PAGE).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    head = F.when(F.col("item_type") == "heading", F.struct("seq", X.fold_text(F.col("text")).alias("fold")))
    seen = items.withColumn("_head", F.last(head, ignorenulls=True).over(w))
    echo = (F.col("item_type") == "text") & F.coalesce(X.fold_text(F.col("text")) == F.col("_head.fold"), F.lit(False))
    marked = seen.withColumn("_echo", echo)
    other = F.when((F.col("item_type") != "heading") & ~F.col("_echo"), F.col("seq"))
    broken = marked.withColumn("_other", F.max(other).over(w))
    return broken.where(~(F.col("_echo") & ~F.coalesce(F.col("_other") > F.col("_head.seq"), F.lit(False)))).drop(
        "_head", "_echo", "_other"
    )


def promote_true_false(items: DataFrame) -> DataFrame:
    """A one-item numbered list beside a true/false question numbered within two of it becomes one.

    Expects ``n_items`` and ``question_type``.
    """
    w = Window.partitionBy(*PAGE).orderBy("seq")
    number = F.when(F.col("text").rlike(NUMBERED), F.regexp_extract("text", NUMBERED, 1).try_cast("bigint"))
    me = F.struct("item_type", "question_type", number.alias("n"))
    seen = items.withColumn("_n", number).withColumn("_a", F.lag(me).over(w)).withColumn("_b", F.lead(me).over(w))

    def beside(c: str) -> Column:
        q = (F.col(f"{c}.item_type") == "question") & (F.col(f"{c}.question_type") == "true_false")
        return F.coalesce(q & (F.abs(F.col(f"{c}.n") - F.col("_n")) <= 2), F.lit(False))

    body = X.strip(F.regexp_replace("text", NUMBERED, ""))
    up = (F.col("item_type") == "list") & (F.col("n_items") == 1) & F.col("_n").isNotNull() & (body != "") & (beside("_a") | beside("_b"))
    return seen.select(
        *[c for c in items.columns if c not in ("item_type", "question_type")],
        F.when(up, "question").otherwise(F.col("item_type")).alias("item_type"),
        F.when(up, "true_false").otherwise(F.col("question_type")).alias("question_type"),
    )


def join_question_continuation(items: DataFrame) -> DataFrame:
    """Lower-case text within 24 pt below an unfinished true/false question joins it (optional pass)."""
    w = Window.partitionBy(*PAGE).orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    tail = X.strip(F.col("text"))
    question = F.when(
        (F.col("item_type") == "question"),
        F.struct("seq", (F.col("question_type") == "true_false").alias("tf"), (F.col("y_pt") + F.col("h_pt")).alias("bottom")),
    )
    seen = items.withColumn("_q", F.last(question, ignorenulls=True).over(before)).withColumn("_prev", F.lag(tail).over(w))
    gap = F.col("y_pt") - F.col("_q.bottom")
    fits = (
        (F.col("item_type") == "text") & F.col("_q.tf") & (tail != "") & ~tail.rlike("^[A-Z]")
        & (F.col("_prev") != "") & ~F.col("_prev").rlike(r"[.?!:;]$") & (gap >= 0) & (gap <= CONTINUATION_GAP)
    )
    marked = seen.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    stop = F.when((F.col("item_type") != "question") & ~F.col("_fits"), F.col("seq"))
    stopped = marked.withColumn("_stop", F.max(stop).over(before))
    joined = F.col("_fits") & ~F.coalesce(F.col("_stop") > F.col("_q.seq"), F.lit(False))
    keyed = stopped.withColumn("_head", F.when(joined, F.col("_q.seq")).otherwise(F.col("seq")))
    rest = [c for c in items.columns if c not in (*PAGE, "text")]
    return keyed.groupBy(*PAGE, "_head").agg(
        F.min_by(F.struct(*rest), "seq").alias("_row"),
        F.when(F.count("*") == 1, F.min("text")).otherwise(Q.ordered_join(tail, F.col("seq"), " ")).alias("text"),
    ).select(*PAGE, "_row.*", "text")


def item_text() -> Column:
    """Readable text of an item; tables arrive as caption, header and row lines already."""
    return F.when(F.col("item_type") == "image", X.strip(F.coalesce(F.col("caption"), F.lit("")))).otherwise(X.strip(F.col("text")))


def lesson_text(items: DataFrame) -> DataFrame:
    """All readable text of a lesson, newline-joined in order."""
    text = item_text()
    return items.groupBy("doc_id", "lesson").agg(
        Q.ordered_join(F.when(text != "", text), F.struct("page", "seq"), "\n").alias("lesson_text"), F.count("*").alias("n_items")
    )


def page_label_histogram(nodes: DataFrame) -> DataFrame:
    """Counts of each label on each page, and the page's distinct parents."""
    counts = nodes.groupBy(*PAGE, "node_type").agg(F.count("*").alias("n"))
    labels = counts.groupBy(*PAGE).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("node_type", "n"))), lambda e: F.concat(e["node_type"], F.lit("="), e["n"])), ","
        ).alias("labels")
    )
    parents = nodes.where(F.col("parent_id").isNotNull()).groupBy(*PAGE).agg(
        F.array_join(F.array_sort(F.collect_set("parent_id")), ",").alias("parents")
    )
    return labels.join(parents, PAGE, "left").na.fill("", ["parents"])


def read_book_tree(chapters: DataFrame, lessons: DataFrame, pages: DataFrame, items: DataFrame) -> DataFrame:
    """One row per item in chapter, lesson, page, item order with all titles: the flat book."""
    p = pages.select(*PAGE, "lesson")
    ls = lessons.select("doc_id", "lesson", "chapter", F.col("title").alias("lesson_title"))
    ch = chapters.select("doc_id", "chapter", F.col("title").alias("chapter_title"))
    return items.join(p, PAGE).join(ls, ["doc_id", "lesson"]).join(ch, ["doc_id", "chapter"])


def nested_counts(chapters: DataFrame, lessons: DataFrame, pages: DataFrame, items: DataFrame) -> DataFrame:
    """Chapter, lesson, page and item counts per document, side by side."""
    count = lambda df, n: df.groupBy("doc_id").agg(F.count("*").alias(n))
    return (
        count(chapters, "chapters").join(count(lessons, "lessons"), "doc_id").join(count(pages, "pages"), "doc_id")
        .join(count(items, "items"), "doc_id", "left").na.fill(0, ["items"])
    )


def intersection_size(segments: DataFrame, units: DataFrame) -> DataFrame:
    """(doc_id, segment, unit_ord, n): nodes that a segment and a unit share, for all pairs that share any.

    They meet on the node; the counts combine before the shuffle.
    """
    sides = segments.select("doc_id", "node_id", "segment").distinct(), units.select("doc_id", "node_id", "unit_ord").distinct()
    return sides[0].join(sides[1], ["doc_id", "node_id"]).groupBy("doc_id", "segment", "unit_ord").agg(F.count("*").alias("n"))


def assign_units_by_overlap(segments: DataFrame, units: DataFrame) -> DataFrame:
    """Unit of each segment: greedily the pair sharing most nodes, then leftovers in order.

    ``segments``: doc_id, segment, node_id.  ``units``: doc_id, unit_ord, unit_id, node_id; both numbers
    are from 0 up.  Overlaps are counted by a join and matched in rounds, so no document is in one task.
    """
    shared = intersection_size(segments, units)
    todo = stage(segments.select("doc_id", "segment").distinct())
    names = stage(units.groupBy("doc_id", "unit_ord").agg(F.max("unit_id").alias("unit_id")))
    best = dominant_pairs(shared, ["doc_id"], "segment", "unit_ord", "n")
    left = todo.join(best, ["doc_id", "segment"], "left_anti")
    free = names.select("doc_id", "unit_ord").join(best, ["doc_id", "unit_ord"], "left_anti")
    matched = best.unionByName(paired_in_order(left, free, ["doc_id"], "segment", "unit_ord"))
    return todo.join(matched.join(names, ["doc_id", "unit_ord"]), ["doc_id", "segment"], "left").select("doc_id", "segment", "unit_id")


def resolve_lessons(book: DataFrame, course: DataFrame) -> DataFrame:
    """Course lesson of each book lesson: by plan id, else by lower-cased title, each used once.

    Book lessons choose in their order; the rounds of ``served_in_order`` give the same rows without
    a course in one task.

    ``book``: course_id, ord, unit_id, title, unit_title.  ``course``: course_id, lesson_id, plan_id, title, display_order.
    """
    mapped = book.join(
        course.where(F.col("plan_id").isNotNull()).groupBy("course_id", F.col("plan_id").alias("unit_id")).agg(
            F.max_by("lesson_id", "lesson_id").alias("planned")
        ),
        ["course_id", "unit_id"],
        "left",
    )
    title = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    # Lessons of a course with one title are a queue, in course order; the book's lessons are served in theirs.
    offers = course.select(
        "course_id", title("title").alias("queue"), F.col("display_order").cast("long").alias("at"), F.col("lesson_id").alias("offer")
    ).where(F.col("queue").isNotNull())
    asks = stage(
        mapped.select(
            "course_id", F.col("ord").cast("long").alias("at"), title("title").alias("first"), title("unit_title").alias("second"),
            F.col("planned").alias("fixed"),
        )
    )
    wanted = asks.select("course_id", F.explode(F.array("first", "second")).alias("queue")).distinct()
    offers = offers.na.fill(-1, ["at"]).join(wanted, ["course_id", "queue"], "left_semi")
    chosen = served_in_order(asks, placed_in_queue(offers, ["course_id", "queue"], "at", "offer"), "course_id")
    return asks.join(chosen, ["course_id", "at"], "left").select("course_id", F.col("at").alias("ord"), F.col("offer").alias("lesson_id"))


def chapter_order_offset(documents: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chapters of a course in one order: each document shifted by the chapters before it.

    ``documents``: course_id, doc_id (document order).  ``chapters``: doc_id, chapter.
    """
    sizes = chapters.groupBy("doc_id").agg(F.count("*").alias("_n"))
    placed = documents.join(sizes, "doc_id", "left").na.fill(0, ["_n"])
    offsets = Q.scan(placed, ["course_id"], "doc_id", {"_before": ("sum", F.col("_n"), False)})
    return chapters.join(offsets.select("course_id", "doc_id", "_before"), "doc_id").select(
        "course_id", "doc_id", "chapter", (F.col("chapter") + F.col("_before")).alias("course_order")
    )


def page_views(contexts: DataFrame, unit_pages: DataFrame, annotation_pages: DataFrame, concept_pages: DataFrame) -> DataFrame:
    """Per page above 0: title, preview, full text and the distinct ids, sorted, of units, annotations and concepts on it."""
    def ids(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy(*PAGE).agg(F.array_sort(F.collect_set(F.col(key).cast("string"))).alias(f"{key}s"))

    sides = {"unit": unit_pages, "annotation": annotation_pages, "concept": concept_pages}
    views = contexts.where(F.col("page") != 0).select(
        *PAGE, F.coalesce("heading", F.lit("")).alias("title"), X.text_preview(F.col("page_text")).alias("preview"), F.col("page_text").alias("full_text")
    )
    for name, df in sides.items():
        views = views.join(ids(df, f"{name}_id"), PAGE, "left")
    views = views.withColumns({f"{name}_ids": F.coalesce(f"{name}_ids", F.array().cast("array<string>")) for name in sides})
    return views.withColumns({f"n_{name}s": F.size(f"{name}_ids").cast("long") for name in sides})


def flashcard_seeds(definitions: DataFrame, equations: DataFrame) -> DataFrame:
    """Distinct cards: (term, definition) and (label or ``Equation``, latex)."""
    a = definitions.select(X.strip(F.col("term")).alias("front"), X.strip(F.col("body")).alias("back"), F.lit("definition").alias("source"))
    b = equations.select(
        F.when(X.strip(F.coalesce("label", F.lit(""))) != "", X.strip(F.col("label"))).otherwise("Equation").alias("front"),
        X.strip(F.col("latex")).alias("back"),
        F.lit("equation").alias("source"),
    )
    both = a.unionByName(b).where((F.col("front") != "") & (F.col("back") != ""))
    return both.groupBy("front", "back").agg(F.min("source").alias("source"))
