"""Books of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursewright.operators import book as B
from coursewright.operators import structure as S
from coursewright.plans.annotations import annotations
from coursewright.plans.structure import chained, nodes
from coursewright.plans.units import unit_nodes, unit_table
from coursewright.session import stage
from coursewright.sources import tables as T


def levelled(s, sf):
    return stage(S.repair_heading_levels(nodes(s, sf)))


def page_rows(s, sf):
    return stage(B.heading_signals(B.dedupe_page_headings(levelled(s, sf))))


def plain_pages(s, sf):
    """Pages without any heading signal in documents of odd id: the fallback segmentation."""
    odd = F.col("doc_id") % 2 == 1
    hide = lambda c: F.when(~odd, F.col(c)).alias(c)
    return page_rows(s, sf).select("doc_id", "page", hide("chapter_heading"), hide("lesson_heading"))


def lessons(s, sf):
    return stage(B.segment_chapters(stage(B.lesson_segments(stage(B.segment_lessons(stage(plain_pages(s, sf))))))))


def items(s, sf):
    """Items with point boxes, question types and some running headers."""
    n = F.col("seq")
    staged = nodes(s, sf).withColumn(
        "text",
        F.when(n % 6 == 1, F.concat(F.lit("Study Guide for Content Mastery  "), F.col("text")))
        .when(n % 10 == 4, "Name Date Class 12")
        .when(n % 10 == 9, F.concat((n % 7 + 1).cast("string"), F.lit(") "), F.lower("text")))
        .otherwise(F.col("text")),
    )
    return B.nodes_to_items(staged).select(
        "doc_id", "page", "node_id", "seq", "item_order", "item_type", "text",
        F.when(F.col("item_type") == "question", F.when(n % 3 == 0, "open").otherwise("true_false")).alias("question_type"),
        F.when(F.col("item_type") == "list", 1).otherwise(0).alias("n_items"),
        (F.col("y") * 800).alias("y_pt"), (F.col("h") * 100).alias("h_pt"), F.lit(800.0).alias("page_pt"),
        F.lit(None).cast("string").alias("caption"),
    )


def formed(s, sf):
    """Every eighth line opens a form area; the two lines after it are its text."""
    n = F.col("seq")
    return nodes(s, sf).withColumn(
        "node_type", F.when(n % 8 == 4, "form_area").when(n % 8 == 5, "text_item").when(n % 8 == 6, "text_item").otherwise(F.col("node_type"))
    ).withColumn("parent_id", F.when(n % 8 == 5, F.concat_ws("/", F.col("doc_id"), n - 1)))


def echoed(s, sf):
    """Items in which the two lines after a heading repeat it, spaced otherwise."""
    from coursewright.operators import sequence as Q

    head = F.when(F.col("node_type") == "heading", F.struct("seq", "text"))
    base = stage(nodes(s, sf).select("doc_id", "page", "node_id", "seq", "node_type", "text"))
    seen = Q.scan(base, ["doc_id"], "seq", {"_h": ("last", head, False)})
    near = (F.col("node_type") != "heading") & (F.col("seq") - F.col("_h.seq") <= 2) & (F.col("seq") % 4 != 0)
    return seen.select(
        "doc_id", "page", "node_id", "seq",
        F.when(F.col("node_type") == "heading", "heading").otherwise("text").alias("item_type"),
        F.when(near, F.concat(F.lit("  "), F.col("_h.text"), F.lit(" "))).otherwise(F.col("text")).alias("text"),
    )


def questions(s, sf):
    """Numbered lists beside true/false questions; text that may continue them."""
    n = F.col("seq")
    return nodes(s, sf).select(
        "doc_id", "page", "node_id", "seq",
        F.when(n % 4 == 1, "question").when(n % 4 == 2, "list").otherwise("text").alias("item_type"),
        F.when(n % 4 == 1, F.when(n % 12 == 5, "open").otherwise("true_false")).alias("question_type"),
        F.when(n % 4 == 2, F.when(n % 3 == 0, 2).otherwise(1)).otherwise(0).alias("n_items"),
        F.when(n % 4 == 1, F.concat((n % 9).cast("string"), F.lit(". "), F.col("text")))
        .when(n % 4 == 2, F.concat((n % 5).cast("string"), F.lit(") "), F.col("text")))
        .otherwise(F.lower("text")).alias("text"),
        (n % 8 * 20).cast("double").alias("y_pt"), F.lit(10.0).alias("h_pt"),
    )


def continued(s, sf):
    rows = questions(s, sf).withColumn("item_type", F.when(F.col("item_type") == "list", "text").otherwise(F.col("item_type")))
    return B.join_question_continuation(rows.withColumn("text", F.lower("text"))).select("node_id", "item_type", "text")


def lesson_items(s, sf):
    placed = stage(B.segment_lessons(stage(plain_pages(s, sf)))).select("doc_id", "page", "lesson")
    return items(s, sf).join(placed, ["doc_id", "page"])


def book(s, sf):
    pages = stage(B.segment_lessons(stage(plain_pages(s, sf))))
    ls = stage(B.segment_chapters(stage(B.lesson_segments(pages))))
    return B.chapter_segments(ls), ls, pages, items(s, sf)


def both_sides(s, sf):
    pages = stage(B.segment_lessons(page_rows(s, sf)))
    n = nodes(s, sf).select("doc_id", "page", "node_id")
    segments = n.join(pages.select("doc_id", "page", "lesson"), ["doc_id", "page"]).select(
        "doc_id", F.col("lesson").alias("segment"), "node_id"
    )
    members = unit_nodes(s, sf).where(F.col("level").isNotNull())
    us = members.join(
        unit_table(s, sf).select("doc_id", "unit_id", F.col("seq").cast("long").alias("unit_ord")), ["doc_id", "unit_id"]
    )
    return segments, us.select("doc_id", "unit_ord", "unit_id", "node_id")


def resolved(s, sf):
    """Sections as courses: book lessons are its practices, course lessons its orders."""
    ls = T.lessons(s, sf).select(
        F.col("section_id").alias("course_id"), "lesson_id", "title", "display_order",
        F.when(F.col("lesson_id") % 6 == 0, F.concat(F.lit("p"), (F.col("lesson_id") % 40).cast("string"))).alias("plan_id"),
    )
    priorities = F.array(*[F.lit(v) for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    named = lambda c: F.element_at(priorities, (c % 5 + 1).cast("int"))
    book_lessons = T.table(s, sf, "lineitem").join(
        T.table(s, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey"
    ).groupBy(F.col("o_custkey").alias("course_id"), F.col("l_suppkey").alias("ord")).agg(F.min("l_partkey").alias("k"))
    return B.resolve_lessons(
        book_lessons.select(
            "course_id", "ord", F.concat(F.lit("p"), (F.col("k") % 40).cast("string")).alias("unit_id"),
            F.lower(named(F.col("k"))).alias("title"), named(F.col("ord")).alias("unit_title"),
        ), ls,
    )


def offsets(s, sf):
    docs = T.table(s, sf, "documents").select("doc_id", (F.col("doc_id") % 5).alias("course_id"))
    return B.chapter_order_offset(docs, B.chapter_segments(lessons(s, sf)).select("doc_id", "chapter"))


def views(s, sf):
    base = stage(nodes(s, sf))
    pages = base.select("doc_id", "node_id", "page")
    found = stage(annotations(s, sf).select("doc_id", "node_id", "type", "term", F.concat_ws("/", "node_id", "type", "ord").alias("annotation_id")))
    terms = found.where(F.col("type") == "key_term").select("doc_id", "node_id", F.lower("term").alias("concept_id"))
    shown = B.page_views(
        S.page_contexts(base),
        unit_nodes(s, sf).select("doc_id", "page", "unit_id"),
        found.join(pages, ["doc_id", "node_id"]),
        terms.join(pages, ["doc_id", "node_id"]),
    )
    # The ids as lines of one text.
    return shown.withColumns({c: F.array_join(c, "\n") for c in ("unit_ids", "annotation_ids", "concept_ids")})


QUERIES = {
    "dedupe_page_headings": lambda s, sf: B.dedupe_page_headings(
        nodes(s, sf).withColumn("text", F.when(F.col("node_type") == "heading", F.concat(F.lit(" Part  "), (F.col("seq") % 3).cast("string"))).otherwise(F.col("text")))
    ).select("node_id", "text"),
    "heading_signals": lambda s, sf: B.heading_signals(levelled(s, sf)),
    "segment_lessons_by_anchor": lambda s, sf: B.segment_lessons(page_rows(s, sf)).select("doc_id", "page", "lesson"),
    "segment_lessons_by_size": lambda s, sf: B.segment_lessons(stage(plain_pages(s, sf))).where(
        F.col("lesson_heading").isNull()
    ).select("doc_id", "page", "lesson"),
    "segment_titles": lambda s, sf: lessons(s, sf).select("doc_id", "lesson", "first_page", "last_page", "title"),
    "segment_chapters": lambda s, sf: B.chapter_segments(lessons(s, sf)),
    "nodes_to_items": lambda s, sf: B.nodes_to_items(formed(s, sf)).select("node_id", "item_type", "item_order"),
    "strip_page_chrome": lambda s, sf: B.strip_page_chrome(items(s, sf)).select("node_id", "text"),
    "drop_heading_echo": lambda s, sf: B.drop_heading_echo(echoed(s, sf)).select("node_id", "item_type"),
    "promote_true_false": lambda s, sf: B.promote_true_false(questions(s, sf)).select("node_id", "item_type", "question_type"),
    "join_question_continuation": continued,
    "reindex": lambda s, sf: B.reindex(items(s, sf).where(F.col("item_type") != "image")).select("node_id", "item_order"),
    "item_text": lambda s, sf: items(s, sf).select("node_id", B.item_text().alias("item_text")),
    "lesson_text": lambda s, sf: B.lesson_text(lesson_items(s, sf)),
    "page_label_histogram": lambda s, sf: B.page_label_histogram(chained(s, sf)),
    "read_book_tree": lambda s, sf: B.read_book_tree(*book(s, sf)).select(
        "doc_id", "chapter", "lesson", "page", "item_order", "chapter_title", "lesson_title", "node_id"
    ),
    "nested_counts": lambda s, sf: B.nested_counts(*book(s, sf)),
    "intersection_size": lambda s, sf: B.intersection_size(*both_sides(s, sf)),
    "assign_units_by_overlap": lambda s, sf: B.assign_units_by_overlap(*both_sides(s, sf)),
    "resolve_lessons": resolved,
    "chapter_order_offset": offsets,
    "page_views": views,
}
