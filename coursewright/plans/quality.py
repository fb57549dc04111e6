"""Data-quality queries over the course tables and their documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursewright.operators import quality as D
from coursewright.plans.tables import cards
from coursewright.sources import tables as T


def tables(s, sf):
    """The reported tables; a document's course is its id modulo the five courses."""
    docs = T.table(s, sf, "documents")
    return {
        "courses": T.courses(s, sf),
        "units": T.course_units(s, sf),
        "sections": T.sections(s, sf),
        "lessons": T.lessons(s, sf),
        "documents": docs.select(F.col("doc_id").alias("document_id"), "source", "lang"),
        "course_documents": docs.select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 5).alias("course_id")),
        "lp_document_process": T.runs(s, sf).select("run_id", F.col("doc_id").alias("document_id"), "status"),
    }


def scope_counts(kind, scope_id):
    def run(s, sf):
        found = tables(s, sf)
        return D.table_row_counts({n: D.scope_filter(found, n, kind, scope_id) for n in found})

    return run


def column_stats(s, sf):
    c = cards(s, sf).join(T.table(s, sf, "documents").select(F.col("doc_id").alias("card_id"), "text"), "card_id", "left")
    return D.required_column_stats(c, "cards", ["user_id", "course_id", "text"]).unionByName(
        D.required_column_stats(T.table(s, sf, "documents"), "documents", ["source", "lang", "text"])
    )


def orphans(s, sf):
    return D.find_orphans(
        T.table(s, sf, "documents"), T.table(s, sf, "labels"), "doc_id", "doc_id", "doc_id", "documents.doc_id->labels.doc_id"
    )


def counts(s, sf):
    found = tables(s, sf)
    empty = T.courses(s, sf).where(F.col("title") == "")
    return D.table_row_counts(found).unionByName(
        # A reported table without rows.
        empty.agg(F.count("*").alias("row_count")).select(F.lit("lp_documents").alias("table_name"), "row_count")
    )


def _rules(s, kind):
    # The rule set.
    if kind == "non_empty":
        return s.createDataFrame(
            [
                ("table.documents.non_empty", "error", "documents"),
                ("table.course_documents.non_empty", "error", "course_documents"),
                ("table.lp_documents.non_empty", "warning", "lp_documents"),
                ("table.lp_book_item.non_empty", "warning", "lp_book_item"),
            ],
            "rule_id string, severity string, table_name string",
        )
    if kind == "columns":
        return s.createDataFrame(
            [
                ("columns.documents.required", "error", "documents", ["source", "lang"]),
                ("columns.cards.required", "warning", "cards", ["user_id", "text", "absent"]),
            ],
            "rule_id string, severity string, table_name string, columns array<string>",
        )
    if kind == "fk":
        return s.createDataFrame(
            [
                ("fk.documents.labels", "error", "documents.doc_id->labels.doc_id", "documents", "labels"),
                ("fk.units.courses", "error", "units.course_id->courses.id", "units", "courses"),
            ],
            "rule_id string, severity string, relation_name string, child_table string, parent_table string",
        )
    return s.createDataFrame(
        [
            ("ratio.lessons.to.sections", "warning", "sections", "lessons", 1.0),
            ("ratio.lessons.to.documents", "warning", "lessons", "documents", 1.0),
            ("ratio.lp_book_page.to.lp_book_lesson", "warning", "lp_book_lesson", "lp_book_page", 1.0),
        ],
        "rule_id string, severity string, driving string, dependent string, minimum double",
    )


def findings(s, sf):
    n = counts(s, sf)
    known = n.unionByName(cards(s, sf).agg(F.count("*").alias("row_count")).select(F.lit("cards").alias("table_name"), "row_count"))
    gaps = D.orphan_counts(
        T.table(s, sf, "documents"), T.table(s, sf, "labels"), "doc_id", "doc_id",
        ("documents.doc_id->labels.doc_id", "documents", "labels"),
    ).unionByName(
        D.orphan_counts(
            T.course_units(s, sf), T.courses(s, sf), "course_id", "course_id",
            ("units.course_id->courses.id", "units", "courses"),
        )
    )
    return D.union(
        [
            D.non_empty_findings(n, _rules(s, "non_empty")),
            D.required_column_findings(known, column_stats(s, sf), _rules(s, "columns")),
            D.foreign_key_findings(n, gaps, _rules(s, "fk")),
            D.cross_table_ratio(n, _rules(s, "ratio")),
        ]
    )


QUERIES = {
    "scope_filter": scope_counts("course", 2),
    "scope_filter_document": scope_counts("document", 7),
    "table_row_counts": scope_counts("global", None),
    "required_column_stats": column_stats,
    "find_orphans": orphans,
    "expected_non_empty": lambda s, sf: D.expected_non_empty(s, scope_counts("document", 7)(s, sf), "document"),
    "cross_table_ratio": lambda s, sf: D.cross_table_ratio(counts(s, sf), _rules(s, "ratio")),
    "evaluate_dq_rules": findings,
    "verdict": lambda s, sf: D.verdict(findings(s, sf)),
}
