"""Data-quality reports: counts, nulls, orphans, rules and verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


@dataclass(frozen=True)
class Hop:
    """One step of a join path: this table's ``fk`` names ``pk`` of ``parent``."""

    fk: str
    parent: str
    pk: str


# How each table reaches the course (or document) it belongs to.
COURSE_PATHS: dict[str, tuple[tuple[Hop, ...], str]] = {
    "courses": ((), "course_id"),
    "units": ((), "course_id"),
    "sections": ((Hop("unit_id", "units", "unit_id"),), "course_id"),
    "lessons": ((Hop("section_id", "sections", "section_id"), Hop("unit_id", "units", "unit_id")), "course_id"),
    "course_documents": ((), "course_id"),
    "documents": ((Hop("document_id", "course_documents", "document_id"),), "course_id"),
    "course_enrollments": ((), "course_id"),
    "lp_document_process": ((Hop("document_id", "course_documents", "document_id"),), "course_id"),
    "lp_book_chapter": ((Hop("document_id", "course_documents", "document_id"),), "course_id"),
}
DOCUMENT_PATHS: dict[str, tuple[tuple[Hop, ...], str]] = {
    "documents": ((), "document_id"),
    "course_documents": ((), "document_id"),
    "lp_document_process": ((), "document_id"),
    "lp_book_chapter": ((), "document_id"),
}


def scope_filter(tables: Mapping[str, DataFrame], name: str, kind: str, scope_id: object = None) -> DataFrame:
    """Rows of ``name`` inside a scope: global, one course, or one document.

    In document scope, tables without a document path follow the document's courses.
    The path is walked from the scope down with semi-joins on the (small) keys inside
    the scope, so the table itself is read once and never multiplied.
    """
    df = tables[name]
    if kind == "global":
        return df
    by_document = kind == "document" and name in DOCUMENT_PATHS
    paths = DOCUMENT_PATHS if by_document else COURSE_PATHS
    if name not in paths or scope_id is None:
        return df.where(F.lit(False))
    hops, column = paths[name]

    def inside(table: DataFrame) -> DataFrame:
        if by_document or kind == "course":
            return table.where(F.col(column) == F.lit(scope_id))
        of_document = tables["course_documents"].where(F.col("document_id") == F.lit(scope_id)).select("course_id")
        return table.join(of_document, column, "left_semi")

    if not hops:
        return inside(df)
    keys = inside(tables[hops[-1].parent]).select(hops[-1].pk)
    for i in range(len(hops) - 1, 0, -1):
        above = tables[hops[i - 1].parent]
        keys = above.join(keys.withColumnRenamed(hops[i].pk, hops[i].fk), hops[i].fk, "left_semi").select(hops[i - 1].pk)
    first = hops[0]
    return df.join(keys.withColumnRenamed(first.pk, first.fk), first.fk, "left_semi")


def table_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One count per table (``count(*)`` over Parquet reads footers only)."""
    return union(
        [
            df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
            for n, df in tables.items()
        ]
    )


def required_column_stats(df: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    """Null and empty-string counts per column in one pass."""
    counts = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns],
        *[F.count_if(F.col(c).cast("string") == "").alias(f"e_{c}") for c in columns],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"n_{c}").alias("null_count"),
                F.col(f"e_{c}").alias("empty_string_count"),
            )
            for c in columns
        ]
    )
    return counts.select(F.lit(name).alias("table_name"), F.inline(rows))


def find_orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str, own: str, relation: str, samples: int = 5) -> DataFrame:
    """Count of child rows without a parent (a null key counts) and the first few of them."""
    keys = parent.select(F.col(pk).alias(fk)).distinct()
    lost = child.select(own, fk).join(keys, fk, "left_anti")
    few = lost.select(own).distinct().orderBy(own).limit(samples)
    shown = few.agg(F.array_join(F.array_sort(F.collect_list(own)).cast("array<string>"), ",").alias("samples"))
    return lost.agg(F.count("*").alias("orphan_count")).select(
        F.lit(relation).alias("relation_name"), "orphan_count", shown.scalar().alias("samples")
    )


def orphan_counts(child: DataFrame, parent: DataFrame, fk: str, pk: str, names: tuple[str, str, str]) -> DataFrame:
    keys = parent.select(F.col(pk).alias(fk)).distinct()
    lost = child.select(fk).join(keys, fk, "left_anti").agg(F.count("*").alias("orphan_count"))
    return lost.select(
        F.lit(names[0]).alias("relation_name"),
        F.lit(names[1]).alias("child_table"),
        F.lit(names[2]).alias("parent_table"),
        "orphan_count",
    )


# Table, scopes in which it should have rows, severity, reason.
EXPECTED_NON_EMPTY = (
    ("documents", "global", "warning", "documents should contain at least one uploaded document"),
    ("course_documents", "global,course,document", "error", "course_documents should map documents to at least one course"),
    ("units", "course,document", "warning", "units should exist for scoped course/document"),
    ("sections", "course,document", "warning", "sections should exist for scoped course/document"),
    ("lessons", "course,document", "warning", "lessons should exist for scoped course/document"),
    (
        "lp_documents", "document", "warning",
        "lp_documents should contain canonical representation for scoped document",
    ),
)


def expected_non_empty(spark: SparkSession, counts: DataFrame, kind: str) -> DataFrame:
    """Tables that should have rows in this scope and do not."""
    spec = spark.createDataFrame(
        [(t, sev, why) for t, kinds, sev, why in EXPECTED_NON_EMPTY if kind in kinds.split(",")],
        "table_name string, severity string, reason string",
    )
    joined = spec.join(counts, "table_name", "left")
    return joined.where(F.coalesce("row_count", F.lit(0)) == 0).select(
        "table_name", "severity", "reason", F.coalesce("row_count", F.lit(0)).alias("row_count")
    )


def cross_table_ratio(
    counts: DataFrame, rules: DataFrame
) -> DataFrame:
    """Findings where dependent/driving falls below the minimum, or a table is missing.

    ``rules``: rule_id, severity, driving, dependent, minimum.
    """
    n = counts.select("table_name", "row_count")
    rows = rules.join(
        n.select(F.col("table_name").alias("driving"), F.col("row_count").alias("_a")), "driving", "left"
    ).join(n.select(F.col("table_name").alias("dependent"), F.col("row_count").alias("_b")), "dependent", "left")
    a, b, least = F.col("_a"), F.col("_b"), F.col("minimum")
    gone = F.when(a.isNull(), F.col("driving")).when(b.isNull(), F.col("dependent"))
    ratio = F.when(a > 0, b / a)
    return rows.where(gone.isNotNull() | (ratio < least)).select(
        "rule_id",
        "severity",
        F.coalesce(gone, F.col("dependent")).alias("table_name"),
        F.when(gone.isNotNull(), F.format_string("Cross-table ratio check missing table '%s'", gone))
        .otherwise(
            F.format_string(
                "Cross-table ratio %.3f below minimum %.3f for %s/%s", ratio, least, F.col("dependent"), F.col("driving")
            )
        )
        .alias("message"),
        F.when(gone.isNotNull(), F.lit(1).cast("long"))
        .otherwise(F.greatest(F.lit(0).cast("long"), F.floor(least * a - b)))
        .alias("affected_count"),
    )


def non_empty_findings(counts: DataFrame, rules: DataFrame) -> DataFrame:
    rows = rules.join(counts, "table_name", "left")
    return rows.where(F.coalesce("row_count", F.lit(0)) <= 0).select(
        "rule_id",
        "severity",
        "table_name",
        F.when(F.col("row_count").isNull(), F.format_string("Table '%s' is missing from report", F.col("table_name")))
        .otherwise(F.format_string("Table '%s' has zero rows", F.col("table_name")))
        .alias("message"),
        F.lit(1).cast("long").alias("affected_count"),
    )


def required_column_findings(counts: DataFrame, stats: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules``: rule_id, severity, table_name, columns (array)."""
    known = counts.select("table_name", F.lit(True).alias("_known"))
    wanted = rules.select("rule_id", "severity", "table_name", F.posexplode("columns").alias("pos", "column_name"))
    rows = wanted.join(stats, ["table_name", "column_name"], "left").join(known, "table_name", "left")
    bad = F.when(F.col("null_count").isNull(), 1).otherwise(F.col("null_count") + F.col("empty_string_count"))
    per_rule = rows.withColumn("_bad", bad).groupBy("rule_id", "severity", "table_name").agg(
        F.bool_or(F.coalesce("_known", F.lit(False))).alias("_known"),
        F.count("*").alias("_n"),
        F.sum("_bad").alias("_sum"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("_bad") > 0, F.struct("pos", "column_name")))),
                lambda e: e["column_name"],
            ),
            ", ",
        ).alias("_broken"),
    )
    return per_rule.where(~F.col("_known") | (F.col("_sum") > 0)).select(
        "rule_id",
        "severity",
        "table_name",
        F.when(~F.col("_known"), F.format_string("Table '%s' missing for required column checks", F.col("table_name")))
        .otherwise(F.concat(F.lit("Required columns have missing/invalid values: "), F.col("_broken")))
        .alias("message"),
        F.when(~F.col("_known"), F.col("_n")).otherwise(F.col("_sum")).alias("affected_count"),
    )


def foreign_key_findings(counts: DataFrame, gaps: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules``: rule_id, severity, relation_name, child_table, parent_table (one shared relation key)."""
    known = counts.select(F.col("table_name").alias("child_table"), F.lit(True).alias("_known"))
    rows = rules.join(known, "child_table", "left").join(gaps, ["relation_name", "child_table", "parent_table"], "left")
    gone = F.col("_known").isNull()
    return rows.where(gone | (F.col("orphan_count") > 0)).select(
        "rule_id",
        "severity",
        F.col("child_table").alias("table_name"),
        F.when(gone, F.format_string("Child table '%s' missing for FK integrity rule", F.col("child_table")))
        .otherwise(F.format_string("Foreign-key orphans detected in relation '%s'", F.col("relation_name")))
        .alias("message"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.col("orphan_count")).alias("affected_count"),
    )


def verdict(findings: DataFrame) -> DataFrame:
    errors, warnings = F.count_if(F.col("severity") == "error"), F.count_if(F.col("severity") == "warning")
    return findings.agg(
        F.when(errors > 0, "fail").when(warnings > 0, "warn").otherwise("pass").alias("verdict"),
        F.count("*").alias("finding_count"),
        errors.alias("error_count"),
        warnings.alias("warning_count"),
    )


def artifact_counts(artifacts: Mapping[str, DataFrame]) -> DataFrame:
    """Labelled row counts of each kind of artifact per document."""
    return union(
        [
            df.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(name).alias("artifact"), "n")
            for name, df in sorted(artifacts.items())
        ]
    )


def is_acyclic(remainder: DataFrame, documents: DataFrame) -> DataFrame:
    """Whether each document's graph has no cycle, given what peeling left of it."""
    stuck = remainder.select("doc_id").distinct().withColumn("_stuck", F.lit(True))
    return documents.select("doc_id").distinct().join(stuck, "doc_id", "left").select(
        "doc_id", F.col("_stuck").isNull().alias("is_dag")
    )
