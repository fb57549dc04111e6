"""Structure rebuilding over every node of the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursewright.functions import text as X
from coursewright.operators import structure as S
from coursewright.operators import trees as R
from coursewright.session import stage
from coursewright.sources import nodes as N
from coursewright.sources.tables import table


def nodes(s, sf):
    return N.document_nodes(s, sf).withColumn("parent_id", F.lit(None).cast("string"))


def sectioned(s, sf):
    return S.compose_passes([S.repair_heading_levels, S.assign_sections])(nodes(s, sf))


def normalised(s, sf):
    """All passes: levels, captions, paragraphs, lists, sections."""
    passes = S.compose_passes(
        [S.repair_heading_levels, S.attach_captions, S.merge_paragraphs, S.merge_lists, S.assign_sections]
    )
    return passes(nodes(s, sf))


def listed(s, sf):
    """Two lines in three are lists; every fifth line sits under the line before."""
    n = F.col("seq")
    before = F.concat_ws("/", F.col("doc_id"), n - 1)
    return nodes(s, sf).select(
        "doc_id", "node_id", "seq", "text",
        F.when(n % 3 != 0, "list").otherwise("paragraph").alias("node_type"),
        F.when(F.expr("seq div 4") % 2 == 0, "bullet").otherwise("numbered").alias("list_style"),
        F.when((n > 0) & (n % 5 == 4), before).alias("parent_id"),
    )


def chained(s, sf):
    n = F.col("seq")
    return nodes(s, sf).withColumn("parent_id", F.when((n > 0) & (n % 4 == 1), F.concat_ws("/", F.col("doc_id"), n - 1)))


def columned(s, sf):
    return S.assign_columns(nodes(s, sf))


def section_tree(placed):
    return R.closure(placed, ["doc_id"], "node_id", "parent_id", 4)


def bounds(s, sf):
    placed = stage(sectioned(s, sf))
    return S.propagate_bounds(placed, section_tree(placed))


def preorder(s, sf):
    placed = stage(sectioned(s, sf).select("doc_id", "node_id", "parent_id", "seq"))
    return R.preorder(placed, ["doc_id"], "node_id", "parent_id", "seq", stage(section_tree(placed)))


def raw_tables(s, sf):
    rows = F.transform(F.split("text", "\n"), lambda r: X.tokens(r))
    return table(s, sf, "documents").select(
        "doc_id", rows.alias("table_rows"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(
            F.array().cast("array<string>")
        ).alias("headers"),
    )


def normalise_tables(s, sf):
    t = S.normalise_tables(raw_tables(s, sf))
    return t.select(
        "doc_id", "row_count", "column_count", "first_is_header", F.array_join("headers", "|").alias("headers"),
        F.aggregate("table_rows", F.lit(0), lambda a, r: a + F.size(r)).alias("n_cells"),
    )


def cells(s, sf):
    lines = N.scan_text_nodes(table(s, sf, "documents"))
    return lines.select(
        F.col("doc_id").alias("table_id"),
        F.col("seq").alias("row_index"),
        F.posexplode(X.tokens(F.col("text"))).alias("col_index", "text"),
    ).withColumn("is_header", (F.col("row_index") == 2) & (F.col("table_id") % 2 == 0))


def grouped_lists(s, sf):
    n = F.col("seq")
    slot = n % 5
    at = lambda k: F.concat_ws("/", F.col("doc_id"), n - k)
    return nodes(s, sf).select(
        "doc_id", "node_id", "seq", "list_style",
        F.when(slot.isin(1, 2, 3), at(slot)).when(slot == 4, at(F.lit(1))).alias("parent_id"),
        F.when(slot == 4, "paragraph").otherwise("list").alias("node_type"),
        F.when(slot == 0, "").otherwise(F.col("text")).alias("text"),
        F.when(slot == 0, 0).otherwise(1).alias("n_items"),
    )


def containers(s, sf):
    refs = table(s, sf, "pages").select(
        (F.col("page_id") % 10).alias("doc_id"), F.concat(F.lit("#"), F.regexp_replace("url", "^https?:/", "")).alias("ref")
    )
    return S.synthesise_containers(refs)


def tangled(s, sf):
    """Each line points at the line whose number is its own length modulo twice the line count."""
    n = F.size(F.split("text", "\n"))
    lines = table(s, sf, "documents").select("doc_id", n.alias("n"), F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    return lines.select(
        "doc_id", F.concat_ws("/", "doc_id", "seq").alias("node_id"), "seq",
        F.when(F.length("line") % 5 != 0, F.concat_ws("/", F.col("doc_id"), F.length("line") * 7 % (F.col("n") + 1))).alias("parent_id"),
    )


def images(s, sf):
    figures = nodes(s, sf).where(F.col("node_type") == "figure")
    stored = figures.where(F.col("text").contains("e")).select("doc_id", "node_id", F.sha2("text", 256).alias("image"))
    return S.hydrate_images(nodes(s, sf), stored).select("doc_id", "node_id", "image")


QUERIES = {
    "repair_heading_levels": lambda s, sf: S.repair_heading_levels(nodes(s, sf)).select("node_id", "level"),
    "attach_captions": lambda s, sf: S.attach_captions(stage(nodes(s, sf))).select("node_id", "node_type", "text", "caption"),
    "merge_paragraphs": lambda s, sf: S.merge_paragraphs(nodes(s, sf)).select("node_id", "node_type", "text", "n_merged"),
    "merge_lists": lambda s, sf: S.merge_lists(listed(s, sf)).select("node_id", "node_type", "text", "n_items"),
    "assign_sections": lambda s, sf: sectioned(s, sf).select("node_id", "parent_id"),
    "compose_passes": lambda s, sf: normalised(s, sf).select(
        "node_id", "node_type", "level", "text", "caption", "parent_id", "n_merged"
    ),
    "group_pages": lambda s, sf: S.group_pages(chained(s, sf)),
    "reading_order": lambda s, sf: S.reading_order(nodes(s, sf)).select("node_id", "position"),
    "assign_columns": lambda s, sf: columned(s, sf).select("node_id", "column_no"),
    "spatial_order": lambda s, sf: S.spatial_order(
        columned(s, sf).drop("parent_id").join(sectioned(s, sf).select("doc_id", "node_id", "parent_id"), ["doc_id", "node_id"])
    ).select("node_id", "position"),
    "propagate_bounds": bounds,
    "children_of": lambda s, sf: R.children_of(sectioned(s, sf), ["doc_id"], "node_id", "parent_id").select(
        "node_id", "parent_id", "n_children", "first_child"
    ),
    "dfs_sequence": lambda s, sf: preorder(s, sf).select("node_id", "position", "depth"),
    "child_parent_repair": lambda s, sf: R.repair_parents(tangled(s, sf), ["doc_id"], "node_id", "parent_id", "seq").select(
        "node_id", "parent_id"
    ),
    "normalise_tables": normalise_tables,
    "cells_to_rows": lambda s, sf: S.cells_to_rows(cells(s, sf)),
    "fold_list_items": lambda s, sf: S.fold_list_items(grouped_lists(s, sf)).drop("doc_id"),
    "synthesise_containers": containers,
    "hydrate_images": images,
    "drop_non_content": lambda s, sf: S.drop_non_content(nodes(s, sf)).select("node_id", "node_type"),
    "filter_page_range": lambda s, sf: nodes(s, sf).where(F.col("page").between(2, 3)).select("node_id", "page"),
    "node_plain_text": lambda s, sf: S.attach_captions(stage(nodes(s, sf))).select(
        "node_id",
        S.node_plain_text(
            F.col("node_type"), F.when(F.col("seq") % 2 == 0, F.col("text")).otherwise(""), F.col("caption")
        ).alias("plain"),
    ),
    "project_content_nodes": lambda s, sf: S.project_content_nodes(nodes(s, sf)).drop("doc_id"),
    "page_contexts": lambda s, sf: S.page_contexts(nodes(s, sf)),
    "text_preview": lambda s, sf: S.page_contexts(nodes(s, sf)).where(F.col("page") != 0).select(
        "doc_id", "page", X.text_preview(F.col("page_text")).alias("preview")
    ),
}
