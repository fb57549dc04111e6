"""Box, line and style matching over every page."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursewright.functions import text as X
from coursewright.operators import layout as L
from coursewright.session import stage
from coursewright.sources.nodes import document_nodes

PAD = 0.004


def boxes(s, sf):
    return document_nodes(s, sf).select(
        "doc_id", "page", "node_id", "seq", "node_type", "text", F.col("x").alias("x0"), F.col("y").alias("y0"),
        (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"),
    )


def lines(s, sf):
    """Six words to a line, two lines to a block, drawn inside the node's box."""
    # One split gives the words of all lines; a text without a word has one empty line.
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.size(w), F.lit(6)), lambda at: F.array_join(F.slice(w, at, 6), " "))
    pieces = X.bound(X.tokens(F.col("text")), lambda w: F.when(F.size(w) > 0, cut(w)))
    staged = boxes(s, sf).select(
        "doc_id", "page", "node_id", F.col("seq").alias("node_seq"), "x0", "x1", "y0",
        F.posexplode_outer(pieces).alias("at", "piece"),
    ).withColumn("line_no", F.coalesce("at", F.lit(0)))
    k = F.col("line_no")
    fonts = F.array(F.lit("Courier"), F.lit("Times"), F.lit("Arial Bold"))
    return staged.select(
        "doc_id", "page", "node_id", "node_seq", "line_no", F.floor(k / 2).alias("block"),
        F.coalesce("piece", F.lit("")).alias("text"),
        "x0", "x1", (F.col("y0") + k % 10 * 0.01).alias("y0"), (F.col("y0") + k % 10 * 0.01 + 0.009).alias("y1"),
        F.element_at(fonts, (F.col("node_seq") % 3 + F.when(F.col("node_seq") % 2 == 0, 0).otherwise(k % 2)).cast("int") % 3 + 1).alias("font"),
        (9.0 + k % 2).alias("size"), (F.col("node_seq") % 4 == 1).alias("bold"),
    )


def matched(s, sf):
    own = stage(lines(s, sf))
    hits = L.match_lines_in_box(
        stage(boxes(s, sf)), own.select("doc_id", "page", F.col("node_id").alias("line_of"), "line_no", "text", "x0", "y0", "x1", "y1"), PAD
    )
    return hits.select("node_id", "line_of", "line_no")


def covered(s, sf):
    b = stage(boxes(s, sf).where(F.col("node_type").isin("figure", "equation", "list")))
    return L.spatial_cover_anti_join(
        b.where(F.col("node_type") != "figure").withColumnRenamed("node_id", "rect_id"), b.where(F.col("node_type") == "figure")
    ).select("rect_id")


QUERIES = {
    "spatial_cover_anti_join": covered,
    "match_lines_in_box": matched,
    "best_overlap_style": lambda s, sf: L.best_overlap_style(boxes(s, sf), lines(s, sf).drop("node_id"), PAD).select(
        "node_id", "font", "size", "bold"
    ),
    "split_by_block_and_style": lambda s, sf: L.split_by_block_and_style(lines(s, sf)).drop("doc_id"),
}
