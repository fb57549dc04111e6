"""Matching of page boxes, text lines and styles.  Every range join keeps (doc_id, page) as equi-key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursewright.functions import geometry as G
from coursewright.functions import text as X
from coursewright.operators import sequence as Q
from coursewright.session import stage

PAGE = ["doc_id", "page"]


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c) if c in PAGE else F.col(c).alias(f"{prefix}{c}") for c in df.columns])


#: Height of the strips of a page that share boxes, in the boxes' unit.
STRIP = 1 / 16


def in_strips(df: DataFrame, low: str, high: str, strip: float) -> DataFrame:
    """One row for each strip of the page that a box reaches."""
    edge = lambda c: F.floor(F.col(c) / strip)
    return df.withColumn("_strip", F.explode(F.sequence(edge(low), edge(high))))


def spatial_cover_anti_join(rects: DataFrame, pictures: DataFrame, threshold: float = 0.5, strip: float = STRIP) -> DataFrame:
    """Rects with an area of which no picture of the page covers ``threshold`` or more (above 0).

    Boxes meet within strips of the page, so a page with very many of them is spread.
    """
    own = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    p = pictures.select(*PAGE, *[F.col(c).alias(f"p_{c}") for c in ("x0", "y0", "x1", "y1")])
    live = rects.where(own > 0)
    covered = (
        in_strips(live, "y0", "y1", strip).join(in_strips(p, "p_y0", "p_y1", strip), [*PAGE, "_strip"])
        .where(G.overlap_ratio(box(), box("p_")) >= threshold)
        .select("doc_id", "rect_id")
        .distinct()
    )
    return live.join(covered, ["doc_id", "rect_id"], "left_anti")


def match_lines_in_box(nodes: DataFrame, lines: DataFrame, padding: float, strip: float = STRIP) -> DataFrame:
    """Lines touching a node's padded box whose text occurs in the node's text.

    Boxes meet within strips of the page; a pair is taken in the first strip that both reach.
    """
    n = nodes.select(*PAGE, "node_id", X.fold_text(F.col("text")).alias("_text"), *[F.col(c).alias(f"n_{c}") for c in ("x0", "y0", "x1", "y1")])
    touching = ~(
        (F.col("x1") < F.col("n_x0") - padding) | (F.col("n_x1") + padding < F.col("x0"))
        | (F.col("y1") < F.col("n_y0") - padding) | (F.col("n_y1") + padding < F.col("y0"))
    )
    # Blank lines go by a plain trim, so that a line is folded once.
    folded = lines.where(X.strip(F.col("text")) != "").withColumn("_line", X.fold_text(F.col("text")))
    padded = n.withColumns({"_top": F.col("n_y0") - padding, "_bottom": F.col("n_y1") + padding})
    met = in_strips(padded, "_top", "_bottom", strip).join(in_strips(folded, "y0", "y1", strip), [*PAGE, "_strip"])
    once = F.col("_strip") == F.greatest(F.floor(F.col("_top") / strip), F.floor(F.col("y0") / strip))
    # Not a bare ``contains``: for that Spark also filters by folded texts that are not null and so folds them again.
    hits = met.where(once & touching & F.coalesce(F.col("_text").contains(F.col("_line")), F.lit(False)))
    return hits.drop("_strip", "_top", "_bottom", "_text", "_line", *[f"n_{c}" for c in ("x0", "y0", "x1", "y1")])


#: Nodes of a page from which on its boxes meet within strips of it.
CROWD = 64


def best_overlap_style(nodes: DataFrame, spans: DataFrame, padding: float, strip: float = STRIP) -> DataFrame:
    """Style of each node: a touching span with matching text, else the largest overlap, else matching text anywhere.

    Texts move once, by page, and nothing is stored: a page's spans stream past its few nodes.  On pages of more
    than ``CROWD`` nodes (found first, from a narrow read) boxes meet within strips of the page only; a pair that
    shares several strips changes no maximum.
    """
    n = nodes.select(
        *PAGE, "node_id", F.lower(X.strip(F.col("text"))).alias("_text"),
        (F.col("x0") - padding).alias("n_x0"), (F.col("y0") - padding).alias("n_y0"),
        (F.col("x1") + padding).alias("n_x1"), (F.col("y1") + padding).alias("n_y1"),
    )
    # What the spans of a node mostly share stands together, so that a row repeats much of the row before when it moves.
    span = spans.select(*PAGE, "node_seq", "x0", "x1", "bold", "y0", "y1", "size", "line_no", "font", F.lower(X.strip(F.col("text"))).alias("_span"))
    crowded = stage(nodes.groupBy(*PAGE).agg(F.count("*").alias("_n")).where(F.col("_n") > CROWD).select(*PAGE))
    few = lambda df: df.join(crowded, PAGE, "left_anti")
    # A pair that touches takes part whatever the texts, any other pair by its texts.
    met = few(span).join(few(n), PAGE).withColumns({"_touch": _touching(), "_same": _same_text()})
    ranked = _ranked(met.where(F.col("_touch") | (F.coalesce("_same", F.lit(False)) & (F.col("_span") != ""))))
    if not crowded.isEmpty():
        many = lambda df: stage(df.join(crowded, PAGE, "left_semi"))
        ranked = ranked.unionByName(_ranked_in_strips(many(n), many(span), strip))
    best = ranked.groupBy("doc_id", "node_id").agg(F.max_by("_style", "_rank").alias("_style"))
    return nodes.select("doc_id", "node_id").join(best, ["doc_id", "node_id"], "left").select("doc_id", "node_id", "_style.*")


def _area() -> Column:
    return G.overlap_area(box("n_"), box())


def _touching() -> Column:
    placed = F.col("n_y0").isNotNull() & F.col("n_y1").isNotNull() & F.col("y0").isNotNull() & F.col("y1").isNotNull()
    return placed & F.coalesce(_area() > 0, F.lit(False))


def _same_text() -> Column:
    return (F.col("_text") != "") & (F.col("_text").contains(F.col("_span")) | F.col("_span").contains(F.col("_text")))


def _ranked(pairs: DataFrame) -> DataFrame:
    """Node, rank and style of each pair: those that touch (``_touch``) come before all others."""
    order = [(-F.col("line_no")).alias("o"), (-F.col("node_seq")).alias("s")]
    rank = F.struct("_touch", "_same", F.when(F.col("_touch") & ~F.coalesce("_same", F.lit(False)), _area()).otherwise(0.0).alias("a"), *order)
    return pairs.select("doc_id", "node_id", rank.alias("_rank"), F.struct("font", "size", "bold").alias("_style"))


def _ranked_in_strips(n: DataFrame, span: DataFrame, strip: float) -> DataFrame:
    met = in_strips(n, "n_y0", "n_y1", strip).join(in_strips(span, "y0", "y1", strip), [*PAGE, "_strip"])
    touching = _ranked(met.where(_area() > 0).withColumns({"_touch": F.lit(True), "_same": _same_text()}))
    # Nodes that touch nothing look for their text anywhere on the page.
    best = stage(touching.groupBy("doc_id", "node_id").agg(F.max_by("_style", "_rank").alias("_style"), F.max("_rank").alias("_rank")))
    lost = n.join(best.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti")
    anywhere = lost.join(span.where(F.col("_span") != ""), PAGE).where(_same_text())
    return best.select("doc_id", "node_id", "_rank", "_style").unionByName(_ranked(anywhere.withColumns({"_touch": F.lit(False), "_same": F.lit(True)})))


def split_by_block_and_style(lines: DataFrame) -> DataFrame:
    """Segments of each node's lines: one per source block, or one per line when the block is
    all monospace or its style changes at nearly every line.  Nodes with one segment are left out.

    The lines of a node move once, as a list, and are cut in place.  Nodes of more than one block of ``line_no``
    (few: their keys are found first, from a narrow read) go through the scans, so that no task holds them.

    ``lines``: doc_id, node_id, line_no, block, text, font, size, bold.
    """
    keys = ["doc_id", "node_id"]
    lines = lines.where(F.col("doc_id").isNotNull() & F.col("node_id").isNotNull()).withColumn("text", X.strip(F.col("text")))
    at = Q.block_of("line_no")
    long = stage(lines.groupBy(*keys).agg(F.min(at).alias("_a"), F.max(at).alias("_b")).where(F.col("_a") < F.col("_b")).select(*keys))
    line = F.struct("line_no", "block", "text", "font", "size", "bold")
    packed = lines.join(long, keys, "left_anti").groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("_lines"))
    # The outer form: for the plain one Spark first filters by the size of the array and so cuts twice.
    cut = packed.select(*keys, F.explode_outer(_cut(F.col("_lines"))).alias("_s"))
    segments = cut.where(F.col("_s").isNotNull()).select(*keys, "_s.*")
    if long.isEmpty():
        return segments
    return segments.unionByName(_cut_in_scans(lines.join(long, keys, "left_semi"), keys))


def _signature(line: Column) -> Column:
    return F.struct(line["font"], F.round(line["size"], 2), line["bold"])


def _parts(lines: Column, begins: Callable[[Column, Column], Column]) -> Column:
    """The array cut into arrays, before each element that ``begins(previous, current)``."""
    def cut(ls: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: (i == 0) | begins(F.get(ls, i - 1), F.get(ls, i)))
        return X.bound(at, lambda s: F.transform(s, lambda a, k: F.slice(ls, a + 1, F.coalesce(F.get(s, k + 1), F.size(ls)) - a)))

    return X.bound(lines, cut)


def _cut(lines: Column) -> Column:
    """The segments of a node's lines (in order) as an array; null for one segment only."""
    def mono(x: Column) -> Column:
        return F.lower(x["font"]).contains("courier") | F.lower(x["font"]).contains("mono")

    def apart(run: Column) -> Column:
        all_mono = F.exists(run, lambda x: F.coalesce(mono(x), F.lit(False))) & ~F.exists(run, lambda x: F.coalesce(~mono(x), F.lit(False)))
        changes = F.filter(F.sequence(F.lit(1), F.size(run) - 1), lambda i: _signature(F.get(run, i - 1)) != _signature(F.get(run, i)))
        return F.when(F.size(run) > 1, all_mono | (F.size(changes) >= F.size(run) - 1)).otherwise(False)

    def segment(part: Column) -> Column:
        return F.struct(
            F.get(part, F.lit(0))["line_no"].alias("segment"),
            F.array_join(F.transform(part, lambda x: F.when(x["text"] != "", x["text"])), " ").alias("text"),
            F.array_max(F.transform(part, lambda x: F.struct(F.length(x["text"]), -x["line_no"], x["font"].alias("font"))))["font"].alias("font"),
            F.size(part).cast("long").alias("n_lines"),
        )

    runs = _parts(lines, lambda p, r: ~F.coalesce(p["block"] == r["block"], F.lit(False)))
    split = F.transform(runs, lambda run: F.when(apart(run), _parts(run, lambda p, r: p["line_no"] != r["line_no"])).otherwise(F.array(run)))
    segments = F.transform(F.flatten(split), segment)
    return X.bound(segments, lambda s: F.when(F.size(s) > 1, s))


def _cut_in_scans(lines: DataFrame, keys: list[str]) -> DataFrame:
    lines = stage(lines)
    runs = Q.islands(lines, keys, "line_no", "_run", ["block"], lambda p, r: p["block"] == r["block"])
    # A run is the lines of one source block of one node: its windows and its segments share one shuffle.
    whole = Window.partitionBy(*keys, "_run")
    w = whole.orderBy("line_no")
    signature = F.struct("font", F.round("size", 2).alias("size"), "bold")
    changed = runs.withColumn("_changed", F.when(F.lag(signature).over(w) != signature, 1).otherwise(0))
    mono = F.lower("font").contains("courier") | F.lower("font").contains("mono")
    placed = changed.withColumns(
        {"_n": F.count("*").over(whole), "_mono": F.bool_and(mono).over(whole), "_changes": F.sum("_changed").over(whole)}
    )
    apart = (F.col("_n") > 1) & (F.col("_mono") | (F.col("_changes") >= F.greatest(F.lit(1), F.col("_n") - 1)))
    placed = placed.withColumn("segment", F.when(apart, F.col("line_no")).otherwise(F.col("_run")))
    segments = stage(
        placed.groupBy(*keys, "_run", "segment").agg(
            Q.ordered_join(F.when(F.col("text") != "", F.col("text")), F.col("line_no"), " ").alias("text"),
            F.max_by("font", F.struct(F.length("text").alias("k"), (-F.col("line_no")).alias("o"))).alias("font"),
            F.count("*").alias("n_lines"),
        ).drop("_run")
    )
    many = segments.groupBy(*keys).agg(F.count("*").alias("_s")).where(F.col("_s") > 1).select(*keys)
    return segments.join(many, keys, "left_semi")
