"""Rebuilding document structure: headings, captions, paragraphs, lists, sections, pages, order."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursewright.functions.text import WS, strip
from coursewright.operators import sequence as Q
from coursewright.session import stage

Pass = Callable[[DataFrame], DataFrame]
KEYS = ["doc_id"]

# Node types without content, and the caption pattern.
NON_CONTENT = ("page_break", "page_header", "page_footer", "table_of_contents", "metadata_block")
CAPTION = r"(?i)^(?:Figure|Fig\.?|Table|Equation|Eq\.?)\s*\d+"


def compose_passes(passes: Sequence[Pass]) -> Pass:
    """Passes in order, each on the staged table of the one before.

    A pass reads its input twice (rows, then block totals); staging keeps a chain of
    passes linear instead of doubling per pass.
    """
    return lambda df: reduce(lambda d, p: stage(d).transform(p), passes, df)


def drop_non_content(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.col("node_type").isin(*NON_CONTENT))


def repair_heading_levels(nodes: DataFrame, block_rows: int | None = None) -> DataFrame:
    """First heading to 1, none deeper than the one before plus one.

    With i the ordinal of a heading, the repaired level is i + min(0, min over it and
    earlier headings of (level - i)).  Blocks count and take minima on their own; a
    block's carry shifts both, so the headings are scanned once.  Other nodes do not move.
    """
    is_heading = F.coalesce(F.col("node_type") == "heading", F.lit(False))
    upto = Window.partitionBy("doc_id", "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    local = (
        nodes.where(is_heading)
        .withColumn("_block", Q.block_of("seq", block_rows))
        .withColumn("_i", F.sum(F.lit(1)).over(upto))
        .withColumn("_slack", F.col("level") - F.col("_i"))
        .withColumn("_low", F.min("_slack").over(upto))
    )
    totals = local.groupBy("doc_id", "_block").agg(F.max("_i").alias("_n"), F.min("_slack").alias("_least"))
    before = Window.partitionBy("doc_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counted = totals.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    carries = counted.select(
        "doc_id", "_block", "_shift", F.min(F.col("_least") - F.col("_shift")).over(before).alias("_carry")
    )
    joined = local.join(carries, ["doc_id", "_block"], "left")
    lowest = F.least(F.col("_low") - F.col("_shift"), F.col("_carry"))
    repaired = F.least(F.col("_i") + F.col("_shift") + F.least(F.lit(0), lowest), F.lit(4)).cast("int")
    headings = joined.select(*[repaired.alias("level") if c == "level" else F.col(c) for c in nodes.columns])
    return headings.unionByName(nodes.where(~is_heading))


def attach_captions(nodes: DataFrame) -> DataFrame:
    """Caption paragraphs straight after a figure or equation become its caption (the last wins)."""
    like = F.coalesce((F.col("node_type") == "paragraph") & F.col("text").rlike(CAPTION), F.lit(False))
    owns = F.coalesce(F.col("node_type").isin("figure", "equation"), F.lit(False))
    # The scan takes the texts of possible captions only; of the nodes these and the owners meet its outcome.
    narrow = nodes.select("doc_id", "node_id", "seq", "node_type", like.alias("_like"), F.when(like, F.col("text")).alias("text"))
    owner = F.when(~F.col("_like"), F.struct("node_id", "node_type"))
    seen = Q.scan(narrow, KEYS, "seq", {"_owner": ("last", owner, False)})
    taken = stage(
        seen.where(F.col("_like") & F.col("_owner.node_type").isin("figure", "equation")).select(
            "doc_id", "node_id", "seq", "text", F.col("_owner.node_id").alias("_of")
        )
    )
    captions = taken.groupBy("doc_id", F.col("_of").alias("node_id")).agg(F.max_by("text", "seq").alias("caption"))
    gone = taken.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "node_id", "seq")]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("doc_id", "node_id", "seq")])
    kept = nodes.where(like).join(gone, same, "left_anti").unionByName(nodes.where(~like & ~owns))
    owners = nodes.where(owns).join(captions, ["doc_id", "node_id"], "left")
    placed = kept.withColumn("caption", F.lit(None).cast("string")).unionByName(owners)
    return placed.select("doc_id", "node_id", *[c for c in nodes.columns if c not in ("doc_id", "node_id")], "caption")


def merge_paragraphs(nodes: DataFrame) -> DataFrame:
    """Runs of unpreserved paragraphs joined by a space; everything else breaks the run."""
    breaks = (F.col("node_type") != "paragraph") | F.col("boundary_preserved")
    alone = nodes.where(breaks).withColumn("n_merged", F.lit(1))
    # Of the nodes that break a run the scan takes what tells so; they go on as they are.
    light = nodes.withColumn("text", F.when(~breaks, F.col("text")))
    runs = Q.scan(light, KEYS, "seq", {"_run": ("sum", F.when(breaks, 1).otherwise(0).cast("long"), True)})
    rest = [c for c in nodes.columns if c not in ("doc_id", "text")]
    pieces = F.array_sort(F.collect_list(F.struct("seq", "text")))
    grouped = runs.where(~breaks).groupBy("doc_id", "_run").agg(
        F.min_by(F.struct(*rest), "seq").alias("_head"), pieces.alias("_pieces")
    )
    texts = F.transform("_pieces", lambda p: p["text"])
    blank = lambda t: t.rlike(f"^{WS}*$")
    later = F.filter(F.slice(texts, F.lit(2), F.greatest(F.size(texts) - 1, F.lit(0))), lambda t: ~blank(t))
    trimmed = F.transform(later, lambda t: F.regexp_replace(t, f"{WS}+$", ""))
    # The first text keeps its trailing space only when the second one is not blank.
    first = F.when(blank(F.get(texts, F.lit(1))), F.regexp_replace(F.get(texts, F.lit(0)), f"{WS}+$", "")).otherwise(
        F.get(texts, F.lit(0))
    )
    joined = strip(F.array_join(F.concat(F.array(first), trimmed), " "))
    merged = grouped.select(
        "doc_id",
        F.when(F.size(texts) == 1, F.get(texts, F.lit(0))).otherwise(joined).alias("text"),
        "_head.*",
        F.size(texts).alias("n_merged"),
    )
    return alone.unionByName(merged)


def merge_lists(nodes: DataFrame) -> DataFrame:
    """Consecutive lists of one style merge, unless one is the other's parent."""
    def continues(prev: Column, row: Column) -> Column:
        nested = F.coalesce(row["parent_id"] == prev["node_id"], F.lit(False)) | F.coalesce(
            prev["parent_id"] == row["node_id"], F.lit(False)
        )
        both = (prev["node_type"] == "list") & (row["node_type"] == "list")
        return both & (prev["list_style"] == row["list_style"]) & ~nested

    is_list = F.col("node_type") == "list"
    light = nodes.withColumn("text", F.when(is_list, F.col("text")))
    runs = Q.islands(light, KEYS, "seq", "_run", ["node_type", "list_style", "node_id", "parent_id"], continues)
    rest = [c for c in nodes.columns if c not in ("doc_id", "text")]
    merged = runs.where(is_list).groupBy("doc_id", "_run").agg(
        F.min_by(F.struct(*rest), "seq").alias("_head"),
        Q.ordered_join(F.col("text"), F.col("seq"), "\n").alias("text"),
        F.count("*").cast("int").alias("n_items"),
    )
    others = nodes.where(~is_list).withColumn("n_items", F.lit(0))
    return others.unionByName(merged.select("doc_id", "text", "_head.*", "n_items"))


def normalise_tables(tables: DataFrame) -> DataFrame:
    """Empty rows get one empty cell; the first of several rows is a header; counts and headers filled.

    Input ``table_rows`` array<array<string>> and ``headers`` array<string> (may be empty).
    """
    rows = F.transform("table_rows", lambda r: F.when(F.size(r) == 0, F.array(F.lit(""))).otherwise(r))
    headers = F.when(F.size("headers") > 0, F.col("headers")).otherwise(
        F.coalesce(F.get(rows, F.lit(0)), F.array().cast("array<string>"))
    )
    return tables.select(
        *[c for c in tables.columns if c not in ("table_rows", "headers")],
        rows.alias("table_rows"),
        headers.alias("headers"),
        F.size("table_rows").alias("row_count"),
        F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0)).alias("column_count"),
        (F.size("table_rows") > 1).alias("first_is_header"),
    )


def assign_sections(nodes: DataFrame, levels: int = 6) -> DataFrame:
    """Parent of each parentless node: the nearest open heading (for a heading, of smaller level).

    Headings have ``levels`` levels, six as in HTML; a deeper one fails the query.
    """
    heading = F.col("node_type") == "heading"
    too_deep = F.raise_error(F.lit(f"a heading is deeper than level {levels}")).cast("int")
    nodes = nodes.withColumn("level", F.when(heading & (F.col("level") > levels), too_deep).otherwise(F.col("level")))
    specs: dict[str, Q.ScanSpec] = {
        f"_h{k}": ("last", F.when(heading & (F.col("level") == k), F.struct("seq", "node_id")), False)
        for k in range(1, levels + 1)
    }
    seen = Q.scan(nodes, KEYS, "seq", specs)
    open_at = []
    for k in range(1, levels + 1):
        mine = F.col(f"_h{k}")
        shut = reduce(
            lambda a, b: a | b,
            [F.coalesce(F.col(f"_h{j}.seq") > F.col(f"_h{k}.seq"), F.lit(False)) for j in range(1, k)],
            F.lit(False),
        )
        usable = mine.isNotNull() & ~shut & (~heading | (F.col("level") > k))
        open_at.append(F.when(usable, mine))
    nearest = F.greatest(*open_at)
    parent = F.coalesce(F.col("parent_id"), nearest["node_id"])
    return seen.withColumn("parent_id", parent).drop(*specs)


def group_pages(nodes: DataFrame) -> DataFrame:
    """A container per page above 0; nodes without a parent go under their page's container."""
    page_id = F.concat(F.col("doc_id").cast("string"), F.lit("/page/"), F.col("page").cast("string"))
    containers = nodes.where(F.col("page") > 0).select("doc_id", "page").distinct()
    made = containers.select(
        "doc_id", page_id.alias("node_id"), F.lit(None).cast("string").alias("parent_id"), "page", F.lit("page").alias("node_type")
    )
    placed = nodes.select(
        "doc_id",
        "node_id",
        F.when(F.col("page") > 0, F.coalesce("parent_id", page_id)).otherwise(F.col("parent_id")).alias("parent_id"),
        "page",
        "node_type",
    )
    return made.unionByName(placed)


def _position(nodes: DataFrame, keys: Sequence[str], page: str, order: Sequence[Column]) -> DataFrame:
    """Position over (page, order) per key: rank inside a page plus the sizes of earlier pages."""
    inside = Window.partitionBy(*keys, page).orderBy(*order)
    ranked = nodes.withColumn("_rank", F.row_number().over(inside) - 1)
    sizes = nodes.groupBy(*keys, page).agg(F.count("*").alias("_n"))
    offsets = Q.scan(sizes, keys, page, {"_before": ("sum", F.col("_n"), False)}).drop("_n")
    return ranked.join(offsets, [*keys, page]).withColumn("position", F.col("_rank") + F.col("_before")).drop("_rank", "_before")


def reading_order(nodes: DataFrame, use_columns: bool = False) -> DataFrame:
    """Stable order by page, y, x, seq (optionally column first) as a new ``position``."""
    keys = [F.col("column_no")] if use_columns else []
    return _position(nodes, KEYS, "page", [*keys, F.col("y"), F.col("x"), F.col("seq")])


def assign_columns(nodes: DataFrame, gap: float = 0.05) -> DataFrame:
    """Column 0 or 1 from real horizontal gaps between the boxes of a page."""
    page = Window.partitionBy("doc_id", "page")
    before = page.orderBy("x", "y", "seq").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.col("x") + F.col("w")).over(before)
    flagged = nodes.withColumn("_gap", F.when(F.col("x") - reach > gap, 1).otherwise(0))
    upto = page.orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return flagged.withColumn("column_no", F.least(F.sum("_gap").over(upto), F.lit(1)).cast("int")).drop("_gap")


def spatial_order(nodes: DataFrame) -> DataFrame:
    """Children of a parent by page, column, top, left; tables by page, top, column, left."""
    table = F.upper("node_type").isin("TABLE", "TABLE_ROW", "TABLE_CELL")
    column, top = F.col("column_no").cast("double"), F.col("y")
    order = [F.when(table, top).otherwise(column), F.when(table, column).otherwise(top), F.col("x"), F.col("seq")]
    staged = nodes.withColumn("_parent", F.coalesce("parent_id", F.lit("")))
    return _position(staged, ["doc_id", "_parent"], "page", order).drop("_parent")


def propagate_bounds(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """Each node's box and page grown over everything below it."""
    boxes = nodes.select(
        "doc_id", F.col("node_id").alias("node"), "page", "x", "y", (F.col("x") + F.col("w")).alias("r"), (F.col("y") + F.col("h")).alias("b")
    )
    return (
        tree.join(boxes, ["doc_id", "node"])
        .groupBy("doc_id", F.col("ancestor").alias("node_id"))
        .agg(
            F.min(F.when(F.col("page") > 0, F.col("page"))).alias("page"),
            F.min("x").alias("left"),
            F.min("y").alias("top"),
            F.max("r").alias("right"),
            F.max("b").alias("bottom"),
        )
    )


def fold_list_items(nodes: DataFrame) -> DataFrame:
    """Single-item lists under a list fold into it; the group takes the first item's style.

    Children of a folded item move to the group.
    """
    lists = nodes.where(F.col("node_type") == "list")
    groups = lists.select("doc_id", F.col("node_id").alias("parent_id"))
    folded = (
        lists.where(F.col("n_items") == 1)
        .join(groups, ["doc_id", "parent_id"], "left_semi")
        .select("doc_id", "node_id", F.col("parent_id").alias("group_id"), "seq", "text", "list_style")
    )
    items = folded.groupBy("doc_id", F.col("group_id").alias("node_id")).agg(
        F.min_by("list_style", "seq").alias("_style"),
        Q.ordered_join(F.col("text"), F.col("seq"), "\n").alias("_items"),
        F.count("*").cast("int").alias("_n"),
    )
    moved = folded.select("doc_id", F.col("node_id").alias("parent_id"), F.col("group_id").alias("_new_parent"))
    kept = nodes.join(folded.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti")
    return (
        kept.join(items, ["doc_id", "node_id"], "left")
        .join(moved, ["doc_id", "parent_id"], "left")
        .select(
            "doc_id",
            "node_id",
            F.coalesce("_new_parent", "parent_id").alias("parent_id"),
            "node_type",
            "seq",
            F.coalesce(F.when(F.col("n_items") == 0, F.col("_style")), "list_style").alias("list_style"),
            F.coalesce("_items", "text").alias("text"),
            F.coalesce("_n", F.col("n_items")).alias("n_items"),
        )
    )


def cells_to_rows(cells: DataFrame) -> DataFrame:
    """Table cells as rows ordered by column, with the table's shape.

    Input (table_id, row_index, col_index, text, is_header).
    """
    # Cells move once, as they are: lists of them made before the shuffle are wider and spill in every task.
    met = cells.repartition("table_id", "row_index")
    rows = stage(
        met.groupBy("table_id", "row_index").agg(
            Q.ordered_join(F.col("text"), F.col("col_index"), " | ").alias("cells"),
            F.bool_or("is_header").alias("is_header"),
            F.max("col_index").alias("_last"),
        )
    )
    shape = rows.groupBy("table_id").agg(
        F.count("*").alias("row_count"),
        (F.max("_last") + 1).alias("column_count"),
        F.coalesce(F.min_by("cells", F.when(F.col("is_header"), F.col("row_index"))), F.min_by("cells", "row_index")).alias("headers"),
    )
    return rows.drop("_last").join(shape, "table_id")


def synthesise_containers(refs: DataFrame, body: str = "#/body") -> DataFrame:
    """Missing ancestors of every ``#/a/b/c`` reference, with their label and parent."""
    parts = F.filter(F.split(F.substring("ref", 3, 1 << 30), "/"), lambda p: p != "")
    usable = refs.where(F.col("ref").startswith("#/") & (F.col("ref") != body)).select("doc_id", parts.alias("parts"))
    above = usable.where(F.size("parts") > 1).select(
        "doc_id",
        "parts",
        F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("n"),
    )
    prefix = lambda n: F.concat(F.lit("#/"), F.array_join(F.slice("parts", F.lit(1), n), "/"))
    made = above.select(
        "doc_id",
        prefix(F.col("n")).alias("ref"),
        F.when(F.col("n") > 1, prefix(F.greatest(F.col("n") - 1, F.lit(1)))).otherwise(F.lit(body)).alias("parent_ref"),
        F.concat(F.lit("AI-"), F.upper(F.rtrim(F.get("parts", F.lit(0)), F.lit("s")))).alias("label"),
    ).distinct()
    return made.join(refs.select("doc_id", "ref").distinct(), ["doc_id", "ref"], "left_anti")


def hydrate_images(nodes: DataFrame, images: DataFrame) -> DataFrame:
    """Figure nodes with their stored image; the bytes stay out of the node table."""
    return nodes.where(F.col("node_type") == "figure").join(images, ["doc_id", "node_id"], "left")


def node_plain_text(node_type: Column, text: Column, caption: Column) -> Column:
    """One text per node: a figure's alternative text, else its caption."""
    return (
        F.when(node_type == "figure", F.coalesce(F.when(text != "", text), caption, F.lit("")))
        .when(node_type.isin(*NON_CONTENT), "")
        .otherwise(F.coalesce(text, F.lit("")))
    )


def project_content_nodes(nodes: DataFrame) -> DataFrame:
    """Presentation projection; types without one and blank paragraphs are left out."""
    kind = (
        F.when(F.col("node_type") == "question", None)
        .when(F.col("node_type").isin(*NON_CONTENT), None)
        .otherwise(F.col("node_type"))
    )
    staged = nodes.withColumn("kind", kind).where(F.col("kind").isNotNull())
    kept = staged.where((F.col("kind") != "paragraph") | (strip(F.col("text")) != ""))
    return kept.select(
        "doc_id",
        "node_id",
        "kind",
        F.when(F.col("kind") == "heading", F.col("level")).alias("level"),
        F.when(F.col("kind") == "list", F.col("list_style")).alias("style"),
        F.when(F.col("kind") == "equation", F.col("text")).alias("latex"),
        F.when(F.col("kind").isin("heading", "paragraph", "list", "code"), F.col("text")).alias("body"),
    )


def page_contexts(nodes: DataFrame) -> DataFrame:
    """Per page: its texts joined by newlines and its first heading."""
    text = node_plain_text(F.col("node_type"), F.col("text"), F.lit(None).cast("string"))
    return nodes.groupBy("doc_id", "page").agg(
        Q.ordered_join(F.when(text != "", text), F.col("seq"), "\n").alias("page_text"),
        F.min_by("text", F.when(F.col("node_type") == "heading", F.col("seq"))).alias("heading"),
        F.count("*").alias("n_nodes"),
    )
