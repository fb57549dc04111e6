"""Content nodes from plain text, HTML and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coursewright.sources.html import block_batches
from coursewright.sources.tables import table


def scan_text_nodes(documents: DataFrame) -> DataFrame:
    """One row per line of ``text``: (doc_id, seq, text)."""
    # The outer form: for the plain one Spark first filters by the size of the array and so splits twice.
    lines = documents.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("seq", "text"))
    return lines.where(F.col("seq").isNotNull())


def _node_type(n: Column, size: Column) -> Column:
    return (
        F.when((n == 0) | (size < 40), "heading")
        .when(n % 11 == 5, "figure")
        .when(n % 13 == 7, "equation")
        .when(n % 7 == 3, "list")
        .when(n % 17 == 8, "question")
        .when(n % 19 == 6, "page_header")
        .when(n % 23 == 9, "code")
        .otherwise("paragraph")
    )


def document_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Typed nodes of every line of every document.

    The corpus is plain prose, so types, levels, boxes and teaching prefixes are
    assigned by line number; every line of every document is kept.
    """
    lines = F.split("text", "\n")
    # The lines and, one place later, their lengths side by side: no line looks into the whole again.
    lengths = F.concat(F.array(F.lit(None).cast("int")), F.transform(lines, F.length))
    pairs = F.arrays_zip(lines.alias("line"), F.slice(lengths, F.lit(1), F.size(lines)).alias("prev_len"))
    staged = table(spark, sf, "documents").select("doc_id", F.posexplode_outer(pairs).alias("n", "e")).where(F.col("n").isNotNull())
    n, line = F.col("n"), F.col("e.line")
    size, prev = F.length(line), F.col("e.prev_len")
    n_text = n.cast("string")
    slot = (F.col("doc_id") + n) % 19
    after_figure = (_node_type(n - 1, prev) == "figure") & (n > 0)
    prefix = (
        F.when((_node_type(n, size) == "paragraph") & after_figure, F.concat(F.lit("Figure "), n_text, F.lit(" ")))
        .when((_node_type(n, size) == "heading") & (slot == 9), F.concat(F.lit("Chapter "), n_text, F.lit(". ")))
        .when((_node_type(n, size) == "heading") & (slot == 10), F.concat(F.lit("Section "), n_text, F.lit(": ")))
        .when(slot == 0, "Definition: ")
        .when(slot == 1, "Example: ")
        .when(slot == 2, "Note: ")
        .when(slot == 3, F.concat(F.lit("See Figure "), n_text, F.lit(". ")))
        .when(slot == 4, "Summary: ")
        .when(slot == 5, "Step 1: ")
        .when(slot == 6, "Rule: ")
        .when(slot == 7, "Objective: ")
        .when(slot == 8, F.concat(F.lit("Exercise "), n_text, F.lit(": ")))
        .otherwise("")
    )
    return staged.select(
        "doc_id",
        F.concat_ws("/", F.col("doc_id"), n).alias("node_id"),
        n.alias("seq"),
        F.expr("n div 8 + 1").cast("int").alias("page"),
        _node_type(n, size).alias("node_type"),
        F.when(n == 0, 1).when(size < 40, 2 + n % 3).otherwise(0).alias("level"),
        F.concat(prefix, line).alias("text"),
        F.when(n % 2 == 0, "bullet").otherwise("numbered").alias("list_style"),
        (n % 5 == 0).alias("boundary_preserved"),
        ((n * 37 % 100) / 100.0).alias("x"),
        ((n % 8) / 8.0).alias("y"),
        (0.10 + (n * 13 % 40) / 100.0).alias("w"),
        F.lit(0.10).alias("h"),
    )


def scan_html_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of each page in order: (page_id, seq, node_type, level, text, alt).

    Every visible character is in one block.  Text between two block tags is a block, of the
    kind of the nearest open element that has one: headings with their level, list items and
    definitions, table cells, code, figures; any other text is a paragraph.  A figure is one
    node, with its caption and other text, and the alternative texts of its images as ``alt``; an
    image elsewhere is a figure node after its block.  Head, scripts, styles, templates, navigation
    and footers are not content.  Tags may hold ``>`` in quotes, end tags may be missing; a ``<`` that
    starts no tag is text.  Entities are decoded, blanks folded, but for the lines of code.

    A page is read in one pass by the task that holds it; a null page has no blocks.
    """
    key = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {key}, seq int, node_type string, level int, text string, alt string"
    return pages.select("page_id", "html").mapInArrow(block_batches, schema)


def scan_document_registry(lines: DataFrame, tracked: DataFrame) -> DataFrame:
    """New, safe, non-blank registry paths not yet tracked by ``source``."""
    path = F.trim("value")
    unsafe = path.rlike(r"^(?:/|~|[A-Za-z]:)") | path.rlike(r"(?:^|[/\\])\.\.(?:[/\\]|$)") | path.contains("\u0000")
    return (
        lines.select(path.alias("source"))
        .where((F.col("source") != "") & ~unsafe.isNull() & ~unsafe)
        .distinct()
        .join(tracked.select("source").distinct(), "source", "left_anti")
    )


def parse_inventory_name(path: Column) -> Column:
    """``id__name=..__sha=..__mode=...pdf`` as struct(doc_id, filename, sha, mode); null when malformed.

    Parts without ``=`` are skipped; a later key wins; the mode must be a known one.
    """
    base = F.element_at(F.split(path, "/"), -1)
    parts = F.split(F.regexp_replace(base, r"\.pdf$", ""), "__")
    pairs = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.contains("="))

    def value(key: str, default: str) -> Column:
        hits = F.filter(pairs, lambda p: p.startswith(f"{key}="))
        return F.coalesce(F.substring(F.get(hits, F.size(hits) - 1), len(key) + 2, 1 << 30), F.lit(default))

    mode = value("mode", "base64")
    good = base.endswith(".pdf") & (F.size(parts) >= 4) & mode.isin("path", "base64")
    return F.when(
        good,
        F.struct(
            F.get(parts, 0).alias("doc_id"),
            F.concat(value("name", "document"), F.lit(".pdf")).alias("filename"),
            value("sha", "").alias("sha256"),
            mode.alias("source_mode"),
        ),
    )


def scan_binary_inventory(spark: SparkSession, directory: str) -> DataFrame:
    """Stored files with size, time and the attributes parsed from their names.

    Only metadata columns are selected, so file contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    return (
        files.select("path", "length", "modificationTime")
        .withColumn("entry", parse_inventory_name(F.col("path")))
        .where(F.col("entry").isNotNull())
        .select("path", "length", "modificationTime", "entry.*")
    )
