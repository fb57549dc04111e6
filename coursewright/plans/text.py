"""Scalar functions over whole texts, URLs and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursewright.functions import answers as A
from coursewright.functions import geometry as G
from coursewright.functions import text as X
from coursewright.sources.nodes import document_nodes, scan_binary_inventory, scan_text_nodes
from coursewright.sources.sinks import write_files
from coursewright.sources.tables import table
from coursewright.streaming.streams import new_folder


def lines(s, sf):
    return scan_text_nodes(table(s, sf, "documents"))


def numbered(s, sf):
    """Lines with a list or heading marker by position."""
    n = F.col("seq")
    mark = (
        F.when(n % 9 == 0, "[x] ").when(n % 9 == 1, "[ ] ").when(n % 9 == 2, F.concat(n.cast("string"), F.lit(". ")))
        .when(n % 9 == 3, "iv) ").when(n % 9 == 4, "B. ").when(n % 9 == 5, F.concat(F.lit("1."), n.cast("string"), F.lit(" ")))
        .when(n % 9 == 6, "Appendix C ").when(n % 9 == 7, "☐ ").otherwise("")
    )
    return lines(s, sf).withColumn("text", F.concat(mark, F.col("text")))


def blanks(s, sf):
    n = F.col("seq")
    return lines(s, sf).select(
        "doc_id",
        "seq",
        F.when(n % 3 == 0, F.concat(n.cast("string"), F.lit(") "), F.col("text"), F.lit(" (1) ___ and (12)....")))
        .when(n % 3 == 1, F.concat(F.col("text"), F.lit(" (7) __")))
        .otherwise(F.col("text"))
        .alias("text"),
        F.when(n % 4 == 0, "checkbox_selected").when(n % 4 == 1, "checkbox_unselected").otherwise("text").alias("label"),
    )


def text_hints(s, sf):
    h = blanks(s, sf).select("doc_id", "seq", X.text_hints(F.col("text")).alias("h"), X.checkbox_state(F.col("label")).alias("state"))
    return h.select(
        "doc_id", "seq", "state", F.col("h.numbered_item").alias("numbered_item"),
        F.array_join(F.col("h.blank_ids").cast("array<string>"), ",").alias("blank_ids"),
        F.array_join(F.col("h.blank_positions").cast("array<string>"), ",").alias("blank_positions"),
    )


def split_heading(s, sf):
    r = numbered(s, sf).select("doc_id", "seq", X.split_heading_number(F.col("text")).alias("h"))
    return r.select("doc_id", "seq", "h.number", "h.title")


def filenames(s, sf):
    pages = table(s, sf, "pages")
    return pages.select(
        "page_id",
        X.safe_filename(F.regexp_extract("url", "[^/]*$", 0)).alias("safe"),
        X.sample_filename(
            F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" "), F.col("url"), F.lit(".docx "))),
            F.concat("url", F.lit(".pdf")),
            (F.col("page_id") % 7).cast("int"),
            (F.col("page_id") % 5 + F.col("page_id") % 7).cast("int"),
        ).alias("sample"),
    )


def doc_ids(s, sf):
    pages = table(s, sf, "pages").withColumn("digest", X.stable_doc_id(F.col("url")))
    return pages.select(
        "page_id",
        "digest",
        X.uuid_of_hash(F.col("digest")).alias("uuid"),
        X.parse_external_id(
            F.when(F.col("page_id") % 3 == 0, F.col("url")).when(
                F.col("page_id") % 3 == 1, F.concat(F.lit(" "), F.upper("digest"))
            ).otherwise(X.uuid_of_hash(F.col("digest")))
        ).alias("parsed"),
    )


def refs(s, sf):
    """JSON-pointer-like references made of the URL parts."""
    path = F.regexp_replace("url", "^https?:/", "")
    raw = (
        F.when(F.col("page_id") % 5 == 0, path)
        .when(F.col("page_id") % 5 == 1, F.concat(F.lit("#"), path))
        .when(F.col("page_id") % 5 == 2, F.regexp_replace(path, "^/", ""))
        .when(F.col("page_id") % 5 == 3, F.lit("Body"))
    )
    r = table(s, sf, "pages").select("page_id", X.canonical_ref(raw).alias("ref"))
    return r.withColumn("parent", X.parent_ref(F.col("ref")))


def answers(s, sf):
    """Model replies: a JSON block of each conversation turn, some fenced, some broken."""
    c = table(s, sf, "conversations")
    text = F.regexp_replace("text", r'["\\\x00-\x1f{}`]', " ")
    body = F.concat(
        F.lit('{"questions": [{"question": " Why '), text, F.lit(' ", "choices": ["a", "b", "'),
        F.col("role"), F.lit('"], "correct_index": '), (F.col("turn") - 1).cast("string"),
        F.lit('}, {"question": "No?", "choices": ["x"], "correct_index": 0}, {"question": "  ", "choices": ["x", "y"]}], '),
        F.lit('"key_terms": [{"term": " '), F.col("role"), F.lit('", "definition": "'), text,
        F.lit('"}, {"term": "", "definition": "d"}]}'),
    )
    kind = (F.col("conv_id") + F.col("turn")) % 4
    reply = (
        F.when(kind == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone {really}.")))
        .when(kind == 1, F.concat(F.lit("Sure. "), body, F.lit(" Bye.")))
        .when(kind == 2, body)
        .otherwise(F.concat(F.lit("no json "), text))
    )
    return A.parse_answers(
        c.select(F.concat_ws("/", "conv_id", "turn").alias("reply_id"), reply.alias("reply")), "reply"
    )


def bboxes(s, sf):
    li = table(s, sf, "lineitem")
    k = [F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")]
    boxed = li.select(
        *["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
        G.normalise_bbox(
            (k[0] % 600).cast("double"), (k[1] % 800).cast("double"), (k[2] * 7 % 600).cast("double"),
            (k[0] * 3 % 800).cast("double"),
            F.when(F.col("l_linenumber") % 2 == 0, "CoordOrigin.BOTTOMLEFT").otherwise("TOP_LEFT"),
            F.lit(600.0), F.lit(800.0),
        ).alias("b"),
    )
    own = (F.col("b.left"), F.col("b.top"), F.col("b.right"), F.col("b.bottom"))
    page = (F.lit(0.25), F.lit(0.25), F.lit(0.75), F.lit(0.75))
    return boxed.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "b.top", "b.left", "b.bottom", "b.right",
        F.round(G.overlap_ratio(own, page), 9).alias("ratio"),
    )


def inventory(s, sf):
    """The pages stored as files whose names tell their attributes, some of them malformed, and scanned."""
    name = F.concat(
        F.sha2("url", 256).substr(1, 12), F.lit("__name=doc"), F.col("page_id").cast("string"),
        F.when(F.col("page_id") % 4 == 1, "").otherwise("__sha=abc"),
        F.when(F.col("page_id") % 3 == 0, "__mode=path").when(F.col("page_id") % 3 == 1, "__mode=ftp").otherwise("__junk"),
        F.when(F.col("page_id") % 7 == 0, ".txt").otherwise(".pdf"),
    )
    folder = f"{new_folder(s, 'store')}/files"
    write_files(table(s, sf, "pages").select(name.alias("name"), F.encode("html", "UTF-8").alias("content")), folder)
    recent = F.col("modificationTime") > F.current_timestamp() - F.expr("INTERVAL 1 DAY")
    return scan_binary_inventory(s, folder).select(
        "doc_id", "filename", "sha256", "source_mode", "length", recent.alias("recent"), F.element_at(F.split("path", "/"), -1).alias("stored_as")
    )


QUERIES = {
    "fold_text": lambda s, sf: lines(s, sf).select("doc_id", "seq", X.fold_text(F.col("text")).alias("folded")),
    "word_count": lambda s, sf: lines(s, sf).select("doc_id", "seq", X.word_count(F.col("text")).alias("words")),
    "shorten": lambda s, sf: lines(s, sf).select("doc_id", "seq", X.shorten(F.col("text"), 120).alias("short")),
    "summary_word_count": lambda s, sf: table(s, sf, "documents").select(
        "doc_id", X.word_count(F.col("text")).alias("words")
    ),
    "classify_heading": lambda s, sf: document_nodes(s, sf).where(F.col("node_type") == "heading").select(
        "node_id",
        X.classify_heading(
            F.when(F.col("seq") % 4 == 1, F.concat(F.lit("Chapter. "), F.col("text")))
            .when(F.col("seq") % 4 == 2, F.concat(F.lit(" LAB: "), F.col("text")))
            .otherwise(F.col("text")),
            F.col("level"),
        ).alias("kind"),
    ),
    "split_heading_number": split_heading,
    "infer_list_style": lambda s, sf: numbered(s, sf).select(
        "doc_id", "seq",
        X.infer_list_style(F.col("text"), F.when(F.col("seq") % 11 == 0, "Checkbox_item").otherwise("list")).alias("style"),
        X.list_checked(F.col("text")).alias("checked"),
    ),
    "text_hints": text_hints,
    "url_to_slug": lambda s, sf: table(s, sf, "pages").select("page_id", X.url_to_slug(F.col("url")).alias("slug")),
    "safe_filename": filenames,
    "stable_doc_id": doc_ids,
    "canonical_ref": refs,
    "scan_binary_inventory": inventory,
    "validate_questions": lambda s, sf: A.validate_questions(answers(s, sf), "reply_id"),
    "extract_key_terms": lambda s, sf: A.key_terms(answers(s, sf), "reply_id"),
    "key_term_cards": lambda s, sf: A.key_term_cards(A.key_terms(answers(s, sf), "reply_id"), "reply_id"),
    "normalise_bbox": bboxes,
}
