"""Scalar text functions: built-in column expressions only.

Patterns follow the Unicode meaning of ``\\s`` and word boundaries: Java's ``\\s`` is
ASCII, so ``WS`` spells the class out, and ``WORD_START`` is a lookbehind on letters,
digits and underscore.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Unicode treats as white space.
WS = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# The same characters, for functions that take them one by one.
WS_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
WORD_START = r"(?<![\p{L}\p{N}_])"
WORD_END = r"(?![\p{L}\p{N}_])"

# Heading keywords.
CHAPTER_WORDS = ("chapter", "unit", "module", "part")
LESSON_WORDS = ("lesson", "section", "topic", "lab")


def strip(value: Column) -> Column:
    return F.trim(value, F.lit(WS_CHARS))


def collapse(value: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(value, f"{WS}+", " "))


def fold_text(value: Column) -> Column:
    return F.lower(collapse(value))


def tokens(value: Column) -> Column:
    return F.filter(F.split(value, f"{WS}+"), lambda t: t != "")


def word_count(value: Column) -> Column:
    return F.size(tokens(value))


def shorten(value: Column, width: int, mark: str = "…") -> Column:
    """Cut at a word (or letter-hyphen-letter) boundary so the result fits ``width``."""
    text = collapse(value)
    room = width - len(mark)
    hyphen = r"(?<=[\p{L}_]{2}-)(?=[\p{L}_]-?[\p{L}_])"
    kept = F.regexp_extract(text, f"^(.{{1,{room}}})(?: |{hyphen})", 1)
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.rtrim(kept), F.lit(mark)))


def text_preview(value: Column, size: int = 280) -> Column:
    return F.substring(value, 1, size)


def first_word(value: Column) -> Column:
    """Lower-case first word without trailing dots and colons."""
    return F.rtrim(F.lower(F.regexp_extract(value, f"^{WS}*([^ \\t\\r\\n]+)", 1)), F.lit(".:"))


def classify_heading(text: Column, level: Column) -> Column:
    """``chapter``, ``lesson`` or ``topic``: first word first, then level."""
    word = first_word(text)
    return (
        F.when(word.isin(*CHAPTER_WORDS), "chapter")
        .when(word.isin(*LESSON_WORDS), "lesson")
        .when(level <= 1, "chapter")
        .when(level <= 2, "lesson")
        .otherwise("topic")
    )


def split_heading_number(text: Column) -> Column:
    """struct(number, title) of ``1.2 Title``, ``A. Title`` or ``Appendix A Title``."""
    # Fixed value: the heading number pattern.
    pattern = r"(?d)^((?:\d+\.)*+\d+|[A-Z]\.|Appendix\s+[A-Z])\s+(.*)$"
    number = F.regexp_extract(text, pattern, 1)
    return F.struct(
        number.alias("number"),
        F.when(number != "", F.regexp_extract(text, pattern, 2)).otherwise(text).alias("title"),
    )


def infer_list_style(text: Column, label: Column) -> Column:
    # List marker patterns.
    return (
        F.when(F.lower(label).contains("checkbox"), "checkbox")
        .when(text.rlike(r"^\s*(?:\[[xX ]\]|☐|☑|✓)\s+"), "checkbox")
        .when(text.rlike(r"^\s*\d+[.)]\s+"), "numbered")
        .when(text.rlike(r"^\s*[IVXLCDMivxlcdm]{2,}[.)]\s+"), "roman")
        .when(text.rlike(r"^\s*[A-Za-z][.)]\s+"), "alpha")
        .otherwise("bullet")
    )


def list_checked(text: Column) -> Column:
    # Checked and unchecked marks.
    return F.when(text.rlike(r"^\s*(?:\[[xX]\]|☑|✓)\s+"), True).when(text.rlike(r"^\s*(?:\[\s*\]|☐)\s+"), False)


def count_mentions(text: Column, term: Column) -> Column:
    """Whole-word, case-folded count of ``term`` in ``text``."""
    quoted = F.regexp_replace(F.lower(term), r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    return F.regexp_count(F.lower(text), F.concat(F.lit(WORD_START), quoted, F.lit(WORD_END)))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_hints(text: Column) -> Column:
    """struct(numbered_item, blank_ids, blank_positions) of an item's text."""
    trimmed = strip(text)
    # Numbered-item and fill-in-blank patterns.
    blank = r"\((\d+)\)\s*(?:_{2,}|\.+|$)"
    number = F.regexp_extract(trimmed, r"^\s*(\d+)[.)]\s+", 1)
    ids = F.transform(F.regexp_extract_all(trimmed, F.lit(blank), F.lit(1)), lambda v: v.cast("int"))
    pieces = F.split(F.regexp_replace(trimmed, blank, "\u0001$0\u0002"), "\u0002")
    # Lengths of the pieces before the k-th marker and of its own text, less the markers added so far.
    measured = F.transform(
        pieces, lambda p: F.struct(F.length(p).alias("whole"), F.length(F.substring_index(p, "\u0001", 1)).alias("before"))
    )
    starts = bound(
        F.slice(measured, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda m: F.transform(
            m, lambda x, i: F.aggregate(F.slice(m, F.lit(1), i), F.lit(0), lambda total, p: total + p["whole"]) + x["before"] - i
        ),
    )
    return F.struct(
        F.when(number != "", number.cast("int")).alias("numbered_item"),
        ids.alias("blank_ids"),
        F.when(F.size(ids) >= 2, starts).otherwise(F.array().cast("array<int>")).alias("blank_positions"),
    )


def checkbox_state(label: Column) -> Column:
    return F.when(label.startswith("checkbox_"), F.regexp_replace(label, "^checkbox_", ""))


def url_to_slug(url: Column) -> Column:
    raw = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"[?#].*$", "")
    slug = F.trim(F.regexp_replace(raw, r"[^a-zA-Z0-9]+", "_"), F.lit("_"))
    cut = F.when(F.length(slug) > 100, F.rtrim(F.substring(slug, 1, 100), F.lit("_"))).otherwise(slug)
    return F.when(cut != "", F.concat(cut, F.lit(".pdf"))).otherwise("document.pdf")


def safe_filename(name: Column) -> Column:
    """Last path part with unsafe characters replaced."""
    base = F.element_at(F.split(F.regexp_replace(name, r"/+$", ""), "/"), -1)
    safe = F.regexp_replace(base, r"[^a-zA-Z0-9._-]", "_")
    return F.when(safe != "", safe).otherwise("unnamed")


def sample_filename(name: Column, fallback: Column, first: Column, last: Column) -> Column:
    stem = lambda v: F.regexp_replace(v, r"(?<=.)\.[^.]+$", "")
    given = F.concat(stem(safe_filename(F.trim(name))), F.lit(".pdf"))
    pages = F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first, last))
    sampled = F.concat(stem(safe_filename(fallback)), F.lit(".sample-p"), pages, F.lit(".pdf"))
    return F.when(F.coalesce(F.trim(name), F.lit("")) != "", given).otherwise(sampled)


def stable_doc_id(path: Column) -> Column:
    return F.sha2(path, 256)


def uuid_of_hash(digest: Column) -> Column:
    """The first 32 hex digits in 8-4-4-4-12 form."""
    return F.regexp_replace(
        F.substring(digest, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )


def parse_external_id(value: Column) -> Column:
    """A UUID or a SHA-256 digest as a UUID; null for anything else."""
    bare = F.lower(F.trim(value))
    hexes = F.replace(bare, F.lit("-"), F.lit(""))
    return F.when(hexes.rlike("^[0-9a-f]{32}$") | hexes.rlike("^[0-9a-f]{64}$"), uuid_of_hash(hexes))


def target_key(prefix: str, ids: Column) -> Column:
    """SHA-256 over the numerically sorted, distinct ids."""
    ordered = F.array_sort(F.array_distinct(ids))
    joined = F.array_join(F.transform(ordered, lambda v: v.cast("string")), ",")
    return F.sha2(F.concat(F.lit(prefix), joined), 256)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def canonical_ref(ref: Column, body: str = "#/body") -> Column:
    clean = F.trim(ref)
    return (
        F.when(clean.isNull() | (clean == "") | (clean == "#") | (F.lower(clean) == "body"), F.lit(body))
        .when(clean.startswith("/"), F.concat(F.lit("#"), clean))
        .when(~clean.startswith("#") & clean.contains("/"), F.concat(F.lit("#/"), F.ltrim(clean, F.lit("/"))))
        .otherwise(clean)
    )


def parent_ref(ref: Column, body: str = "#/body") -> Column:
    parts = F.filter(F.split(F.substring(ref, 3, 1 << 30), "/"), lambda p: p != "")
    return F.when(
        (ref != body) & ref.startswith("#/") & (F.size(parts) > 1),
        F.concat(F.lit("#/"), F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), "/")),
    ).otherwise(F.lit(body))
