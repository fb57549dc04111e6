"""Repeated runs of lines, found by winnowing over line hashes and removed where they come later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursewright.llm.staging import Stages, unused

#: A run of this many lines that are not blank counts as a repeat, whatever its words.
MIN_LINES = 3

#: A shorter run, from one line upward, counts when it holds this many words.
MIN_WORDS = 8


def _windows(min_lines: int) -> list[tuple[int, int]]:
    """(lines before, lines after) of every run of up to ``min_lines`` lines around one of them."""
    return [(left, n - 1 - left) for n in range(1, min_lines + 1) for left in range(n)]


def fingerprints(
    docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The lines chosen by winnowing: (id, version, p, print, own, lines, at).

    A window is a run of up to ``min_lines`` lines that counts as a repeat.  It chooses its
    line with the least hash, the leftmost of equal ones, as its fingerprint, so that equal windows
    choose the same line at the same place.  Bit k of ``own`` says that this line is chosen by the
    window of ``_windows(min_lines)[k]``; lines that no window chooses are left out.  ``p`` counts
    lines that are not blank; ``lines`` and ``at`` are the hashes and the places in the text of the
    line and its neighbours, null beyond the ends.
    """
    reach = min_lines - 1
    span = range(-reach, reach + 1)
    split = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("i"), F.trim(line).alias("line")))
    seq = F.transform(
        F.filter(split, lambda x: x["line"] != ""),
        lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["line"]).alias("h"), F.size(F.split(x["line"], " +")).alias("w")),
    )
    hashed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), seq.alias("seq"))
    near = F.transform("seq", lambda x, p: F.struct(p.alias("p"), *[F.get("seq", p + d).alias(f"n{d + reach}") for d in span]))
    flat = hashed.select("id", "version", F.explode(near).alias("x")).select("id", "version", "x.*")
    field = lambda d, name: F.col(f"n{d + reach}.{name}")
    own = F.lit(0)
    for k, (left, right) in enumerate(_windows(min_lines)):
        chosen = field(-left, "h").isNotNull() & field(right, "h").isNotNull()
        for d in range(-left, right + 1):
            if d:
                chosen &= field(0, "h") < field(d, "h") if d < 0 else field(0, "h") <= field(d, "h")
        if left + right < reach:
            chosen &= sum((field(d, "w") for d in range(-left, right + 1)), F.lit(0)) >= min_words
        own = own + F.when(chosen, F.lit(1 << k)).otherwise(F.lit(0))
    return flat.select(
        "id",
        "version",
        "p",
        field(0, "h").alias("print"),
        own.alias("own"),
        F.array(*[field(d, "h") for d in span]).alias("lines"),
        F.array(*[field(d, "i") for d in span]).alias("at"),
    ).where(F.col("own") > 0)


def repeated_lines(
    docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, version, gone): places of the lines covered by a later copy of a run.

    Each fingerprint is joined with its first position only and the match is extended line by
    line to both sides, as far as windows reach; what goes on beyond is met from the next
    fingerprint.  A window that matches there is a later copy: any other place of it would share
    the fingerprint too, and the first position comes before.  Windows whose lines differ from
    those round the first position have no copy there; among themselves they are grouped by all
    their hashes, and the first of its kind stays, so that no repeat is missed.
    Positions meet a smallest one, never each other: a fingerprint that holds a third of all
    lines is combined before the shuffle, and what the joins look up is written first, so that
    Spark can split the other side's hot keys.  The joins are merge joins whatever the size, for
    the plan to cost in proportion.
    """
    reach = min_lines - 1
    windows = _windows(min_lines)
    stages = Stages(docs.sparkSession)
    positions = fingerprints(docs, min_lines, min_words, id_col, text)
    ends = positions.groupBy("print").agg(
        F.min(F.struct("id", "version", "p", "lines")).alias("first"), F.max(F.struct("id", "version", "p")).alias("last")
    )
    once = F.col("first.id").eqNullSafe(F.col("last.id")) & (F.col("first.version") == F.col("last.version")) & (F.col("first.p") == F.col("last.p"))
    shared = stages.keep("shared", ends.where(~once).select("print", "first"))

    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("version") == F.col("first.version"))
    joined = positions.join(shared.hint("merge"), "print").withColumn("same", same)
    line = lambda d: F.get("lines", F.lit(d + reach))
    equal = {d: F.coalesce(line(d) == F.get("first.lines", F.lit(d + reach)), F.lit(False)) for d in range(-reach, reach + 1)}
    for d in range(1, min_lines):  # a match is extended while the lines before it match
        equal[d], equal[-d] = equal[d] & equal[d - 1], equal[-d] & equal[1 - d]
    joined = joined.withColumns({f"e{d + reach}": e for d, e in equal.items()})
    met = lambda d: F.col(f"e{d + reach}")
    hits, rest = {d: F.lit(False) for d in equal}, []
    for k, (left, right) in enumerate(windows):
        chosen, matched, n = F.col("own").bitwiseAND(1 << k) != 0, met(-left) & met(right), left + right + 1
        later = chosen & matched & (~F.col("same") | (F.col("p") - F.col("first.p") >= n))
        for d in range(-left, right + 1):
            hits[d] = hits[d] | later
        cut = [F.slice(c, reach - left + 1, n).alias(c) for c in ("lines", "at")]
        rest.append(F.when(chosen & ~matched, F.struct((F.col("p") - left).alias("start"), *cut)))
    extended = joined.select(
        "id",
        "version",
        F.array_compact(F.array(*[F.when(h, F.get("at", F.lit(d + reach))) for d, h in hits.items()])).alias("at"),
        F.array_compact(F.array(*rest)).alias("rest"),
    ).where((F.size("at") > 0) | (F.size("rest") > 0))
    extended = stages.keep("extended", extended)

    others = extended.select("id", "version", F.explode("rest").alias("w")).select("id", "version", "w.*")
    kinds = others.groupBy("lines").agg(F.min(F.struct("id", "version", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = stages.keep("first", kinds.where(F.col("n") > 1).select("lines", "first"))
    apart = F.col("start") - F.col("first.start") >= F.size("lines")
    later = others.join(first.hint("merge"), "lines").where(~same | apart).select("id", "version", "at")
    covered = extended.where(F.size("at") > 0).select("id", "version", "at").unionByName(later)
    # Rows equal in id and text have the same windows: a set holds each once, before the shuffle too.
    return covered.groupBy("id", "version").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("gone"))


def line_dedup(
    docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with later copies of repeated runs of lines cut out, plus line_count and removed_count.

    Lines are compared without the blanks at their ends; lines that are blank take no part and
    stay.  A run is lines in a row, at least ``min_lines`` of them or with at least ``min_words``
    words (pieces between blanks).  A line goes if a run that covers it also stands in a document
    with a smaller id, or earlier in the same document without overlap: of a longer repeated
    run, the runs of up to ``min_lines`` lines in it are judged.  The rest is joined by newlines as it was.  A null text stays null (no lines); a text without a repeat
    is unchanged.  Rows with one id and different texts are ordered by a hash of the text; rows
    equal in both count as one document and are cut alike.  A null id comes first.  Columns named
    line_count or removed_count are replaced; all others are kept.
    """
    keep = [c for c in docs.columns if c not in ("line_count", "removed_count")]
    gone_id, gone_version, gone, version, lines, left = unused(docs, "_gone_id", "_gone_version", "_gone", "_version", "_lines", "_left")
    found = repeated_lines(docs, min_lines, min_words, id_col, text).toDF(gone_id, gone_version, gone).hint("shuffle_hash")
    joined = (
        docs.select(*keep, F.xxhash64(text).alias(version))
        .join(found, F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(version) == F.col(gone_version)), "left")
        .withColumn(lines, F.split(text, "\n"))
    )
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    cut = joined.withColumn(left, F.when(F.col(gone).isNotNull(), rest))
    return cut.select(
        *[c for c in keep if c != text],
        F.when(F.col(left).isNull(), F.col(text))
        .otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
        .alias(text),
        F.coalesce(F.when(F.col(lines).isNotNull(), F.size(lines)), F.lit(0)).alias("line_count"),
        F.coalesce(F.when(F.col(gone).isNotNull(), F.size(gone)), F.lit(0)).alias("removed_count"),
    ).select(*keep, "line_count", "removed_count")
