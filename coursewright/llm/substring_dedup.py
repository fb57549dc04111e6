"""Removal of long word sequences that an earlier document holds, found by recompression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursewright.llm import words
from coursewright.llm.staging import Stages, unused

#: Words in a row that make a repeat.
WINDOW = 50
#: Rounds of naming runs and pairs, and words of a symbol from which it is an anchor.
ROUNDS, ANCHOR_WORDS = 4, 4
_FIRST = -(1 << 63)  # stands for a null id


def recompress(hashes: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols over the words of several texts: (name, start, left, right).

    Each round names runs of one symbol, then pairs of a symbol of the first kind and one of
    the second; a symbol's kind is a bit of its name.  Names depend on nothing but contents,
    so equal words get equal names in every task.  Symbols do not cross texts.

    ``start`` is the first word of a symbol.  Word sequences [p, q) that are equal have equal
    symbols ``left[p]`` to ``right[q]`` (exclusive): what remains after each round has dropped
    the outer symbols that words outside could have changed.
    """
    name, start = hashes, np.arange(len(hashes), dtype=np.int64)
    left = np.arange(len(hashes) + 1, dtype=np.int64)
    right = left.copy()
    heads = np.zeros(len(hashes) + 1, dtype=bool)
    heads[first] = True
    a, b, c, d = (words.draws(4, 303) | np.uint64(1)).tolist()
    a, b, c, d = np.uint64(a), np.uint64(b), np.uint64(c), np.uint64(d)
    for k in range(rounds):
        if not len(name):
            break
        # Runs: an outer run may go on outside, so it is dropped as a whole.
        new = np.ones(len(name), dtype=bool)
        new[1:] = (name[1:] != name[:-1]) | heads[start[1:]]
        at = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        length = np.diff(np.append(at, len(name))).astype(np.uint64)
        left_to = np.append(run + 1, len(at))
        right_to = np.concatenate([[0], run])
        left, right = left_to[left], right_to[right]
        name, start = np.where(length == 1, name[at], words.mix(name[at] * a + length * b)), start[at]
        # Pairs: an outer symbol that fits a partner outside is dropped.
        second = (words.mix(name + np.uint64(k)) & np.uint64(1)).astype(bool)
        paired = np.zeros(len(name), dtype=bool)
        paired[:-1] = ~second[:-1] & second[1:] & ~heads[start[1:]]
        new = np.ones(len(name), dtype=bool)
        new[1:] = ~paired[:-1]
        before = np.concatenate([[0], np.cumsum(new)])
        index = np.arange(len(name) + 1)
        left_to = before[np.minimum(index + np.append(second, False), len(name))]
        right_to = before[np.maximum(index - np.concatenate([[False], ~second]), 0)]
        left, right = left_to[left], right_to[right]
        at = np.flatnonzero(new)
        joined = words.mix(name * c + np.append(name[1:], np.uint64(0)) * d)
        name, start = np.where(paired[at], joined[at], name[at]), start[at]
    return name, start, left, right


def anchors(name: np.ndarray, start: np.ndarray, n_words: int) -> np.ndarray:
    """Which symbols cover enough words to be told apart by name."""
    return np.diff(np.append(start, n_words)) >= ANCHOR_WORDS


def window_hashes(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the ``size`` words from each word on (64 and 32 bits); of no use near the end."""
    up, down = words.powers(len(hashes) + size)
    out = []
    for salt in (np.uint64(0), np.uint64(0xD1B54A32D192ED03)):
        own = hashes if not salt else words.mix(hashes + salt)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * up[: len(own)], dtype=np.uint64)])
        ends = np.minimum(np.arange(len(own)) + size, len(own))
        out.append(words.mix((sums[ends] - sums[:-1]) * down[: len(own)]))
    return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)


def _text_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit key of each text's word sequence."""
    up, _ = words.powers(int(np.diff(first).max(initial=0)) + 1)
    place = np.arange(len(hashes), dtype=np.int64) - np.repeat(first[:-1], np.diff(first))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(hashes * up[place]), dtype=np.uint64)])
    return words.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64))


def _parsed(docs: DataFrame, window: int) -> DataFrame:
    """(key, version, text_key, names, open): texts of at least ``window`` words.

    ``names`` are the text's anchors, ``open`` says whether it has a window whose own symbols
    hold no anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.pieces(batch, "text"):
                data, offsets = words.buffers(part.column("text"))
                begin, end, first = words.word_bounds(data, offsets)
                hashes = words.word_hashes(data, begin, end)
                name, start, left, right = recompress(hashes, first)
                anchor = anchors(name, start, len(hashes))
                row = np.searchsorted(first, start, side="right") - 1
                counts = np.bincount(row[anchor], minlength=len(offsets) - 1)
                none_in = _windows_without(anchor, left, right, first, window)
                long_ = np.flatnonzero(np.diff(first) >= window)
                names = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(name[anchor].view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"), part.column("version"), pa.array(_text_keys(hashes, first).view(np.int64)),
                        names, pa.array(np.bincount(none_in[0], minlength=len(offsets) - 1) > 0),
                    ],
                    names=["key", "version", "text_key", "names", "open"],
                ).take(pa.array(long_))

    return docs.mapInArrow(run, "key long, version long, text_key long, names array<long>, open boolean")


def _windows_without(marked: np.ndarray, left: np.ndarray, right: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, word) of the windows none of whose own symbols is marked."""
    ends = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(len(ends)) + window <= ends)
    total = np.concatenate([[0], np.cumsum(marked)])
    low = left[at]
    at = at[total[np.maximum(right[at + window], low)] == total[low]]
    return np.searchsorted(first, at, side="right") - 1, at


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """(hash, check, key, version, at): windows that may stand in another text as well.

    These are the windows whose anchors are all known from a second text (``shared``), and
    those that have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.pieces(batch, "text"):
                data, offsets = words.buffers(part.column("text"))
                begin, end, first = words.word_bounds(data, offsets)
                hashes = words.word_hashes(data, begin, end)
                name, start, left, right = recompress(hashes, first)
                row = np.searchsorted(first, start, side="right") - 1
                salt = words.mix(np.arange(len(offsets), dtype=np.uint64))
                known = part.column("shared").fill_null([])
                values = known.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                owner = np.repeat(np.arange(len(known)), known.value_lengths().to_numpy(zero_copy_only=False))
                unshared = anchors(name, start, len(hashes)) & ~np.isin(name ^ salt[row], values ^ salt[owner])
                text, at = _windows_without(unshared, left, right, first, window)
                one, two = window_hashes(hashes, window)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(one[at].view(np.int64)), pa.array(two[at].view(np.int32)),
                        part.column("key").take(pa.array(text)), part.column("version").take(pa.array(text)),
                        pa.array((at - first[text]).astype(np.int32)),
                    ],
                    names=["hash", "check", "key", "version", "at"],
                )

    return docs.mapInArrow(run, "hash long, check int, key long, version long, at int")


def cut_words(text: bytes, gone: np.ndarray, window: int) -> tuple[bytes, int, int]:
    """(what is left, words, words removed): windows at ``gone`` cut out, each word with the space behind it."""
    data = np.frombuffer(text, dtype=np.uint8)
    start, _, _ = words.word_bounds(data, np.asarray([0, len(data)]))
    n = len(start)
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, gone, 1)
    np.add.at(edges, gone + window, -1)
    kept = np.cumsum(edges)[:n] == 0
    stops = np.append(start[1:], len(text))
    turns = np.diff(np.concatenate([[False], kept, [False]]).astype(np.int8))
    runs = zip(np.flatnonzero(turns == 1), np.flatnonzero(turns == -1), strict=True)
    return b"".join(text[start[a] if a else 0 : stops[b - 1]] for a, b in runs), n, int(n - kept.sum())


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the words of repeated windows, plus word_count and removed_count.

    A word (a run other than space and tab to carriage return) goes if it lies in ``window``
    words in a row that also stand in a row in a document with a smaller id; all is judged on
    the texts as given.  A removed word takes the white space behind it along; what is left is
    unchanged.  A null text stays null and has no words; a text of fewer words than a window
    is never changed.  A null id counts as the smallest.  Rows with one id do not remove from
    each other, but both can lose words to a smaller id.  Columns named word_count or
    removed_count are replaced, all others kept; an empty table gives an empty result.

    Texts are recompressed to symbols whose names depend on contents alone.  Spark finds the
    names that several texts share; a window can repeat only if all symbols that it fixes by
    itself are shared.  Windows that pass are then matched by their full contents (96 bits of
    hash).  Copies of a whole text are settled before that by one key per text.  All groups
    are met by their smallest id, by aggregates that combine before the shuffle; what a join
    looks up is written first, so that Spark can split the other side's hot keys.
    """
    keep = [c for c in docs.columns if c not in ("word_count", "removed_count")]
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST))
    version = F.xxhash64(text)
    source = docs.select(key.alias("key"), version.alias("version"), F.col(text).alias("text"))
    stages = Stages(docs.sparkSession)
    parsed = stages.keep("parsed", _parsed(source, window))
    least = stages.keep("least", parsed.groupBy("text_key").agg(F.min("key").alias("low")))
    marked = parsed.join(least, "text_key")
    chosen = marked.where("key = low")
    named = chosen.select("key", "version", F.explode("names").alias("name"))
    ends = named.groupBy("name").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    shared = stages.keep("shared", ends.where("low < high").select("name"))
    known = named.join(shared, "name").groupBy("key", "version").agg(F.collect_set("name").alias("shared"))
    wanted = (
        chosen.select("key", "version", "open").dropDuplicates(["key", "version"])
        .join(known, ["key", "version"], "left").where("open OR shared IS NOT NULL").select("key", "version", "shared")
    )
    texts = source.join(wanted.hint("shuffle_hash"), ["key", "version"])
    windows = stages.keep("windows", _windows(texts.select("key", "version", "text", "shared"), window))
    copies = stages.keep("copies", marked.where("key > low").select("key", "version").distinct())
    stages.drop("parsed", "least", "shared")
    ends = windows.groupBy("hash", "check").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    first = stages.keep("first", ends.where("low < high").select("hash", "check", "low"))
    later = windows.join(first, ["hash", "check"]).where(F.col("key") > F.col("low"))
    # Rows equal in id and text have the same windows: a set holds each once, before the shuffle too.
    gone = later.groupBy("key", "version").agg(F.collect_set("at").alias("gone")).withColumn("copy", F.lit(False))
    changes = gone.unionByName(copies.select("key", "version", F.lit(None).cast("array<int>").alias("gone"), F.lit(True).alias("copy")))
    of_key, of_version, gone_at, copied, own_key, own_version = unused(docs, "_key", "_version", "_gone", "_copy", "_key2", "_version2")
    changes = changes.toDF(of_key, of_version, gone_at, copied).hint("shuffle_hash")
    joined = docs.select(*keep, key.alias(own_key), version.alias(own_version)).join(
        changes, (F.col(own_key) == F.col(of_key)) & (F.col(own_version) == F.col(of_version)), "left"
    ).select(*keep, gone_at, copied)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.pieces(batch, text):
                _, _, first_word = words.word_bounds(*words.buffers(part.column(text)))
                counts = np.diff(first_word).astype(np.int32)
                removed = np.zeros(len(counts), dtype=np.int32)
                body = part.column(text)
                copy, lists = part.column(copied), part.column(gone_at)
                touched = np.flatnonzero(copy.is_valid().to_numpy(zero_copy_only=False))
                if len(touched):
                    values = body.to_pylist()
                    for k in touched.tolist():
                        if copy[k].as_py():
                            values[k], removed[k] = "", counts[k]
                        else:
                            at = lists[k].values.to_numpy(zero_copy_only=False)
                            left, _, removed[k] = cut_words(values[k].encode(), at, window)
                            values[k] = left.decode()
                    body = pa.array(values, body.type)
                cols = [body if c == text else part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(counts), pa.array(removed)], names=[*keep, "word_count", "removed_count"])

    schema = docs.select(*keep, F.lit(0).alias("word_count"), F.lit(0).alias("removed_count")).schema
    return joined.mapInArrow(run, schema)
