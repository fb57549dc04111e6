"""Document fingerprints: one-permutation MinHash, densified, kept as packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursewright.llm import words

#: Words of a shingle; bins of a fingerprint (a power of two); low-order bits kept of each bin.
SHINGLE, BINS, BITS = 5, 256, 4
#: Rows of one range of ids, at most, and at least where there are few.
RANGE_ROWS, LEAST_ROWS = 100_000, 1_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def bin_minima(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, BINS): the least shingle hash in each bin, every shingle hashed once.

    An empty bin takes the value of the first full one in a sequence of bins that is drawn for
    it and alike for all texts (optimal densification).  A text without words keeps no value.
    """
    start, end, first = words.word_bounds(data, offsets)
    hashes, parts = words.shingles(words.word_hashes(data, start, end), first, SHINGLE)
    n = len(offsets) - 1
    table = np.full(n * BINS, _EMPTY)
    slot = np.repeat(np.arange(n, dtype=np.int64), np.diff(parts)) * BINS + (hashes >> np.uint64(64 - (BINS.bit_length() - 1))).astype(np.int64)
    np.minimum.at(table, slot, hashes & np.uint64((1 << 48) - 1))
    table = table.reshape(n, BINS)
    full = table != _EMPTY
    out = table.copy()
    rows, bins = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while len(rows):
        attempt += 1
        target = (words.mix(np.arange(BINS, dtype=np.uint64) * np.uint64(1 << 32) + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)
        source = target[bins]
        hit = full[rows, source]
        out[rows[hit], bins[hit]] = table[rows[hit], source[hit]]
        rows, bins = rows[~hit], bins[~hit]
    return out


def packed(minima: np.ndarray) -> list[str]:
    """Hex of the low-order bits of all bins; an empty string for a text without words."""
    low = (minima & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    bits = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - BITS :].reshape(len(low), -1)
    rows = np.packbits(bits, axis=1)
    none = (minima == _EMPTY).all(axis=1)
    return ["" if empty else row.tobytes().hex() for row, empty in zip(rows, none, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of paired rows of ``bin_minima``.

    Unequal bins agree by chance in their low-order bits once in 2^BITS, which is taken off.
    Two texts without words are alike (1); one without and one with words are not (0).
    """
    mask = np.uint64((1 << BITS) - 1)
    share = ((a & mask) == (b & mask)).mean(axis=1)
    chance = 1 / (1 << BITS)
    value = np.clip((share - chance) / (1 - chance), 0.0, 1.0)
    a_none, b_none = (a == _EMPTY).all(axis=1), (b == _EMPTY).all(axis=1)
    return np.where(a_none | b_none, (a_none & b_none).astype(float), value)


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``fingerprint``: the general operator, one pass and no shuffle.

    A null text counts as empty.  A column named fingerprint is replaced.
    """
    keep = [c for c in docs.columns if c != "fingerprint"]
    schema = docs.select(*keep, F.lit("").alias("fingerprint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.pieces(batch, text):
                value = pa.array(packed(bin_minima(*words.buffers(part.column(text)))), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, value], names=[*keep, "fingerprint"])

    return docs.select(*keep).mapInArrow(run, schema)


def _bounds(ids: DataFrame, rows: int) -> np.ndarray:
    """Smallest keys of ranges of about equal size; as many numbers as there are ranges."""
    partitions = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(rows // LEAST_ROWS, 4 * partitions), -(-rows // RANGE_ROWS))
    cuts = ids.approxQuantile("key", [k / ranges for k in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    inner = np.unique(np.asarray(cuts, dtype=np.float64).astype(np.int64))

    def lows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = np.searchsorted(inner, frame["key"].to_numpy(), side="right")
            yield frame["key"].groupby(at).min().rename_axis("range").reset_index(name="low")

    found = ids.mapInPandas(lows, "range long, low long").groupBy("range").agg(F.min("low").alias("low"))
    return np.sort(np.asarray([r.low for r in found.select("low").collect()], dtype=np.int64))


FOLLOWED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _describe(rows: list[tuple], after: str) -> pd.DataFrame:
    """Result rows for (doc_id, text) in order; ``after`` is the text that follows the last."""
    texts = [text for _, text in rows]
    nexts = [*texts[1:], after]
    edited = []
    for text, following in zip(texts, nexts, strict=True):
        k = len(text) // 4
        edited.append((text[: len(text) - k] + following[:k]).encode())
    plain = bin_minima(*words.joined([t.encode() for t in [*texts, after]]))
    own, ahead = plain[:-1], plain[1:]
    changed = bin_minima(*words.joined(edited))
    return pd.DataFrame(
        {
            "doc_id": pd.array([i for i, _ in rows], dtype="Int64"),
            "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
            "fingerprint": packed(own),
            "edited_fingerprint": packed(changed),
            "near_edited": likeness(own, changed),
            "near_next": likeness(own, ahead),
        }
    )


def followed(docs: DataFrame) -> DataFrame:
    """Each document against itself with its last quarter replaced, and against the next document.

    The next document is the one with the next larger doc_id; the first follows the last.  A
    null text is empty, a null id comes first, rows with one id follow each other by text.  No
    rows give none; a single document is its own next.

    Documents are dealt to ranges of ids, cut by a pass over the ids alone, so each text moves
    once.  The first document of a range is sent to the range before as well; a task then
    reads its ranges in order and holds a few megabytes of text at a time.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"),
        F.col("doc_id").isNull().alias("unnamed"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ids = rows.select("key")
    low = _bounds(ids, ids.count())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            at = np.searchsorted(low, key, side="right") - 1
            heads = np.flatnonzero(low[at] == key)
            for part, where, ahead in ((batch, at, False), (batch.take(pa.array(heads)), (at[heads] - 1) % len(low), True)):
                extra = [pa.array(where.astype(np.int64)), pa.array(np.full(len(where), ahead))]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=["key", "unnamed", "text", "range", "ahead"])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        held_bytes, current, closed = 0, None, False
        for frame in frames:
            columns = (frame[c] for c in ("key", "unnamed", "text", "range", "ahead"))
            for key, unnamed, text, where, ahead in zip(*columns, strict=True):
                if where != current:
                    current, closed = where, False
                if ahead:  # the first row ahead ends the range, rows that repeat its id are not needed
                    if held and not closed:
                        yield _describe(held, text)
                        held, held_bytes = [], 0
                    closed = True
                    continue
                if held_bytes > words.PIECE_BYTES:
                    yield _describe(held, text)
                    held, held_bytes = [], 0
                held.append((None if unnamed else int(key), text))
                held_bytes += len(text)

    dealt = rows.mapInArrow(deal, "key long, unnamed boolean, text string, range long, ahead boolean")
    ordered = dealt.repartition("range").sortWithinPartitions("range", "ahead", "key", F.desc("unnamed"), "text")
    return ordered.mapInPandas(read, FOLLOWED)
