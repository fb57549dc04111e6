"""Runs of periodically repeated words, found by online dyadic square catching.

At level k the words come in aligned blocks of b = 2^k.  A block that is complete is a catcher: it
waits for its own content to come again at a shift q, b <= q < 2b.  Each appended word completes one
suffix of b words a level, and exactly one catcher waits for it, so a word costs one comparison a
level.  Two neighbouring catchers that catch at one shift are a square, 2b >= q; neighbouring squares
are extended word by word at both ends, by less than a block, and merge into a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursewright.llm import words

#: A run has at least so many words, and so many times its period.
MIN_LENGTH, MIN_EXPONENT = 6, 4
# The blanks between words.
BLANKS = " \t\n\x0b\x0c\r"
_APPENDED = 1 << 16
RUN_FIELDS = tuple(pa.field(n, pa.int64(), False) for n in ("start", "length", "period"))
_RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)


class _Level:
    """Catchers of blocks of ``size`` words: suffix hashes of the last words, and where a catcher caught."""

    def __init__(self, size: int):
        self.size = size
        self.base = 0  # the first place whose hash is held
        self.names = np.empty(0, np.uint64)
        self.caught: list[np.ndarray] = []  # by place from ``size`` on: the block before it came again here

    def append(self, names: np.ndarray) -> np.ndarray:
        """Takes hashes of the next places; returns those that a block of twice the size now has."""
        b, held = self.size, len(self.names)
        self.names = np.concatenate([self.names, names])
        first, end = self.base + held, self.base + len(self.names)
        at = np.arange(max(first, b), end)
        if len(at):
            self.caught.append(self.names[at - self.base] == self.names[(at // b - 1) * b - self.base])
        low = max(first - b, 0)
        x = np.arange(low, end - b) - self.base if end - b > low else np.empty(0, np.int64)
        factors = words.draws(2, 900 + b) | np.uint64(1)
        doubled = words.mix(self.names[x] * factors[0] + self.names[x + b] * factors[1])
        keep = max(end // b - 1, 0) * b  # catchers still waiting, and places whose double is not complete
        if keep > self.base:
            self.names, self.base = self.names[keep - self.base :], keep
        return doubled


class Catchers:
    """Runs of a growing sequence of symbols (integers; equal words have equal symbols)."""

    def __init__(self, longest: int):
        """``longest`` bounds the length of a stretch: levels go up to a quarter of it."""
        self.symbols: list[np.ndarray] = []
        self.levels = []
        size = 1
        while size * MIN_EXPONENT <= longest:
            self.levels.append(_Level(size))
            size *= 2

    def append(self, symbols: np.ndarray) -> None:
        self.symbols.append(symbols)
        names = words.mix(symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        for level in self.levels:
            names = level.append(names)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, period) of all runs so far, by start, then period.

        Levels go up.  A square inside a run that is known has a multiple of that run's period
        (its period and the run's both hold on more words than they have together), and the
        stretch with it is the run itself, so it tells nothing new.
        """
        every = np.concatenate(self.symbols) if self.symbols else np.empty(0, np.int64)
        start, end, period = (np.empty(0, np.int64) for _ in range(3))
        for level in self.levels:
            b = level.size
            caught = np.concatenate(level.caught) if level.caught else np.empty(0, bool)
            # caught[i]: place b + i.  A square: the next block is caught at the same shift.
            place = np.flatnonzero(caught[:-b] & caught[b:]) + b if len(caught) > b else np.empty(0, np.int64)
            if not len(place):
                continue
            block = place // b - 1
            shift = place - block * b
            if len(start):
                reach = np.maximum.accumulate(end)
                known = np.searchsorted(start, block * b, side="right") - 1
                fresh = (known < 0) | (reach[np.maximum(known, 0)] < block * b + 2 * b + shift)
                block, shift = block[fresh], shift[fresh]
                if not len(block):
                    continue
            order = np.lexsort((block, shift))
            block, shift = block[order], shift[order]
            new = np.ones(len(block), bool)
            new[1:] = (shift[1:] != shift[:-1]) | (block[1:] != block[:-1] + 1)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(block)) - 1
            q = shift[head]
            lo = _extend(every, block[head] * b - 1, q, -1, b)
            hi = _extend(every, (block[tail] + 2) * b, q, 1, b)
            stop = hi + q
            long = stop - lo >= np.maximum(MIN_LENGTH, MIN_EXPONENT * q)
            if long.any():
                start, end, period = (np.concatenate(x) for x in ((start, lo[long]), (end, stop[long]), (period, q[long])))
                # One stretch may have several multiples of its period: the least is kept.
                order = np.lexsort((period, end, start))
                start, end, period = start[order], end[order], period[order]
                least = np.ones(len(start), bool)
                least[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
                start, end, period = start[least], end[least], period[least]
        order = np.lexsort((period, start))
        start, end, period = start[order], end[order], period[order]
        exact = np.fromiter((np.array_equal(every[s : e - q], every[s + q : e]) for s, e, q in zip(start, end, period, strict=True)), bool, len(start))
        return start[exact], end[exact], period[exact]


def _extend(symbols: np.ndarray, at: np.ndarray, shift: np.ndarray, step: int, most: int) -> np.ndarray:
    """The bound of places x from ``at`` in direction ``step`` with equal symbols at x and x + shift, ``most`` at most.

    Going right it is the first place that differs, going left the last that does not.
    """
    at = at.copy()
    if most > 64:  # few stretches, long ones: each by itself
        for i, (x, q) in enumerate(zip(at.tolist(), shift.tolist(), strict=True)):
            low, high = (x, min(x + most, len(symbols) - q)) if step > 0 else (max(x + 1 - most, 0), x + 1)
            differ = np.flatnonzero(symbols[low:high] != symbols[low + q : high + q])
            if step > 0:
                at[i] = low + differ[0] if len(differ) else max(high, low)
            else:
                at[i] = low + differ[-1] if len(differ) else low - 1
        return at if step > 0 else at + 1
    active = np.arange(len(at))
    for _ in range(most):
        here = at[active]
        far = here + shift[active]
        inside = (here >= 0) & (far < len(symbols))
        active, here, far = active[inside], here[inside], far[inside]
        active = active[symbols[here] == symbols[far]]
        if not len(active):
            break
        at[active] += step
    return at if step > 0 else at + 1


def _symbols(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number for each word of a batch, equal for equal words, and one of its own after each text."""
    texts = len(first) - 1
    out = np.empty(len(start) + texts, np.int64)
    if len(start):
        # Each word with the blanks up to the next one, then without them.
        offsets = np.append(start, end[-1]).astype(np.int32)
        column = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        named = pc.ascii_rtrim(column, characters=BLANKS).dictionary_encode()
        out[np.arange(len(start)) + np.repeat(np.arange(texts), np.diff(first))] = named.indices.to_numpy()
    out[first[1:] + np.arange(texts)] = len(start) + np.arange(texts)
    return out


def find_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period, text, words): the runs of several texts by text, start and period, and each text's words."""
    start, end, first = words.word_bounds(data, offsets)
    count = np.diff(first)
    symbols = _symbols(data, start, end, first)
    catchers = Catchers(int(count.max(initial=0)))
    for at in range(0, len(symbols), _APPENDED):
        catchers.append(symbols[at : at + _APPENDED])
    lo, hi, period = catchers.runs()
    heads = first[:-1] + np.arange(len(count))
    text = np.searchsorted(heads, lo, side="right") - 1
    return lo - heads[text], hi - lo, period, text, count


def collapse(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words of ``text`` joined by one blank, without those of a run after its first period."""
    found = text.split()  # on the six blanks
    if not runs:
        return b" ".join(found)
    keep = np.ones(len(found), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([found[i] for i in np.flatnonzero(keep)])


def _judged(batch: pa.RecordBatch, text: str, kept: list[str]) -> pa.RecordBatch:
    column = batch.column(text)
    data, offsets = words.buffers(column)
    start, length, period, owner, count = find_runs(data, offsets)
    parts = np.searchsorted(owner, np.arange(len(count) + 1))
    triples = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    whole = data.tobytes()
    collapsed = [
        collapse(whole[offsets[i] : offsets[i + 1]], triples[parts[i] : parts[i + 1]]) for i in range(len(count))
    ]
    listed = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(RUN_FIELDS))
    runs = pa.ListArray.from_arrays(pa.array(parts, pa.int32()), listed).cast(pa.list_(pa.field("element", listed.type, False)))
    made = [runs, pa.array(collapsed, pa.binary()).cast(pa.string()), pa.array(count, pa.int64())]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], names=[*kept, "runs", "collapsed", "n_words"])


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (start, length, period) of each whole text, ``collapsed`` text and ``n_words``.

    Words are stretches of characters other than space and tab to carriage return.  A run is a
    stretch with smallest period q, of at least ``MIN_LENGTH`` words and ``MIN_EXPONENT`` * q, that
    no neighbouring word extends; runs are listed by start, then period, and may overlap.  The
    collapsed text has the words joined by one blank, without those that any run holds after its
    first q words.  A null or empty text has no words, no runs and an empty collapsed text.

    Rows are judged one by one, so ids, ties, repeated rows and empty tables need no rule.  Columns
    named runs, collapsed or n_words are replaced; all others are kept.
    """
    kept = [c for c in docs.columns if c not in ("runs", "collapsed", "n_words")]
    given = docs.select(*kept)
    made = [T.StructField("runs", _RUNS, False), T.StructField("collapsed", T.StringType(), False), T.StructField("n_words", T.LongType(), False)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.pieces(batch, text):
                yield _judged(piece, text, kept)

    return given.mapInArrow(judge, T.StructType([*given.schema.fields, *made]))


def longest(runs: str | Column = "runs") -> Column:
    """The run of greatest length (ties: least start, then period); null without runs."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("low"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(ranked)
    return F.when(
        best.isNotNull(), F.struct(best["start"].alias("start"), (-best["low"]).alias("length"), best["period"].alias("period"))
    )
