"""Words, word hashes and shingles of Arrow text columns, with whole-array operations.

Used inside tasks: Spark deals the rows, these helpers work on the buffers of one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled by itself.
PIECE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's last steps)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def draws(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2^64."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        size = max(n + 1, PIECE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``limit`` bytes of text, or one row; with ``rows`` no slice has more of them."""
    ends = buffers(batch.column(column))[1][1:]
    at, n = 0, batch.num_rows
    while at < n:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        stop = min(stop, at + rows) if rows else stop
        yield batch.slice(at, stop - at)
        at = stop


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the n + 1 places where they part; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_large_binary(texts.type) and not pa.types.is_binary(texts.type) else b"")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    parts = texts.buffers()
    offsets = np.frombuffer(parts[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(parts[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if parts[2] is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same for a list of byte strings."""
    ends = np.cumsum([0, *map(len, texts)], dtype=np.int64)
    return np.frombuffer(b"".join(texts), dtype=np.uint8), ends


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): runs of bytes other than space and tab to carriage return.

    ``first`` has the number of the first word of each text, and the number of words last.
    """
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)  # a text starts (or all texts end) here
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = True
    np.logical_or(~inside[:-1], edge[1:-1], out=before[1:])
    after = np.empty(len(data), dtype=bool)
    after[-1] = True
    np.logical_or(~inside[1:], edge[1:-1], out=after[:-1])
    start = np.flatnonzero(inside & before)
    end = np.flatnonzero(inside & after) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes, by one running sum over all text, then mixed."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first): each run of ``size`` words of a text; a shorter text that has words gives one of them all."""
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    parts = np.concatenate([[0], np.cumsum(count)])
    factors = draws(size + 1, 77) | np.uint64(1)
    rolled = np.zeros(len(hashes), dtype=np.uint64)
    for j in range(min(size, len(hashes))):
        rolled[: len(hashes) - j] += hashes[j:] * factors[j]
    at = np.arange(parts[-1], dtype=np.int64) - np.repeat(parts[:-1] - first[:-1], count)
    out = rolled[at]
    for k in np.flatnonzero((n > 0) & (n < size)):
        own = hashes[first[k] : first[k + 1]]
        out[parts[k]] = np.append(own * factors[: len(own)], factors[size : size + 1] * np.uint64(len(own))).sum(dtype=np.uint64)
    return mix(out), parts
