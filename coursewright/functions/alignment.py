"""Similarity of two texts by recursive longest-matching-block alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# In a second text of at least 200 characters, those in more than one of a hundred places (and one
# more) start no match; they only prolong one.
LONG, SHARE = 200, 100
_SMALL = 1500  # area of a box that is searched cell by cell
_BASE = 0x9E3779B97F4A7C15


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


class _Pair:
    """Two texts with hashes of all stretches of characters that may start a match."""

    def __init__(self, a: str, b: str):
        self.a, self.b = a, b
        self.codes = _points(a), _points(b)
        values, counts = np.unique(self.codes[1], return_counts=True)
        rare = values if len(b) < LONG else values[counts <= len(b) // SHARE + 1]
        longest = max(len(a), len(b)) + 1
        steps = np.full(longest, _BASE | 1, np.uint64)
        steps[0] = 1
        self.powers = np.cumprod(steps, dtype=np.uint64)
        self.sums, self.reach = [], []
        for codes in self.codes:
            mixed = codes.astype(np.uint64) + np.uint64(1)
            mixed = (mixed ^ (mixed << np.uint64(21))) * np.uint64(0xBF58476D1CE4E5B9)
            # A stretch's hash is its last sum less its first one times a power: the first character counts most.
            sums = np.zeros(len(codes) + 1, np.uint64)
            inverse = np.uint64(pow(_BASE | 1, -1, 1 << 64))
            down = np.full(len(codes) + 1, inverse, np.uint64)
            down[0] = 1
            down = np.cumprod(down, dtype=np.uint64)
            np.cumsum(mixed * down[: len(codes)], out=sums[1:])
            self.sums.append(sums)
            good = np.isin(codes, rare)
            ends = np.append(np.flatnonzero(~good), len(codes))
            self.reach.append(ends[np.searchsorted(ends, np.arange(len(codes)))] - np.arange(len(codes)))

    def starts(self, side: int, lo: int, hi: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of the stretches of ``size`` characters within [lo, hi)."""
        at = lo + np.flatnonzero(self.reach[side][lo : hi - size + 1] >= size) if hi - lo >= size else np.empty(0, np.int64)
        sums = self.sums[side]
        return at, (sums[at + size] - sums[at]) * self.powers[at]

    def common(self, box: tuple[int, int, int, int], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        alo, ahi, blo, bhi = box
        i, x = self.starts(0, alo, ahi, size)
        j, y = self.starts(1, blo, bhi, size)
        both = np.isin(x, y)
        return i[both], x[both], j, y

    def longest(self, box: tuple[int, int, int, int], most: int) -> int:
        """Greatest size up to ``most`` of a stretch that both sides of the box hold; what holds for a size holds below."""
        alo, ahi, blo, bhi = box
        most = min(most, int(self.reach[0][alo:ahi].max(initial=0)), int(self.reach[1][blo:bhi].max(initial=0)), ahi - alo, bhi - blo)
        low, step = 0, 1
        while low < most and len(self.common(box, min(low + step, most))[0]):
            low, step = min(low + step, most), step * 2
        high = min(low + step, most + 1)  # fails, or is beyond
        while high - low > 1:
            middle = (low + high) // 2
            if len(self.common(box, middle)[0]):
                low = middle
            else:
                high = middle
        return low

    def blocks(self, box: tuple[int, int, int, int], size: int) -> Iterator[tuple[int, int]]:
        """Starts of stretches of ``size`` as the recursion takes them: the leftmost in a, there the leftmost in b, then right of both.

        Left of a stretch that is taken none of this size is left, so one sweep finds them all.
        The receiver sends back where the prolonged stretch ends.
        """
        a, b = self.a, self.b
        i, x, j, y = self.common(box, size)
        order = np.lexsort((j, y))
        j, y = j[order], y[order]
        head, tail = np.searchsorted(y, x, side="left"), np.searchsorted(y, x, side="right")
        from_a, from_b = box[0], box[2]
        for at, first, last in zip(i.tolist(), head.tolist(), tail.tolist(), strict=True):
            if at < from_a:
                continue
            k = first + int(np.searchsorted(j[first:last], from_b))
            if k < last and a[at : at + size] == b[j[k] : j[k] + size]:
                from_a, from_b = yield at, int(j[k])

    def small(self, box: tuple[int, int, int, int]) -> tuple[int, int, int]:
        """(i, j, size) of the longest stretch in a box of few cells."""
        alo, ahi, blo, bhi = box
        a, b, reach = self.a, self.b, self.reach[1]
        best = alo, blo, 0
        before: dict[int, int] = {}
        places: dict[str, list[int]] = {}
        for j in range(blo, bhi):
            if reach[j]:
                places.setdefault(b[j], []).append(j)
        for i in range(alo, ahi):
            now = {j: before.get(j - 1, 0) + 1 for j in places.get(a[i], ())}
            for j, size in now.items():
                if size > best[2]:
                    best = i - size + 1, j - size + 1, size
            before = now
        return best

    def prolonged(self, box: tuple[int, int, int, int], i: int, j: int, size: int) -> tuple[int, int, int]:
        """The stretch with all equal characters next to it, within the box."""
        alo, ahi, blo, bhi = box
        left, right = self.codes
        for step in (64, 1 << 40):
            n = min(i - alo, j - blo, step)
            differ = np.flatnonzero(left[i - n : i] != right[j - n : j])
            more = n - 1 - int(differ[-1]) if len(differ) else n
            i, j, size = i - more, j - more, size + more
            if more < step:
                break
        for step in (64, 1 << 40):
            n = min(ahi - i - size, bhi - j - size, step)
            differ = np.flatnonzero(left[i + size : i + size + n] != right[j + size : j + size + n])
            more = int(differ[0]) if len(differ) else n
            size += more
            if more < step:
                break
        return i, j, size

    def matched(self) -> int:
        """Characters in matching blocks."""
        total = 0
        boxes = [(0, len(self.a), 0, len(self.b), len(self.a))]
        while boxes:
            *box, most = boxes.pop()
            alo, ahi, blo, bhi = box
            if alo == ahi or blo == bhi:
                continue
            if (ahi - alo) * (bhi - blo) <= _SMALL:
                i, j, size = self.prolonged(box, *self.small(box))
                total += size
                if size:
                    boxes += [(alo, i, blo, j, most), (i + size, ahi, j + size, bhi, most)]
                continue
            size = self.longest(box, most)
            if not size:  # the box's corner alone is prolonged
                total += self.prolonged((alo, ahi, blo, bhi), alo, blo, 0)[2]
                continue
            sweep = self.blocks(box, size)
            found = next(sweep, None)
            while found:
                i, j, n = self.prolonged((alo, ahi, blo, bhi), *found, size)
                total += n
                boxes.append((alo, i, blo, j, size - 1))
                alo, blo = i + n, j + n
                try:
                    found = sweep.send((alo, blo))
                except StopIteration:
                    found = None
            boxes.append((alo, ahi, blo, bhi, size - 1))
        return total


def ratio(a: str, b: str) -> float:
    """Twice the characters of the matching blocks over all characters; 1 for two empty texts.

    The longest block of equal characters is taken (the leftmost in ``a``, then in ``b``), then the
    same is done left and right of it.
    """
    if a == b:
        return 1.0
    return 2.0 * _Pair(a, b).matched() / (len(a) + len(b))


def matching_ratio(a: str | Column, b: str | Column, digits: int | None = 6) -> Column:
    """``ratio`` of two text columns, rounded; null if one is null."""

    @F.pandas_udf("double")
    def aligned(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(left, right, strict=True)], dtype="float64")

    value = aligned(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)
    return value if digits is None else F.round(value, digits)
