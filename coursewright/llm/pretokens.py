"""Pre-tokens of byte-level BPE: the split before the merges, on whole batches of text."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex

from coursewright.llm import words

# Code points with the White_Space property.
WHITE_SPACE = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006,
    0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
# The endings that are split off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """The kind of every code point: letter, number, white space or other."""
    if not _kinds:
        every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "" for c in range(0x110000))
        table = np.zeros(0x110000, dtype=np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
            for found in regex.finditer(pattern, every):
                table[found.start() : found.end()] = kind
        table[list(WHITE_SPACE)] = _SPACE
        _kinds.append(table)
    return _kinds[0]


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """(pre-tokens of all texts in a row, number of the first of each text and of all).

    The split is that of the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+|
    ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` (each text by itself): runs of one kind; the last
    space of a run of white space goes to what follows, any other last white space stands
    alone; an apostrophe that starts a run takes a following ending.
    """
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    places = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    heads = np.zeros(len(points) + 1, dtype=bool)
    heads[np.searchsorted(places, offsets)] = True
    if not len(points):
        return pa.array([], pa.binary()), np.zeros(len(offsets), np.int64)
    kind = kinds()[points]
    start = heads.copy()
    start[1:-1] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(start)
    begin, stop = runs[:-1], runs[1:]
    inner = (kind[begin] == _SPACE) & ~heads[stop]
    last, after = stop[inner] - 1, stop[inner]
    start[last] = True
    start[after[points[last] == 0x20]] = False
    quote = np.flatnonzero((points == 0x27) & start[:-1])
    if len(quote):
        padded = np.append(points, np.zeros(3, np.uint32))
        ended = np.append(heads, np.ones(3, bool))
        for ending in ENDINGS:
            fits = np.ones(len(quote), dtype=bool)
            for j, letter in enumerate(ending, 1):
                fits &= (padded[quote + j] == ord(letter)) & ~ended[quote + j]
            at = quote[fits]
            start[at + 1] = False
            start[at + 1 + len(ending)] = True
    starts = np.flatnonzero(start[:-1])
    ends = np.append(places[starts], len(data))
    wide = ends.astype(np.int32)
    tokens = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(wide), pa.py_buffer(np.ascontiguousarray(data))])
    return tokens, np.searchsorted(ends[:-1], offsets)


def distinct(batch: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct pre-tokens, their number at each place, first place of each text)."""
    tokens, first = split(*words.buffers(batch))
    coded = tokens.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), first


class Memo:
    """Results by pre-token that tasks of one worker share, in two generations.

    When the young one holds ``limit`` results or ``size`` bytes it becomes the old one, whose
    results are then dropped unless they have been asked for since; so what is frequent stays and
    memory is bounded.  A pre-token of more than ``longest`` bytes is made anew each time.
    """

    def __init__(self, limit: int = 100_000, size: int = 16 << 20, longest: int = 2048):
        self.limit, self.size, self.longest = limit, size, longest
        self.young: dict = {}
        self.old: dict = {}
        self.held = 0

    def fill(self, keys: list[bytes], make: Callable[[list[bytes]], Iterable]) -> list:
        """A result for each of the distinct ``keys``; ``make`` gets the list of those not known."""
        if len(self.young) > self.limit or self.held > self.size:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        unknown = []
        for key in keys:
            if key not in young:
                if key in old:
                    young[key] = old[key]
                    self.held += len(key)
                else:
                    unknown.append(key)
        made = list(make(unknown))
        once = {}
        for key, value in zip(unknown, made, strict=True):
            if len(key) > self.longest:
                once[key] = value
            else:
                young[key] = value
                self.held += len(key)
        return [young[key] if key in young else once[key] for key in keys]
