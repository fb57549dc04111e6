"""Byte-level BPE encoding and decoding with a rank queue over a hierarchical bitmap."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from coursewright.llm import pretokens, words

#: Largest vocabulary file that is sent to the workers.
VOCABULARY_BYTES = 64 << 20
#: Ranks of one word of the bitmap's lower level, as a power of two.
_WORD = 8
_BIT = [1 << k for k in range(1 << _WORD)]
#: Bytes of pre-tokens that share a queue; a longer pre-token has one by itself.
QUEUED_BYTES = 16 << 10
#: Stands for the id of a byte that the vocabulary lacks.
_MISSING = -2
_INT = struct.Struct("=i")


class Vocabulary:
    """Merge ranks from the lines of a rank file (base64 of the bytes, rank), and the rank queue.

    The queue has a bucket of positions for each rank.  A bitmap in words of 256 ranks says
    which buckets are filled, and one above it which words are; the next rank is the first set
    bit of the first word that has one.  A bucket is sorted when its turn comes, so that the
    leftmost position is first; if a pair of lower rank comes up the rest waits as a heap.
    Many pre-tokens share one queue: no pair joins two of them, so each is merged as if it were
    alone, and a rank is looked for once for all places that have it.
    """

    def __init__(self, content: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
        self.size = max(self.ranks.values(), default=-1) + 1
        table: list[bytes | None] = [None] * self.size
        self.of_byte = np.full(256, _MISSING, dtype=np.int32)
        self.of_pair = np.full(1 << 16, -1, dtype=np.int32)
        for token, rank in self.ranks.items():
            table[rank] = token
            if len(token) <= 2:
                (self.of_byte if len(token) == 1 else self.of_pair)[int.from_bytes(token, "big")] = rank
        self.tokens = pa.array(table, pa.binary())
        self.buckets: dict[int, list[int]] = {}
        self.bitmap = [0] * ((self.size >> _WORD) + 1)
        self.memo = pretokens.Memo()

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of least rank is merged, leftmost first, until none is left."""
        return np.frombuffer(self.encode_all([piece])[0], dtype=np.int32).tolist()

    def encode_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as bytes of 32-bit integers; a bounded part of them is queued at once."""
        ids_of = {p: _INT.pack(self.ranks[p]) for p in pieces if p in self.ranks}
        rest = [p for p in pieces if p not in ids_of]
        sizes = np.cumsum([len(p) for p in rest])
        at = 0
        while at < len(rest):
            base = sizes[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(sizes, base + QUEUED_BYTES, side="right")))
            ids_of.update(zip(rest[at:stop], self._merge(rest[at:stop]), strict=True))
            at = stop
        return [ids_of[p] for p in pieces]

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens that are no tokens themselves, by one queue; a gap follows each of them."""
        data = b"\0".join([*pieces, b""])
        codes = np.frombuffer(data, dtype=np.uint8).astype(np.int32)
        n = len(codes)
        gaps = np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) + 1) - 1
        heads = np.append(0, gaps[:-1] + 1)
        ahead, behind = np.arange(1, n + 1), np.arange(-1, n - 1)
        ahead[gaps], behind[heads] = 0, -1
        after = ahead.tolist()  # where the next token starts, for each token's start; 0 after a gap
        before = behind.tolist()  # where the token before starts; -1 at the start of a pre-token
        own = self.of_byte[codes]
        own[gaps] = -1
        token = own.tolist()  # the id of the token that starts here, -1 where none does
        first = np.append(self.of_pair[(codes[:-1] << 8) + codes[1:]], np.int32(-1))
        first[gaps] = -1
        first[gaps - 1] = -1
        pair: list[int | None] = first.tolist()  # rank of a token joined with the next; an entry of the queue that differs is stale
        filled = self._fill(first)  # the bitmap's words that are not 0
        rank_of, buckets, bitmap = self.ranks.get, self.buckets, self.bitmap
        heaps: set[int] = set()  # ranks whose bucket is a heap; others are sorted when their turn comes
        while filled:
            word = (filled & -filled).bit_length() - 1
            bits = bitmap[word]
            low = (bits & -bits).bit_length() - 1
            rank = (word << _WORD) + low
            bucket = buckets[rank]
            if rank in heaps:
                turn = [heappop(bucket)]
            else:
                bucket.sort()
                turn = bucket
            least = rank  # of the pairs that came up since; a lower one goes before what is left of the turn
            done = 0
            for i in turn:
                done += 1
                if pair[i] != rank:
                    continue
                middle = after[i]
                stop = after[middle]
                after[i] = stop
                token[i] = rank
                token[middle] = -1
                pair[middle] = pair[i] = None
                before[stop] = i
                for at, end in ((before[i], stop), (i, after[stop])):
                    if at < 0 or not end:
                        continue
                    found = pair[at] = rank_of(data[at:end])
                    if found is None:
                        continue
                    if found not in buckets:
                        buckets[found] = [at]
                        bitmap[found >> _WORD] |= _BIT[found & 255]
                        filled |= 1 << (found >> _WORD)
                    elif found in heaps:
                        heappush(buckets[found], at)
                    else:
                        buckets[found].append(at)
                    if found < least:
                        least = found
                if least < rank:
                    break
            if turn is bucket:
                del bucket[:done]
                if bucket:
                    heaps.add(rank)
            if not bucket:
                heaps.discard(rank)
                del buckets[rank]
                bitmap[word] ^= _BIT[low]
                if not bitmap[word]:
                    filled ^= 1 << word
        left_over = np.array(token, dtype=np.int32)
        if (left_over == _MISSING).any():
            raise KeyError("a byte is not in the vocabulary")
        kept = left_over >= 0
        ids = left_over[kept].tobytes()
        ends = (np.cumsum(kept)[gaps] * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _fill(self, first: np.ndarray) -> int:
        """Puts each place with a pair into the bucket of its rank (``first``); gives the filled words."""
        places = np.flatnonzero(first >= 0)
        places = places[np.argsort(first[places], kind="stable")]
        ranks, begin, count = np.unique(first[places], return_index=True, return_counts=True)
        ordered, filled = places.tolist(), 0
        for rank, a, n in zip(ranks.tolist(), begin.tolist(), count.tolist(), strict=True):
            self.buckets[rank] = ordered[a : a + n]
            self.bitmap[rank >> _WORD] |= _BIT[rank & 255]
            filled |= 1 << (rank >> _WORD)
        return filled

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, first id of each text and their number)."""
        pieces, index, first = pretokens.distinct(texts)
        own = self.memo.fill(pieces, self.encode_all)
        if not own:
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 4
        flat, at = np.frombuffer(b"".join(own), dtype=np.int32), np.cumsum(sizes) - sizes
        length = sizes[index]
        ends = np.concatenate([[0], np.cumsum(length)])
        take = np.arange(ends[-1], dtype=np.int64) - np.repeat(ends[:-1] - at[index], length)
        return flat[take], ends[first]

    def decode_batch(self, lists: pa.ListArray) -> pa.BinaryArray:
        """The bytes of each list of ids."""
        parts = self.tokens.take(lists.flatten())
        if parts.null_count:
            raise ValueError("an id is not in the vocabulary")
        data, ends = words.buffers(parts)
        counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        ends = ends[np.concatenate([[0], np.cumsum(counts)])]
        content, known = data.tobytes(), lists.is_valid().to_pylist()
        return pa.array([content[a:b] if ok else None for a, b, ok in zip(ends[:-1], ends[1:], known, strict=True)], pa.binary())


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(digest: str, content: bytes) -> Vocabulary:
    if digest not in _loaded:
        _loaded.clear()
        _loaded[digest] = Vocabulary(content)
    return _loaded[digest]


def _sent(spark, path: str):
    """(digest, broadcast content) of a vocabulary file that the driver reads."""
    with open(path, "rb") as file:
        content = file.read(VOCABULARY_BYTES + 1)
    if len(content) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    return hashlib.sha256(content).hexdigest(), spark.sparkContext.broadcast(content)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with its text replaced by ``ids``, the token ids of the whole text.

    ``path`` is a rank file; its bytes (bounded) are sent to the workers.  Special tokens are
    ordinary text.  A null or empty text has no ids (an empty array); a text of one pre-token
    of any length takes time n log n.  Equal rows give equal rows; a column named like ``ids``
    is replaced, others are kept.  With ``decoded`` the bytes that the ids stand for are added
    in the same pass, under that name, so that a caller can check them.  No shuffle.
    """
    keep = [c for c in docs.columns if c not in (text, ids, decoded)]
    digest, content = _sent(docs.sparkSession, path)
    schema = T.StructType([docs.schema[c] for c in keep]).add(ids, T.ArrayType(T.IntegerType(), False))
    if decoded:
        schema = schema.add(decoded, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(digest, content.value)
        for batch in batches:
            for part in words.pieces(batch, text):
                flat, first = vocabulary.encode_batch(part.column(text))
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat))
                made = [lists, vocabulary.decode_batch(lists)] if decoded else [lists]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with a binary column ``out``: the bytes of its token ids in a row.

    Null ids give null, no ids give no bytes, an id that the vocabulary lacks fails.  A column
    named like ``out`` is replaced.
    """
    keep = [c for c in encoded.columns if c != out]
    digest, content = _sent(encoded.sparkSession, path)
    schema = T.StructType([encoded.schema[c] for c in keep]).add(out, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(digest, content.value)
        for batch in batches:
            made = vocabulary.decode_batch(batch.column(ids))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), made], names=[*keep, out])

    return encoded.mapInArrow(run, schema)
