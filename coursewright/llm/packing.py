"""Best-fit packing of documents into training sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursewright.llm.staging import Stages
from coursewright.session import stage

#: Permitted sequence lengths, in the unit of the length column.
CAPACITIES = (2048, 4096, 8192, 16384, 32768)
#: Length at which the quadratic (attention) part of a sequence's cost equals the linear one.
BALANCE = 262144
#: Pieces packed together; a group is one task's work and stays in its memory.
GROUP_ROWS = 50_000
PACKED = "doc_id long, piece int, start long, length long, bin_id long, capacity int, offset int"


def cost(capacity: int, balance: float = BALANCE) -> float:
    """Relative cost of training on one sequence of this length."""
    return capacity + capacity * capacity / balance


def best_fit(lengths: Sequence[int], capacities: Sequence[int], balance: float = BALANCE) -> list[int]:
    """Bin numbers for ``lengths``, which fall and fit the largest capacity.

    An item goes to the open bin with the least room that holds it; a full bin is closed, for
    items of length 0 as well.  If there is none, the size opened is the one with the least cost for
    each unit it can expect to hold: the item and what the smaller items still to come can fill.
    Ties go to the smaller size; of bins with equal room the one that came to it last is taken.
    """
    sizes = sorted(capacities)
    n = len(lengths)
    left = np.concatenate([np.cumsum(np.asarray(lengths, dtype=np.int64)[::-1])[::-1], [0]])
    rising = -np.asarray(lengths, dtype=np.int64)  # for searching the falling lengths
    rooms: list[int] = []  # distinct rooms of open bins, rising
    bins: dict[int, list[int]] = {}  # room -> open bins
    chosen, opened = [], 0
    for k, length in enumerate(lengths):
        at = bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms[at]
            home = bins[room].pop()
            if not bins[room]:
                del bins[room]
                rooms.pop(at)
        else:
            best = None
            for size in sizes:
                if size < length:
                    continue
                first = max(k + 1, int(np.searchsorted(rising, length - size)))  # first length <= size - length
                filled = length + min(size - length, int(left[min(first, n)]))
                merit = cost(size, balance) / max(filled, 1)
                if best is None or merit < best[0]:
                    best = (merit, size)
            room, home = best[1], opened
            opened += 1
        chosen.append(home)
        rest = room - length
        if rest:
            if rest not in bins:
                insort(rooms, rest)
                bins[rest] = []
            bins[rest].append(home)
    return chosen


def pack_group(rows: pd.DataFrame, capacities: Sequence[int], balance: float = BALANCE) -> pd.DataFrame:
    """One group packed; each bin is cut down to the smallest permitted size that holds it."""
    rows = rows.sort_values(["length", "doc_id", "piece", "row"], ascending=[False, True, True, True], kind="stable")
    lengths = rows["length"].to_numpy()
    home = np.asarray(best_fit(lengths.tolist(), capacities, balance), dtype=np.int64)
    filled = np.bincount(home, weights=lengths).astype(np.int64)
    sizes = np.asarray(sorted(capacities))
    return pd.DataFrame(
        {
            "doc_id": rows["doc_id"].to_numpy(),
            "piece": rows["piece"].to_numpy(),
            "start": rows["start"].to_numpy(),
            "length": lengths,
            "bin_id": (rows["pack_group"].to_numpy(dtype=np.int64) << 24) + home,
            "capacity": sizes[np.searchsorted(sizes, filled)][home].astype(np.int32),
            "offset": (pd.Series(lengths).groupby(home).cumsum().to_numpy() - lengths).astype(np.int32),
        }
    )


def pack(
    docs: DataFrame, length: str, *, capacities: Iterable[int] = CAPACITIES, balance: float = BALANCE,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Where each document goes: (doc_id, piece, start, length, bin_id, capacity, offset).

    ``length`` names a column of unit counts (tokens, bytes).  A document longer than the
    largest capacity is cut into pieces of that capacity and a rest, so nothing is lost;
    ``start`` is a piece's place in its document, ``offset`` its place in its bin.  A null or
    zero length takes no room and gives one piece of length 0 in some bin.  Rows that repeat
    an id are packed as rows of their own; a null id stays null.  No rows, no bins.

    Pieces are dealt to groups of about ``group_rows`` by row, whatever their ids, and each
    group is packed by itself: the last, half-filled bins of a group are all that is lost
    against one global packing.
    """
    sizes = sorted({int(c) for c in capacities})
    if not sizes or sizes[0] < 1:
        raise ValueError("capacities must be positive")
    top = sizes[-1]
    rows = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0)).alias("n"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    count = F.greatest(F.expr(f"(n + {top - 1}) div {top}"), F.lit(1))
    pieces = rows.select("doc_id", "n", "row", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("piece")).select(
        "doc_id",
        "row",
        F.col("piece").cast("int").alias("piece"),
        (F.col("piece") * top).alias("start"),
        F.least(F.lit(top), F.col("n") - F.col("piece") * top).alias("length"),
    )
    total = rows.agg(F.sum(count)).first()[0] or 0
    groups = max(1, -(-total // group_rows))
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(lambda g: pack_group(g, sizes, balance), PACKED)


def halves(ids: Column) -> Column:
    """Ids as shorts: struct(low, high), ``high`` null where all ids are from 0 to 65,535; half the bytes of integers then."""
    high = F.transform(ids, lambda v: F.shiftright(v, 16).cast("short"))
    low = F.transform(ids, lambda v: (v.bitwiseAND(F.lit(65535)) - 32768).cast("short"))
    return F.struct(low.alias("low"), F.when(F.exists(ids, lambda v: (v < 0) | (v > 65535)), high).alias("high"))


def joined_halves(pair: Column) -> Column:
    """The ids that ``halves`` took apart."""
    low = lambda v: v.cast("int") + 32768
    both = F.zip_with(pair["low"], pair["high"], lambda a, b: F.shiftleft(b.cast("int"), 16).bitwiseOR(low(a)))
    return F.when(pair["high"].isNull(), F.transform(pair["low"], low)).otherwise(both)


def sequences(
    docs: DataFrame, end: int, *, ids: str = "ids", key: str = "doc_id", capacities: Iterable[int] = CAPACITIES,
    balance: float = BALANCE, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Packed sequences of token ids: (bin_id, capacity, n_tokens, ids, segments), one row each.

    ``ids`` names an array of token ids; each document is followed by the id ``end``, so that
    one with null or no ids still takes a place.  ``segments`` tell in order what a sequence
    holds: (doc_id, piece, start, offset, length), where ``start`` is a piece's place in its
    document and ``offset`` its place in the sequence, the start of an attention segment.  The
    rest of a sequence up to ``capacity`` is left to be padded.  A document over the largest
    capacity continues in other sequences; nothing is cut off or lost.  Rows that repeat a key
    are documents of their own, a null key stays null; other columns, whatever their names, are
    ignored.  Equal lengths are placed by row, which says nothing of their content.  No rows,
    no sequences.

    A document is cut into pieces before they move, so no shuffled row holds more than the
    largest capacity, whatever the longest document; pieces meet their places by (row, piece).
    Ids move as ``halves``.
    """
    sizes = sorted({int(c) for c in capacities})
    spark = docs.sparkSession
    stages = Stages(spark)
    closed = F.concat(F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")), F.array(F.lit(end)))
    held = stages.keep(
        "held", docs.select(F.col(key).cast("long").alias("doc_id"), closed.alias("ids"), F.monotonically_increasing_id().alias("row"))
    )
    # Only the narrow places pass through the packing, known by row.
    places = pack(held.select(F.col("row").alias("doc_id"), F.size("ids").alias("n")), "n", capacities=sizes, balance=balance, group_rows=group_rows)
    top = sizes[-1]
    starts = F.sequence(F.lit(0), F.size("ids") - 1, F.lit(top))
    pieces = held.select("doc_id", "row", F.posexplode(F.transform(starts, lambda at: F.slice("ids", at + 1, top))).alias("piece", "ids"))
    pieces = pieces.withColumn("ids", halves(F.col("ids")))
    joined = places.withColumnRenamed("doc_id", "row").join(pieces, ["row", "piece"])
    part = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    whole = joined.groupBy("bin_id").agg(F.first("capacity").alias("capacity"), F.array_sort(F.collect_list(part)).alias("parts"))
    made = whole.select(
        "bin_id",
        "capacity",
        F.flatten(F.transform("parts", lambda p: joined_halves(p["ids"]))).alias("ids"),
        F.transform("parts", lambda p: F.struct(*[p[c].alias(c) for c in ("doc_id", "piece", "start", "offset", "length")])).alias("segments"),
    )
    return made.select("bin_id", "capacity", F.size("ids").alias("n_tokens"), "ids", "segments")
