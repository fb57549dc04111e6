"""Greedy matchings as Spark rounds: no group in one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coursewright.operators import sequence as Q
from coursewright.session import stage

#: Asks and offers of a group that one task serves in order; larger groups are served in rounds.
GROUP_ROWS = 1 << 16


def dominant_pairs(pairs: DataFrame, keys: Sequence[str], left: str, right: str, weight: str) -> DataFrame:
    """(keys, left, right): what taking pairs by falling ``weight``, then ``left``, then ``right`` gives, each end used once.

    A pair that is the best of all pairs of both its ends is taken by the greedy walk whatever else
    it takes, so each round takes all of these at once and drops the pairs of their ends.  Rows
    meet by (keys, end) only.  Rounds grow with the longest run of pairs that wait for one another.
    """
    keys = list(keys)
    rank = F.struct((-F.col(weight)).alias("w"), F.col(left).alias("l"), F.col(right).alias("r"))
    open_ = stage(pairs.select(*keys, left, right, weight))
    taken = []
    while True:
        of_left = open_.groupBy(*keys, left).agg(F.min(rank).alias("best")).select(*keys, left, F.col("best.r").alias(right))
        of_right = open_.groupBy(*keys, right).agg(F.min(rank).alias("best")).select(*keys, F.col("best.l").alias(left), right)
        best = stage(of_left.join(of_right, [*keys, left, right]))
        if best.isEmpty():
            break
        taken.append(best)
        rest = open_.join(best.select(*keys, left), [*keys, left], "left_anti").join(best.select(*keys, right), [*keys, right], "left_anti")
        open_ = stage(rest.select(*keys, left, right, weight))
    out = best
    for part in taken:
        out = out.unionByName(part)
    return out


def paired_in_order(a: DataFrame, b: DataFrame, keys: Sequence[str], order_a: str, order_b: str) -> DataFrame:
    """(keys, order_a, order_b): the k-th row of ``a`` with the k-th of ``b``, as far as both go; orders are numbers from 0 up."""
    keys = list(keys)
    one = Q.ordinal(a.select(*keys, order_a), keys, order_a, "_k")
    two = Q.ordinal(b.select(*keys, order_b), keys, order_b, "_k")
    return one.join(two, [*keys, "_k"]).drop("_k")


def placed_in_queue(rows: DataFrame, keys: Sequence[str], order: str, tie: str) -> DataFrame:
    """``rows`` with ``place``, the number from 0 by (order, tie) within ``keys``: a scan over the distinct orders, and ties by themselves."""
    keys = list(keys)
    counts = stage(rows.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("n")))
    before = Q.scan(counts, keys, order, {"before": ("sum", F.col("n"), False)}).drop("n")
    ties = F.row_number().over(Window.partitionBy(*keys, order).orderBy(tie)) - 1
    return rows.withColumn("tie", ties).join(before, [*keys, order]).withColumn("place", F.col("before") + F.col("tie")).drop("before", "tie")


def served_in_order(asks: DataFrame, offers: DataFrame, key: str) -> DataFrame:
    """(key, at, offer): who gets which offer when all are served in the order of ``at``, each offer once.

    ``asks``: key, at (unique, from 0), first, second (names of queues, may be null) or fixed (an
    offer of its own, or null).  ``offers``: key, queue, place (unique in its queue, from 0), offer.
    Someone with a fixed offer takes it from its queue if it is still there, and has it in any case;
    others take the first one left in their first queue, else in their second.

    A group of at most ``GROUP_ROWS`` asks and offers is served by the task that holds it; all
    such groups share one shuffle.  Larger ones are served in rounds.
    """
    offers = stage(offers.select(key, "queue", "place", "offer"))
    fixed = asks.where(F.col("fixed").isNotNull()).select(key, "at", F.col("fixed").alias("offer"))
    sizes = asks.select(key).unionByName(offers.select(key)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    large = stage(sizes.where(F.col("n") > GROUP_ROWS).select(key))
    if large.isEmpty():
        return fixed.unionByName(_served_by_group(asks, offers, key))
    of = lambda df, how: df.join(large, key, how)
    out = fixed.unionByName(_served_by_group(of(asks, "left_anti"), of(offers, "left_anti"), key))
    return out.unionByName(_served_in_rounds(of(asks, "left_semi"), of(offers, "left_semi"), key))


def _served_by_group(asks: DataFrame, offers: DataFrame, key: str) -> DataFrame:
    """``served_in_order`` without the fixed offers, a group at a time; a group's offers come before its asks."""
    types = {"offer": offers.schema["offer"].dataType, "at": asks.schema["at"].dataType, "key": asks.schema[key].dataType}
    rows = offers.select(
        F.col(key), F.lit(0).alias("kind"), F.col("place").cast("long").alias("order"), F.col("queue").alias("first"),
        F.lit(None).cast("string").alias("second"), "offer", F.lit(None).cast(types["at"]).alias("at"),
    ).unionByName(
        asks.where(F.col("at").isNotNull()).select(
            F.col(key), F.lit(1).alias("kind"), F.col("at").cast("long").alias("order"), "first", "second",
            F.col("fixed").cast(types["offer"]).alias("offer"), "at",
        )
    )
    met = rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, "kind", "order").drop("order")
    schema = f"`{key}` {types['key'].simpleString()}, at {types['at'].simpleString()}, offer {types['offer'].simpleString()}"
    return met.mapInArrow(_serve, schema)


def _serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, at, offer) of the asks without a fixed offer; rows (key, kind, first, second, offer, at) of a group follow each other."""
    group, queues, starts, gone = None, {}, {}, set()
    for batch in batches:
        taken = []
        for key, kind, first, second, offer, at in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key != group:
                group, queues, starts, gone = key, {}, {}, set()
            if kind == 0:
                queues.setdefault(first, []).append(offer)
            elif offer is not None:
                gone.add(offer)
            else:
                for name in (first, second):
                    queue = queues.get(name, ()) if name is not None else ()
                    place = starts.get(name, 0)
                    while place < len(queue) and queue[place] in gone:
                        place += 1
                    if place < len(queue):
                        taken.append((key, at, queue[place]))
                        starts[name] = place + 1
                        break
        names, kinds = batch.schema.names, batch.schema.types
        columns = list(zip(*taken, strict=True)) or [(), (), ()]
        fields = [(names[0], kinds[0]), ("at", kinds[5]), ("offer", kinds[4])]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _served_in_rounds(asks: DataFrame, offers: DataFrame, key: str) -> DataFrame:
    """``served_in_order`` without the fixed offers, no group in one task.

    In each queue the leading rows that surely ask it now (for all others it is the second choice
    while the first has offers) are served at once, the k-th with the k-th offer; leading fixed
    ones are taken out.  The first of a group is never behind anyone, so each round serves it.
    """
    queued = stage(offers)
    fixed = asks.where(F.col("fixed").isNotNull()).select(key, "at", F.col("fixed").alias("offer"))
    held = fixed.join(queued.select(key, "queue", "offer").distinct(), [key, "offer"]).select(
        key, "queue", "at", F.lit(0).alias("choice"), "offer"
    )
    names = F.array_compact(F.array_distinct(F.array("first", "second")))
    wishes = asks.where(F.col("fixed").isNull()).select(key, "at", F.posexplode(names).alias("choice", "queue")).select(
        key, "queue", "at", (F.col("choice") + 1).alias("choice"), F.lit(None).cast(offers.schema["offer"].dataType).alias("offer")
    )
    waiting = stage(wishes.unionByName(held))
    served = []
    while True:
        # Queues without offers are dropped; then a row's least choice left is the one it surely makes now.
        live = waiting.join(queued.select(key, "queue").distinct(), [key, "queue"], "left_semi")
        least = live.groupBy(key, "at").agg(F.min("choice").alias("now"))
        asked = stage(live.join(least, [key, "at"]).withColumn("sure", F.col("choice") == F.col("now")))
        if asked.isEmpty():
            break
        taking = F.col("choice") > 0
        stops = asked.groupBy(key, "queue").agg(
            F.min(F.when(~(F.col("sure") & taking), F.col("at"))).alias("not_taking"), F.min(F.when(taking, F.col("at"))).alias("first_taking")
        )
        placed = asked.join(stops, [key, "queue"])
        takers = placed.where(taking & (F.col("not_taking").isNull() | (F.col("at") < F.col("not_taking"))))
        gone = placed.where(~taking & (F.col("first_taking").isNull() | (F.col("at") < F.col("first_taking"))))
        met = stage(
            paired_in_order(takers.select(key, "queue", "at"), queued.select(key, "queue", "place"), [key, "queue"], "at", "place").join(
                queued, [key, "queue", "place"]
            )
        )
        served.append(met.select(key, "at", "offer"))
        gone = stage(gone.select(key, "queue", "at", "offer"))
        queued = stage(
            queued.join(met.select(key, "queue", "place"), [key, "queue", "place"], "left_anti").join(
                gone.select(key, "queue", "offer"), [key, "queue", "offer"], "left_anti"
            )
        )
        done = met.select(key, "at").unionByName(gone.select(key, "at"))
        waiting = stage(asked.drop("now", "sure").join(done, [key, "at"], "left_anti"))
    out = fixed.where("false")
    for part in served:
        out = out.unionByName(part)
    return out
