"""Ordered scans that do not need one task per group.

A plain ``Window.partitionBy(doc_id).orderBy(seq)`` puts a whole document in one
task, so the largest document bounds the job.  ``scan`` cuts every group into
blocks of ``block_rows`` order values, runs the window inside each block, folds the
(tiny) block totals into carries, and joins the carries back on (keys, block).  The
wide rows are hashed by (keys, block): a group holding a third of all rows is spread
like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16384
_BLOCK = "_block"

# kind, expression, whether the current row takes part
ScanSpec = tuple[str, Column, bool]


def _over(kind: str, expr: Column, window) -> Column:
    if kind == "last":
        return F.last(expr, ignorenulls=True).over(window)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](expr).over(window)


def _total(kind: str, expr: Column, order: Column, reverse: bool) -> Column:
    if kind == "last":
        at = F.when(expr.isNotNull(), order)
        return F.min_by(expr, at) if reverse else F.max_by(expr, at)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](expr)


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind == "last":
        return F.coalesce(local, carry)
    if kind == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    return F.greatest(local, carry) if kind == "max" else F.least(local, carry)


def block_of(order: str, block_rows: int | None = None) -> Column:
    return F.expr(f"`{order}` div {int(block_rows or BLOCK_ROWS)}")


def _blocked(df: DataFrame, order: str, block_rows: int | None) -> DataFrame:
    return df.withColumn(_BLOCK, block_of(order, block_rows))


def _inside(keys: Sequence[str], order: str, reverse: bool = False):
    direction = F.col(order).desc() if reverse else F.col(order).asc()
    return Window.partitionBy(*keys, _BLOCK).orderBy(direction)


def _earlier_blocks(keys: Sequence[str], reverse: bool = False):
    direction = F.col(_BLOCK).desc() if reverse else F.col(_BLOCK).asc()
    return Window.partitionBy(*keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    specs: Mapping[str, ScanSpec],
    *,
    reverse: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """Add running ``sum``/``max``/``min``/``last`` columns over (keys, order).

    ``order`` is a non-negative integer column, unique within ``keys``.  ``last`` is
    the latest non-null value; with a struct expression and ``inclusive=False`` it is
    the previous row, whatever its values.
    """
    keys = list(keys)
    names = list(specs)
    staged = _blocked(df, order, block_rows)
    for name in names:
        staged = staged.withColumn(f"_in_{name}", specs[name][1])
    inside = _inside(keys, order, reverse)
    local = staged
    for name in names:
        kind, _, inclusive = specs[name]
        frame = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        local = local.withColumn(f"_at_{name}", _over(kind, F.col(f"_in_{name}"), frame))

    totals = staged.groupBy(*keys, _BLOCK).agg(
        *[_total(specs[n][0], F.col(f"_in_{n}"), F.col(order), reverse).alias(f"_sum_{n}") for n in names]
    )
    before = _earlier_blocks(keys, reverse)
    carries = totals.select(
        *keys, _BLOCK, *[_over(specs[n][0], F.col(f"_sum_{n}"), before).alias(f"_carry_{n}") for n in names]
    )
    joined = local.join(carries, [*keys, _BLOCK], "left")
    return joined.select(
        *[F.col(c) for c in df.columns if c not in names],
        *[_combine(specs[n][0], F.col(f"_at_{n}"), F.col(f"_carry_{n}")).alias(n) for n in names],
    )


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str,
    columns: Sequence[str],
    continues: Callable[[Column, Column], Column],
    *,
    block_rows: int | None = None,
) -> DataFrame:
    """Add ``name``: the ``order`` of the first row of each row's run.

    ``continues(previous, current)`` (structs of ``columns``) says whether a row extends
    the run of the row before.  Only a block's first row needs its neighbour block, and
    that is settled on the block totals, so the rows are scanned once.
    """
    keys = list(keys)
    staged = _blocked(df, order, block_rows).withColumn("_row", F.struct(*columns))
    w = _inside(keys, order)
    prev = F.lag("_row").over(w)
    # Null where the answer lies in the block before.
    begins = F.when(prev.isNotNull(), ~F.coalesce(continues(prev, F.col("_row")), F.lit(False)))
    local = staged.withColumn("_start", F.when(begins, F.col(order)))
    local = local.withColumn(
        "_own", F.last("_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    edges = local.groupBy(*keys, _BLOCK).agg(
        F.min_by("_row", order).alias("_first"),
        F.max_by("_row", order).alias("_last"),
        F.min(order).alias("_at"),
        F.max("_start").alias("_latest"),
    )
    by_block = Window.partitionBy(*keys).orderBy(_BLOCK)
    left = F.lag("_last").over(by_block)
    joined_left = F.coalesce(continues(left, F.col("_first")), F.lit(False))
    edges = edges.withColumn("_opens", F.when(joined_left, None).otherwise(F.col("_at")))
    edges = edges.withColumn("_end", F.coalesce("_latest", "_opens"))
    carried = F.last("_end", ignorenulls=True).over(_earlier_blocks(keys))
    heads = edges.select(*keys, _BLOCK, F.coalesce(F.col("_opens"), carried).alias("_head"))
    out = local.join(heads, [*keys, _BLOCK], "left")
    return out.select(*df.columns, F.coalesce("_own", "_head").alias(name))


def previous(df: DataFrame, keys: Sequence[str], order: str, name: str, columns: Sequence[str], **kw) -> DataFrame:
    """Add struct ``name`` holding ``columns`` of the row before (null on the first row)."""
    return scan(df, keys, order, {name: ("last", F.struct(*columns), False)}, **kw)


def following(df: DataFrame, keys: Sequence[str], order: str, name: str, columns: Sequence[str], **kw) -> DataFrame:
    """Add struct ``name`` holding ``columns`` of the row after (null on the last row)."""
    return scan(df, keys, order, {name: ("last", F.struct(*columns), False)}, reverse=True, **kw)


def ordinal(df: DataFrame, keys: Sequence[str], order: str, name: str, when: Column | None = None, **kw) -> DataFrame:
    """Add the 0-based position within ``keys`` by ``order`` (counting rows where ``when``)."""
    one = F.lit(1).cast("long") if when is None else F.when(when, 1).otherwise(0).cast("long")
    return scan(df, keys, order, {name: ("sum", one, False)}, **kw)


def ordered_join(value: Column, order: Column, sep: str) -> Column:
    """Aggregate: values joined by ``sep`` in ``order``."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), sep)


def per_key(
    df: DataFrame, key: str, order: Sequence[str], fn: Callable[[list[tuple]], list[tuple]], schema: str
) -> DataFrame:
    """``fn`` over the rows (tuples, ``key`` first) of each key in ``order``, for truly sequential steps.

    Rows stream through sorted partitions, one key buffered at a time: thousands of
    small keys share a task without the cost of a pandas group each.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held, out = None, [], []
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                if held and row[0] != current:
                    out.extend(fn(held))
                    held = []
                    if len(out) >= 10000:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                current = row[0]
                held.append(row)
        if held:
            out.extend(fn(held))
        if out:
            yield pd.DataFrame(out, columns=names)

    columns = [key, *[c for c in df.columns if c != key]]
    return df.select(*columns).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
