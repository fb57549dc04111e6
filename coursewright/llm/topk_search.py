"""Exact top-k search by inner product, pruning block by block of a forward index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coursewright.session import stage

#: Vectors of a block, blocks of a range that a task reads, and queries that it answers together.
BLOCK_ROWS, RANGE_BLOCKS, QUERY_ROWS = 256, 64, 1024
#: Bounded sample by which vectors are put in order, so that blocks hold like vectors.
PIVOTS = 32
_BLOCKS = "width int, span long, first long, ids binary, terms binary, low binary, high binary"


def _pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length, at most PIVOTS vectors with the least hashes."""
    hashed = vectors.select(F.size("terms").alias("width"), F.xxhash64("terms").alias("draw"), "terms")
    least = Window.partitionBy("width").orderBy("draw", "terms")
    rows = hashed.withColumn("n", F.row_number().over(least)).where(F.col("n") <= PIVOTS).select("width", "terms").collect()
    found: dict[int, list] = {}
    for row in rows:
        found.setdefault(row.width, []).append(row.terms)
    return {w: np.asarray(v, dtype=np.float64).reshape(len(v), w) for w, v in found.items()}


def forward_index(vectors: DataFrame) -> DataFrame:
    """Blocks of at most BLOCK_ROWS vectors (id, terms), one row each.

    Vectors are ordered by length, nearest pivot and id, and cut to blocks within a range
    partition.  A block has its ids, its vectors and the least and largest value of each term;
    ``span`` names the range of up to RANGE_BLOCKS blocks that it belongs to.
    """
    pivots = _pivots(vectors)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            width = frame["terms"].map(len).to_numpy()
            near = np.zeros(len(frame), dtype=np.int64)
            for w in np.unique(width):
                rows = np.flatnonzero(width == w)
                own = np.stack(frame["terms"].iloc[rows].to_numpy()).astype(np.float64) if w else np.zeros((len(rows), 0))
                near[rows] = (own @ pivots[int(w)].T).argmax(axis=1) if int(w) in pivots else 0
            yield frame.assign(width=width, near=near)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, made, held = TaskContext.get().partitionId() << 32, 0, None

        def block(rows: pd.DataFrame) -> dict:
            nonlocal made
            rows = rows.sort_values("id", kind="stable")
            terms = np.stack(rows["terms"].to_numpy()).astype(np.int64)
            ids = rows["id"].to_numpy(dtype=np.int64)
            made += 1
            return {
                "width": terms.shape[1], "span": base + (made - 1) // RANGE_BLOCKS, "first": base + made - 1, "ids": ids.tobytes(),
                "terms": terms.tobytes(), "low": terms.min(axis=0).tobytes(), "high": terms.max(axis=0).tobytes(),
            }

        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            blocks = []
            while len(held):
                same = int((held["width"].to_numpy() == held["width"].iloc[0]).cumprod()[:BLOCK_ROWS].sum())
                if same == len(held) and same < BLOCK_ROWS:
                    break
                blocks.append(block(held.iloc[:same]))
                if same < BLOCK_ROWS:  # another length begins: so does another range
                    made = -(-made // RANGE_BLOCKS) * RANGE_BLOCKS
                held = held.iloc[same:]
            if blocks:
                yield pd.DataFrame(blocks)
        if held is not None and len(held):
            yield pd.DataFrame([block(held)])

    placed = vectors.select("id", "terms").mapInPandas(place, "id long, terms array<long>, width int, near long")
    ordered = placed.repartitionByRange("width", "near", "id").sortWithinPartitions("width", "near", "id")
    return ordered.mapInPandas(cut, _BLOCKS)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer product a @ b.T; in floating point where every sum stays exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    most = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def search_blocks(
    query_ids: np.ndarray, queries: np.ndarray, ids: list[np.ndarray], terms: list[np.ndarray],
    low: np.ndarray, high: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids) of each query's best k, and how many (query, block) pairs were scored.

    A block's bound is the sum of the largest products that each term allows.  A query takes
    blocks by falling bound and ends at the first whose bound is below its k-th score; a bound
    equal to it is still read, for a tie can bring a smaller id.  Missing places have id -1.
    """
    n = len(queries)
    bounds = _product(np.maximum(queries, 0), high) + _product(np.minimum(queries, 0), low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    none = np.iinfo(np.int64).min
    best, best_ids = np.full((n, k), none), np.full((n, k), np.iinfo(np.int64).max)
    active, scored = np.arange(n), 0
    for step in range(bounds.shape[1]):
        blocks = order[active, step]
        go = (bounds[active, blocks] >= best[active, k - 1]) | (best[active, k - 1] == none)
        active, blocks = active[go], blocks[go]
        if not len(active):
            break
        scored += len(active)
        for b in np.unique(blocks):
            rows = active[blocks == b]
            scores = _product(queries[rows], terms[b])
            scores[query_ids[rows][:, None] == ids[b][None, :]] = none
            top = np.argsort(-scores.astype(np.float64) if np.abs(bounds).max() < 2**53 else ~scores, axis=1, kind="stable")[:, :k]
            pool = np.concatenate([best[rows], np.take_along_axis(scores, top, 1)], axis=1)
            pool_ids = np.concatenate([best_ids[rows], ids[b][top]], axis=1)
            keep = np.lexsort((pool_ids, ~pool), axis=1)[:, :k]
            best[rows], best_ids[rows] = np.take_along_axis(pool, keep, 1), np.take_along_axis(pool_ids, keep, 1)
    return best, np.where(best == none, -1, best_ids), scored


def topk_search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest inner products.

    ``vectors`` and ``queries`` are (id long, terms array<long>) without nulls; vectors of
    another length than the query's, and those with the query's id, are no candidates.  Equal
    scores rank by id; candidates that repeat an id count each.  Queries with one id and equal
    terms are one query, with different terms the best of all are ranked together.  A query
    without candidates has no rows; empty inputs give an empty result.

    A task holds one range of blocks and one group of queries; every pair of them is met once,
    and the ranges' best are merged.  Nothing but the pivots and the two numbers of groups
    passes through the driver.
    """
    spark = vectors.sparkSession
    index = stage(forward_index(vectors))
    asked = queries.dropDuplicates(["id", "terms"])
    total = asked.count()
    groups = max(1, -(-total // QUERY_ROWS))
    dealt = asked.withColumn("width", F.size("terms")).withColumn("part", F.pmod(F.xxhash64("id", "terms"), F.lit(groups)))
    spans = index.select("width", "span").distinct().toDF("own_width", "own_span")
    left = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    right = dealt.join(spans, F.col("width") == F.col("own_width")).select("own_width", "own_span", F.col("part").alias("own_part"), "id", "terms")

    def meet(blocks: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if not len(blocks) or not len(own):
            return empty
        width = int(blocks["width"].iloc[0])
        blocks = blocks.sort_values("first")
        ids = [np.frombuffer(x, np.int64) for x in blocks["ids"]]
        terms = [np.frombuffer(x, np.int64).reshape(len(i), width) for i, x in zip(ids, blocks["terms"], strict=True)]
        low, high = (np.stack([np.frombuffer(x, np.int64) for x in blocks[c]]) for c in ("low", "high"))
        numbers = own["id"].to_numpy(dtype=np.int64)
        wanted = np.stack(own["terms"].to_numpy()).astype(np.int64).reshape(len(own), width)
        scores, found, _ = search_blocks(numbers, wanted, ids, terms, low, high, k)
        rows, places = np.nonzero(scores > np.iinfo(np.int64).min)
        return pd.DataFrame({"query_id": numbers[rows], "vec_id": found[rows, places], "score": scores[rows, places]})

    near = left.groupBy("width", "span", "part").cogroup(right.groupBy("own_width", "own_span", "own_part")).applyInPandas(meet, "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, terms) with terms floor(scale * x); rows without an id, or whose vector is null or has a null or non-finite part, are left out."""
    value = lambda x: F.floor(x.cast("double") * scale).cast("long")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return table.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & sound).select(
        F.col(id_col).cast("long").alias("id"), F.transform(vector, value).alias("terms")
    )
