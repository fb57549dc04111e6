"""Near-duplicate documents by tensored MinHash banding, verified on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursewright.llm import words
from coursewright.llm.components import components
from coursewright.llm.staging import Stages

#: Words of a shingle, and the similarity in percent from which two documents are linked.
SHINGLE, PERCENT = 5, 80
#: Two collections of HALVES half keys of WIDTH minima each: HALVES ** 2 tables with keys of
#: 2 * WIDTH minima from only 2 * HALVES * WIDTH minima.  At similarity 0.8 a pair meets in no
#: table with a chance of about 2 * (1 - 0.8 ** WIDTH) ** HALVES, 4e-4 here.
HALVES, WIDTH = 16, 4
#: 64-bit words of a parity sketch.
SKETCH = 16


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the sorted distinct shingle hashes of each lower-cased text."""
    data = words.lowered(data)
    start, end, first = words.word_bounds(data, offsets)
    hashes, parts = words.shingles(words.word_hashes(data, start, end), first, size)
    sets = [np.unique(hashes[a:b]) for a, b in zip(parts[:-1], parts[1:], strict=True)]
    return (np.concatenate(sets) if sets else hashes), np.cumsum([0, *map(len, sets)])


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[first[1:]] - total[first[:-1]]


def set_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set; equal sets have equal keys, the empty set has 0."""
    a = _sums(words.mix(hashes + np.uint64(11)), first)
    b = _sums(words.mix(hashes ^ np.uint64(0x5DEECE66D)), first)
    key = words.mix(a ^ words.mix(b + np.diff(first).astype(np.uint64)))
    return np.where(np.diff(first) > 0, np.where(key == 0, np.uint64(1), key), np.uint64(0))


def half_keys(hashes: np.ndarray, first: np.ndarray, halves: int = HALVES, width: int = WIDTH) -> np.ndarray:
    """(sets, 2 * halves): the left half keys, then the right ones; sets must not be empty."""
    n = len(first) - 1
    out = np.empty((n, 2 * halves), dtype=np.uint64)
    masks = words.draws(2 * halves * width, 101)
    factors = words.draws(2 * halves * width, 202) | np.uint64(1)
    for k in range(2 * halves):
        key = np.full(n, np.uint64(k + 1))
        for j in range(k * width, (k + 1) * width):
            low = np.minimum.reduceat((hashes ^ masks[j]) * factors[j], first[:-1])
            key = words.mix(key * np.uint64(0x100000001B3) + low)
        out[:, k] = key
    return out


def parity_sketches(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(sets, SKETCH): the parity of the number of elements in each of 64 * SKETCH cells.

    Every cell in which two sets differ holds an element that only one of them has, so the
    differing bits are a lower bound of the size of their symmetric difference.
    """
    n, cells = len(first) - 1, 64 * SKETCH
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(first))
    odd = np.bincount(row * cells + (hashes % np.uint64(cells)).astype(np.int64), minlength=n * cells) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, SKETCH, 64), axis=2, bitorder="little").view(np.uint64).reshape(n, SKETCH)


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, version, n, set, halves) of every row; ``halves`` is empty for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.pieces(batch, "text"):
                hashes, first = shingle_sets(*words.buffers(part.column("text")), size)
                n = np.diff(first)
                some = np.flatnonzero(n)
                keys = half_keys(hashes, np.concatenate([first[:-1][some], first[-1:]])) if len(some) else np.empty((0, 2 * HALVES), np.uint64)
                ends = np.cumsum([0, *np.where(n > 0, 2 * HALVES, 0)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("version"), pa.array(n.astype(np.int64)),
                        pa.array(set_keys(hashes, first).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64))),
                    ],
                    names=["doc_id", "version", "n", "set", "halves"],
                )

    return docs.mapInArrow(run, "doc_id long, version long, n long, set long, halves array<long>")


def _full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(set, size, hashes, s0, s1, ...): the shingle set of each row as packed 64-bit values, and its sketch."""
    names = [f"s{k}" for k in range(SKETCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.pieces(batch, "text"):
                hashes, first = shingle_sets(*words.buffers(part.column("text")), size)
                packed = [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                keys = pa.array(set_keys(hashes, first).view(np.int64))
                sketch = parity_sketches(hashes, first).view(np.int64)
                columns = [keys, pa.array(np.diff(first).astype(np.int64)), pa.array(packed, pa.binary()), *(pa.array(c) for c in sketch.T.copy())]
                yield pa.RecordBatch.from_arrays(columns, names=["set", "size", "hashes", *names])

    return docs.mapInArrow(run, "set long, size long, hashes binary, " + ", ".join(f"{c} long" for c in names))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that are similar enough, by their full contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), strict=True):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[at] == small).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(sets.select(F.col("set").alias("a"), F.col("hashes").alias("one")), "a")
    both = first.join(sets.select(F.col("set").alias("b"), F.col("hashes").alias("two")), "b")
    return both.select("a", "b", "one", "two").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Words are runs other than space and tab to carriage return, A-Z in lower case; a document
    is the set of its ``size``-word shingles, or of all its words as one if it has fewer.  Two
    documents are linked if their sets have at least ``percent`` of their union in common.
    component_id is the smallest id reachable over links, kept marks the document that has it.

    No words or no text: an empty set, linked with nothing.  Rows with one id are one document
    that has the links of them all.  Rows with a null id take part; their component_id is the
    smallest id that is not null (null if there is none), and they are kept only in that last
    case.  Other columns are ignored; an empty table gives an empty result.

    Equal sets are one node from the start.  Half keys that only one node has are dropped;
    the rest are paired to table keys.  In each bucket every node is first held against the
    one that shares most places with others, which joins most of a large group without
    meeting in pairs.  Then the nodes outside a bucket's largest component meet those of its
    other components, as far as their parity sketches allow the similarity; so no candidate
    is left unchecked.  Only sets of candidates are built again, from their whole texts.
    What a join looks up is written first, so that Spark can split the other side's hot keys.
    """
    stages = Stages(docs.sparkSession)
    rows, nodes, roots = _linked(stages, docs, size, percent, tie_ids=True)
    lowest = (
        nodes.select("set", "least").join(roots.withColumnRenamed("node", "set"), "set")
        .groupBy("root").agg(F.min("least").alias("component"))
    )
    linked = roots.join(lowest, "root").select(F.col("node").alias("set"), "component")
    alone = nodes.select("set", "least").join(linked, "set", "left").select("set", F.coalesce("component", "least").alias("component"))
    alone = stages.keep("alone", alone, nodes.count())
    stages.drop("nodes", "twice", "linked", "rest")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "set").join(alone, "set", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_rows(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, version, n_shingles, kept) for every row of ``docs`` (doc_id, text), each text judged by itself.

    ``version`` is the text's xxhash64.  Links are those of ``near_duplicates``, but rows that
    share an id are not tied together.  Of each component one (doc_id, version) is kept: that
    with the smallest id, then the smallest version; a null id comes last.  Rows equal in both
    get the same verdict.  A row with an empty set is linked with nothing and kept.
    """
    stages = Stages(docs.sparkSession)
    rows, nodes, roots = _linked(stages, docs, size, percent, tie_ids=False)
    lowest = nodes.select("set", "place").join(roots.withColumnRenamed("node", "set"), "set").groupBy("root").agg(F.min("place").alias("first"))
    linked = roots.join(lowest, "root").select(F.col("node").alias("set"), "first")
    alone = nodes.select("set", "place").join(linked, "set", "left").select("set", F.coalesce("first", "place").alias("first"))
    alone = stages.keep("alone", alone, nodes.count())
    stages.drop("nodes", "linked", "rest")
    out = rows.select("doc_id", "version", F.col("n").alias("n_shingles"), "set").join(alone, "set", "left")
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("version") == F.col("first.version"))
    return out.select("doc_id", "version", "n_shingles", ((F.col("n_shingles") == 0) | own).alias("kept"))


def _linked(stages: Stages, docs: DataFrame, size: int, percent: int, tie_ids: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, nodes, roots): each row's set, the distinct sets, and the components of those with links.

    A node's ``place`` is its first row, by id and version, a null id last.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("version"))
    rows = stages.keep("rows", _signatures(source, size))
    filled = rows.where("n > 0")
    nodes = stages.keep(
        "nodes",
        filled.groupBy("set").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version")).alias("place"), F.min("doc_id").alias("least"), F.first("halves").alias("halves")
        ),
    )
    members = _members(stages, nodes)
    wanted = members.select("set").distinct().join(nodes.select("set", "place"), "set").select("place.*").distinct()
    texts = source.alias("d").join(
        wanted.alias("w").hint("shuffle_hash"),
        F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & F.col("d.version").eqNullSafe(F.col("w.version")),
        "left_semi",
    )
    sets = stages.keep("sets", _full_sets(texts.select("text"), size).dropDuplicates(["set"]))

    stars = members.where("set <> center").select(F.least("set", "center").alias("a"), F.greatest("set", "center").alias("b"))
    met = stages.keep("met", stars.distinct())
    links = _verified(met, sets, percent)
    if tie_ids:  # rows that share an id: their sets are joined whatever they hold
        named = filled.where("doc_id IS NOT NULL")
        ends = named.groupBy("doc_id").agg(F.min("set").alias("a"), F.max("set").alias("high"))
        twice = stages.keep("twice", ends.where("a < high").select("doc_id", "a"))
        links = links.union(named.join(twice, "doc_id").where("set <> a").select("a", F.col("set").alias("b")).distinct())
    links = stages.keep("linked", links)
    roots = components(links)
    pairs = _open_pairs(stages, members, roots, sets, percent).join(met, ["a", "b"], "left_anti")
    rest = stages.keep("rest", _verified(pairs, sets, percent))
    stages.drop("known", "members", "sets", "met")
    if not rest.isEmpty():
        roots = components(links.union(rest))
    return rows, nodes, roots


def _members(stages: Stages, nodes: DataFrame) -> DataFrame:
    """(bucket, set, center): the buckets of all tables that two nodes or more share.

    The center is the member that meets most others over all its buckets: in a group of
    edited copies that is the text they come from.
    """
    halves = nodes.select("set", F.posexplode("halves").alias("at", "half"))
    ends = halves.groupBy("half").agg(F.min("set").alias("low"), F.max("set").alias("high"))
    shared = stages.keep("shared", ends.where("low < high").select("half"))
    alive = halves.join(shared, "half").groupBy("set").agg(
        F.collect_list(F.when(F.col("at") < HALVES, F.col("half"))).alias("left"),
        F.collect_list(F.when(F.col("at") >= HALVES, F.col("half"))).alias("right"),
    )
    one = alive.select("set", F.explode("left").alias("left"), "right")
    tables = one.select("set", "left", F.explode("right").alias("right")).select("set", F.xxhash64("left", "right").alias("bucket"))
    tables = stages.keep("tables", tables)
    live = stages.keep("live", tables.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    filled = stages.keep("filled", tables.join(live, "bucket"))
    stages.drop("shared", "tables")
    degree = stages.keep("degree", filled.groupBy("set").agg(F.sum("size").alias("degree")), nodes.count())
    top = filled.join(degree, "set").groupBy("bucket").agg(F.max(F.struct("degree", "set")).alias("top"))
    center = stages.keep("center", top.select("bucket", F.col("top.set").alias("center")))
    members = stages.keep("members", filled.join(center, "bucket").select("bucket", "set", "center"))
    stages.drop("live", "filled", "degree", "center")
    return members


def _open_pairs(stages: Stages, members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): nodes that share a bucket, lie in different components so far and may be similar enough."""
    placed = members.join(roots.withColumnRenamed("node", "set"), "set", "left").select("bucket", "set", F.coalesce("root", "set").alias("root"))
    placed = stages.keep("placed", placed)
    mixed = placed.groupBy("bucket").agg(
        F.min("root").alias("first"), F.max("root").alias("last"), F.sum(F.xxhash64("set").cast("decimal(38,0)")).alias("content"), F.count(F.lit(1)).alias("size")
    )
    # Buckets with the same members need to be looked at once.
    once = stages.keep("once", mixed.where("first < last").groupBy("content", "size").agg(F.min("bucket").alias("bucket")).select("bucket"))
    open_ = stages.keep("open", placed.join(once, "bucket"))
    sizes = open_.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"))
    largest = stages.keep("largest", top.select("bucket", F.col("top.root").alias("main")))
    sketches = sets.drop("hashes")
    known = stages.keep("known", open_.join(largest, "bucket").join(sketches, "set"))
    stages.drop("placed", "once", "open", "largest")
    differ = sum((F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}"))) for k in range(SKETCH)), F.lit(0))
    together = F.col("x.size") + F.col("y.size")
    fits = (differ * (100 + percent) <= together * (100 - percent)) & (
        F.least("x.size", "y.size") * 100 >= F.greatest("x.size", "y.size") * percent
    )
    # A pair outside the main component is met from both ends: keep one of them.
    one_way = (F.col("y.root") == F.col("y.main")) | (F.col("x.set") < F.col("y.set"))
    left, right = known.where("root <> main").alias("x"), known.alias("y")
    meeting = left.join(right, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") != F.col("y.root")) & one_way & fits)
    return meeting.select(F.least("x.set", "y.set").alias("a"), F.greatest("x.set", "y.set").alias("b")).distinct()
