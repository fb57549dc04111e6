"""Merkle manifest of a table: digests of rows, runs and groups, with a proof for each row.

Nodes are labelled with the interval of leaf ranks that they cover.  A tree has levels of runs of
``FAN`` nodes; the intervals of a level nest in those of the next, so ancestors are found by
containment joins, bucketed by level, and siblings by taking a node's interval out of its parent's.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursewright.llm.staging import Stages

#: Nodes in a row that become one of the next level.
FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_EMPTY_PATH = "CAST(array() AS array<struct<before:string,after:string>>)"


def digest(*parts: Column) -> Column:
    """H: lower-case hex SHA-256 of the parts in a row."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest(*map(field, values))


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` (level by level) give."""
    return F.aggregate(path, leaf, lambda acc, level: digest(level["before"], acc, level["after"]))


def siblings(path: Column) -> Column:
    """The digests of all siblings in a row, level by level, left to right."""
    return F.array_join(F.transform(path, lambda level: F.concat(level["before"], level["after"])), "")


def _ranked(stages: Stages, name: str, rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (tree, ...) as leaves: lo, hi, their rank in the tree from 0 by ``order``, and n, its leaves.

    Rows are dealt by ranges, numbered within a range as they are written, and shifted by what
    the ranges before hold of the tree; a tree may span any number of ranges.  Rows equal in
    ``order`` are spread by their place in the input, so a repeated row is no hot key.
    """
    spread = rows.withColumn("spread", F.monotonically_increasing_id())
    dealt = spread.repartitionByRange("tree", *order, "spread").sortWithinPartitions("tree", *order, "spread").drop("spread")
    written = stages.keep(name, dealt.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    held = written.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("held"), F.min("at").alias("low"))
    tree = Window.partitionBy("tree")
    before = F.sum("held").over(tree.orderBy("part")) - F.col("held")
    shifts = held.select(
        F.col("tree").alias("of"), F.col("part").alias("in"), (F.col("low") - before).alias("shift"), F.sum("held").over(tree).alias("n")
    )
    shifts = stages.keep(f"{name}-shifts", shifts)
    met = written.join(shifts, F.col("tree").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    lo = F.col("at") - F.col("shift")
    return met.withColumns({"lo": lo, "hi": lo + 1}).drop("at", "part", "of", "in", "shift")


def _climb(stages: Stages, name: str, leaves: DataFrame) -> list[DataFrame]:
    """The levels of all trees, leaves first: (tree, n, lo, hi, digest, members), members being the nodes of the run."""
    most = leaves.agg(F.max("n")).first()[0] or 1
    levels, width = [leaves], 1
    while width < most:
        below = levels[-1].where(F.col("n") > width)
        width *= FAN
        runs = below.groupBy("tree", "n", F.expr(f"lo div {width}").alias("run")).agg(
            F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("members")
        )
        node = runs.select(
            "tree",
            "n",
            F.col("members")[0]["lo"].alias("lo"),
            F.element_at("members", -1)["hi"].alias("hi"),
            digest(F.array_join(F.transform("members", lambda m: m["digest"]), "")).alias("digest"),
            "members",
        )
        levels.append(stages.keep(f"{name}-{len(levels)}", node))
    return levels


def _tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest): the node of each tree that covers all of its leaves."""
    found = None
    for k, level in enumerate(levels):
        top = level.where(F.col("n") <= FAN**k).select("tree", "digest")
        found = top if found is None else found.unionByName(top)
    return found


def _descend(levels: list[DataFrame], given: DataFrame) -> DataFrame:
    """The leaves with ``path``, the siblings from their level up, and what ``given`` has for their tree.

    ``given`` (tree, path, ...) continues the path above the top of a tree.  A node meets the
    node of the next level whose interval holds its own, by (tree, bucket of that level).
    """
    carried = [c for c in given.columns if c not in ("tree", "path")]
    own = given.select(F.col("tree").alias("of"), F.col("path").alias("above"), *[F.col(c).alias(f"got_{c}") for c in carried])
    met = None
    for k in range(len(levels) - 1, -1, -1):
        width = FAN**k
        level = levels[k].withColumn("is_top", F.col("n") <= width)
        top = level.where("is_top").join(own, F.col("tree").eqNullSafe(F.col("of")), "inner")
        top = top.withColumnRenamed("above", "path").drop("of", "is_top")
        if met is not None:
            bucket = f"lo div {width * FAN}"
            parents = met.select(
                F.col("tree").alias("of"), F.expr(bucket).alias("in"), F.col("lo").alias("from"), F.col("hi").alias("to"),
                F.col("members").alias("within"), F.col("path").alias("above"), *[f"got_{c}" for c in carried],
            )
            children = level.where("NOT is_top").withColumn("bucket", F.expr(bucket))
            holds = (F.col("from") <= F.col("lo")) & (F.col("hi") <= F.col("to"))
            inner = children.join(parents, F.col("tree").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in")) & holds)
            join = lambda nodes: F.array_join(F.transform(nodes, lambda m: m["digest"]), "")
            beside = F.struct(
                join(F.filter("within", lambda m: m["hi"] <= F.col("lo"))).alias("before"),
                join(F.filter("within", lambda m: m["lo"] >= F.col("hi"))).alias("after"),
            )
            inner = inner.withColumn("path", F.concat(F.array(beside), F.col("above")))
            top = top.unionByName(inner.drop("of", "in", "from", "to", "within", "above", "bucket", "is_top"))
        met = top
    return met.withColumnsRenamed({f"got_{c}": c for c in carried})


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", key: str = "doc_id", carry: Mapping[str, Column] | None = None
) -> DataFrame:
    """(key, leaf, carried columns, rank, n, subroot, root, path) for each row of ``docs``.

    ``leaf`` is the digest of ``fields``.  The leaves of a group ascend by ``key`` (null first, then by
    leaf; a repeated row is a leaf of its own) and every ``FAN`` nodes in a row become one until
    one is left, the group's ``subroot``; a lone leaf is its own.  Subroots by group (null first,
    then by UTF-8 bytes) give ``root`` in the same way.  ``rank`` and ``n`` are the leaf's place in its
    group and the group's size; ``path`` has the siblings of each level, from the leaf's to the
    root's, as digests before and after.  ``fold`` and ``siblings`` read it.

    ``carry`` names more columns, by expressions over ``docs``; one with a name of the result is
    refused.  Other columns of ``docs`` take no part.  An empty table gives no rows.
    """
    carry = dict(carry or {})
    if clash := {key, "leaf", "rank", "n", "subroot", "root", "path"} & set(carry):
        raise ValueError(f"carried columns {sorted(clash)} are names of the result")
    stages = Stages(docs.sparkSession)
    kept = F.struct(F.lit(0).alias("none"), *[c.alias(f"c{i}") for i, c in enumerate(carry.values())])
    rows = docs.select(
        F.col(group).cast("string").alias("tree"), F.col(key).alias("key"), leaf_digest(*[F.col(c) for c in fields]).alias("digest"), kept.alias("kept")
    )
    leaves = stages.keep("leaves", _ranked(stages, "ranges", rows, ["key", "digest"]))
    stages.drop("ranges", "ranges-shifts")
    levels = _climb(stages, "level", leaves)
    subroots = _tops(levels).select(F.lit(0).alias("whole"), F.col("tree").alias("group"), F.col("digest").alias("node"))
    ranked = _ranked(stages, "groups", subroots.select(F.col("whole").alias("tree"), "group", F.col("node").alias("digest")), ["group"])
    upper = _climb(stages, "upper", stages.keep("subroots", ranked))
    start = _tops(upper).select("tree", F.expr(_EMPTY_PATH).alias("path"), F.col("digest").alias("root"))
    groups = _descend(upper, start).select(F.col("group").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    found = _descend(levels, stages.keep("paths", groups))
    return found.select(
        F.col("key").alias(key),
        F.col("digest").alias("leaf"),
        *[F.col(f"kept.c{i}").alias(name) for i, name in enumerate(carry)],
        F.col("lo").alias("rank"),
        "n",
        "subroot",
        "root",
        "path",
    )
