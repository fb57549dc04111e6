"""Parent-pointer trees: closures, roll-ups, pre-order numbers and cycle repair."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursewright.operators import sequence as Q
from coursewright.session import cut_lineage, stage


def closure(nodes: DataFrame, keys: Sequence[str], node: str, parent: str, max_depth: int | None) -> DataFrame:
    """(keys, node, ancestor, distance) including the node itself at distance 0.

    With a known depth the joins are unrolled and stay lazy; a node deeper than that fails
    the query, so no ancestor is left out.  With ``None`` rounds run until no pointer is left,
    each cut by a reliable checkpoint.
    """
    keys = list(keys)
    up = nodes.select(*keys, F.col(node).alias("ancestor"), F.col(parent).alias("_up")).where(F.col("_up").isNotNull())
    level = nodes.select(*keys, F.col(node).alias("node"), F.col(node).alias("ancestor"), F.lit(0).alias("distance"))
    out = [level]
    step = 0
    while max_depth is None or step < max_depth:
        step += 1
        level = level.join(up, [*keys, "ancestor"]).select(
            *keys, "node", F.col("_up").alias("ancestor"), F.lit(step).alias("distance")
        )
        if max_depth is None:
            level = cut_lineage(level)
            if level.isEmpty():
                break
        out.append(level)
    if max_depth is not None:
        # The message names both sides, so the test is not moved below the join.
        place = F.concat_ws(" below ", F.col("node").cast("string"), F.col("_up").cast("string"))
        deeper = F.raise_error(F.concat(F.lit(f"deeper than {max_depth}: "), place)).cast("boolean")
        out.append(
            level.join(up, [*keys, "ancestor"]).where(deeper).select(*keys, "node", F.col("_up").alias("ancestor"), F.lit(step + 1).alias("distance"))
        )
    return reduce(lambda a, b: a.unionByName(b), out)


def children_of(nodes: DataFrame, keys: Sequence[str], node: str, parent: str) -> DataFrame:
    """Number of children and the first child by ``seq`` of every node."""
    counted = nodes.where(F.col(parent).isNotNull()).groupBy(*keys, F.col(parent).alias(node)).agg(
        F.count("*").alias("n_children"), F.min_by(node, "seq").alias("first_child")
    )
    return nodes.select(*keys, node, parent).join(counted, [*keys, node], "left").na.fill(0, ["n_children"])


def preorder(nodes: DataFrame, keys: Sequence[str], node: str, parent: str, order: str, tree: DataFrame) -> DataFrame:
    """Depth-first position and depth of every node; siblings go by integer ``order``.

    A node's position is the sum, over itself and its ancestors, of one plus the sizes
    of earlier siblings' subtrees: three aggregations, no task holding a whole tree.
    """
    keys = list(keys)
    sizes = tree.groupBy(*keys, F.col("ancestor").alias(node)).agg(F.count("*").alias("_size"))
    base = nodes.select(*keys, node, F.coalesce(parent, F.lit("")).alias("_p"), order).join(sizes, [*keys, node])
    shifted = Q.scan(base, [*keys, "_p"], order, {"_shift": ("sum", F.col("_size"), False)})
    steps = shifted.select(*keys, F.col(node).alias("ancestor"), (F.col("_shift") + 1).alias("_step"))
    return (
        tree.join(steps, [*keys, "ancestor"])
        .groupBy(*keys, F.col("node").alias(node))
        .agg((F.sum("_step") - 1).alias("position"), F.max("distance").alias("depth"))
    )


def repair_parents(nodes: DataFrame, keys: Sequence[str], node: str, parent: str, order: str) -> DataFrame:
    """Unknown parents become null and one link of every parent cycle is cut.

    The link cut is the one a walk from the last node (by ``order``) reaching the cycle
    meets first.  Pointer jumping: nodes whose pointer runs off a root drop out each
    round, so what is left after log2(depth) rounds are cycles and their tails.
    """
    keys = list(keys)
    known = nodes.select(*keys, F.col(node).alias(parent), F.lit(True).alias("_known"))
    linked = nodes.join(known, [*keys, parent], "left").select(
        *[c for c in nodes.columns if c != parent], F.when(F.col("_known"), F.col(parent)).alias(parent)
    )
    links = cut_lineage(linked.where(F.col(parent).isNotNull()).select(*keys, node, parent, order))

    def jump(left: DataFrame, right: DataFrame) -> DataFrame:
        r = right.select(*keys, F.col("_v").alias("_ptr"), F.col("_ptr").alias("_next"), F.col("_low").alias("_low2"))
        return left.join(r, [*keys, "_ptr"]).select(
            *keys, "_v", F.col("_next").alias("_ptr"), F.least("_low", "_low2").alias("_low")
        )

    walk = cut_lineage(links.select(*keys, F.col(node).alias("_v"), F.col(parent).alias("_ptr"), F.col(node).alias("_low")))
    reach = 1
    while True:
        # Inner join: a pointer at a root has no next, so the row drops out.
        left = walk.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        if left == 0 or reach > left:
            break
        walk = cut_lineage(jump(walk, walk))
        reach *= 2
    # Every survivor now points into its cycle, and every cycle node is pointed at;
    # ``_low`` of a cycle node is the least id of its cycle.
    members = walk.select(*keys, F.col("_ptr").alias("_v")).distinct().join(walk, [*keys, "_v"]).select(
        *keys, F.col("_v").alias("_ptr"), F.col("_low").alias("_cycle")
    )
    inside = cut_lineage(members)
    lost = links.join(walk.select(*keys, F.col("_v").alias(node)), [*keys, node], "left_semi")
    # Entry of each survivor: itself when in a cycle, else follow parents until one is.
    entry = lost.join(inside.withColumnRenamed("_ptr", node), [*keys, node], "left").select(
        *keys, F.col(node).alias("_v"), order,
        F.when(F.col("_cycle").isNotNull(), F.col(node)).otherwise(F.col(parent)).alias("_ptr"),
    )
    hop = cut_lineage(
        lost.join(inside.withColumnRenamed("_ptr", node), [*keys, node], "left").select(
            *keys, F.col(node).alias("_ptr"),
            F.when(F.col("_cycle").isNotNull(), F.col(node)).otherwise(F.col(parent)).alias("_next"),
        )
    )
    reach = 1
    while left and reach <= left:
        entry = cut_lineage(
            entry.join(hop, [*keys, "_ptr"]).select(*keys, "_v", order, F.col("_next").alias("_ptr"))
        )
        twice = hop.select(*keys, F.col("_ptr").alias("_next"), F.col("_next").alias("_next2"))
        hop = cut_lineage(hop.join(twice, [*keys, "_next"]).select(*keys, "_ptr", F.col("_next2").alias("_next")))
        reach *= 2
    cuts = (
        entry.join(inside, [*keys, "_ptr"])
        .groupBy(*keys, "_cycle")
        .agg(F.max_by("_ptr", order).alias(node))
        .select(*keys, node, F.lit(True).alias("_cut"))
    )
    return linked.join(cuts, [*keys, node], "left").select(
        *[c for c in nodes.columns if c != parent], F.when(F.col("_cut").isNull(), F.col(parent)).alias(parent)
    )


def _roots(pointers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, vertex, root, looped): where the pointers (keys, vertex, ptr) of each vertex end, by pointer jumping.

    ``looped`` rows run into a cycle of pointers; after n jumps of doubled reach no other still moves.
    """
    most = pointers.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    walk, reach = pointers.select(*keys, "vertex", "ptr"), 1
    while reach <= most:
        onward = walk.select(*keys, F.col("vertex").alias("ptr"), F.col("ptr").alias("next"))
        walk = stage(
            walk.join(onward, [*keys, "ptr"], "left").select(
                *keys, "vertex", F.coalesce("next", "ptr").alias("ptr"), F.col("next").isNotNull().alias("moved")
            )
        )
        reach *= 2
        if walk.where("moved").isEmpty():
            break
        walk = walk.drop("moved")
    ends = walk.select(*keys, "vertex", F.col("ptr").alias("root"))
    inside = pointers.select(*keys, F.col("vertex").alias("root"), F.lit(True).alias("looped"))
    return ends.join(inside, [*keys, "root"], "left").select(*keys, "vertex", "root", F.coalesce("looped", F.lit(False)).alias("looped"))


def acyclic_remainder(vertices: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Vertices on a cycle or reached from one: what is left when those without incoming edges are peeled.

    A graph is acyclic when nothing is left.  ``edges`` has (keys, src, dst).  A vertex with one
    predecessor shares its fate, so each round merges it into the end of its chain of single
    predecessors, found by pointer jumping, and drops the edges of vertices without any.  Chains
    and trees of any depth take one round of logarithmic jumps; only vertices that keep two
    predecessors or more take a round a layer.  A cycle becomes an edge from a vertex to itself.
    """
    keys = list(keys)
    live = stage(edges.select(*keys, "src", "dst").distinct())
    merged = []
    while True:
        own = F.col("src") == F.col("dst")
        targets = stage(
            live.groupBy(*keys, F.col("dst").alias("vertex")).agg(
                F.max(own).alias("loop"), F.count(F.lit(1)).alias("n"), F.min("src").alias("ptr")
            )
        )
        known = targets.select(*keys, F.col("vertex").alias("src"))
        if live.join(known, [*keys, "src"], "left_anti").isEmpty():
            break  # every vertex left has a predecessor that is left
        single = (F.col("n") == 1) & ~F.col("loop")
        ends = stage(_roots(targets.where(single), keys))
        merged.append(ends.where("NOT looped"))
        into = ends.where("NOT looped").select(*keys, F.col("vertex").alias("src"), "root")
        several = targets.where(~single).select(*keys, F.col("vertex").alias("dst"), "loop")
        moved = live.join(known, [*keys, "src"], "left_semi").join(several, [*keys, "dst"]).join(into, [*keys, "src"], "left")
        start = F.when(F.col("loop"), F.col("dst")).otherwise(F.coalesce("root", "src"))
        loops = ends.where("looped").select(*keys, F.col("vertex").alias("src"), F.col("vertex").alias("dst"))
        live = stage(moved.select(*keys, start.alias("src"), "dst").unionByName(loops).distinct())
    stuck = targets.select(*keys, "vertex")
    for ends in reversed(merged):
        after = ends.join(stuck.select(*keys, F.col("vertex").alias("root")), [*keys, "root"], "left_semi")
        stuck = stuck.unionByName(after.select(*keys, "vertex"))
    return vertices.join(stuck, [*keys, "vertex"], "left_semi")
