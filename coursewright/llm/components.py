"""Connected components of an edge table, by joins and smallest values only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursewright.llm.staging import Stages


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b): root is the smallest node reachable.

    Each round every node, and the root it points at, takes the smallest root seen over an
    edge; then pointers skip one step (as in FastSV).  The rounds grow with the logarithm of
    the longest shortest path.  Every step is a join or a combinable minimum, so a node with
    very many links is spread; each round's labels are written to the shared folder, in as many
    files as the links call for.
    """
    stages = Stages(edges.sparkSession)
    both_ways = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = stages.keep("links", both_ways.where("a <> b").distinct())
    size = links.count()
    start = links.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root"))
    labels = stages.keep("round0", start, size)
    turn = 0
    while True:
        turn += 1
        seen = (
            links.join(labels.select(F.col("node").alias("b"), "root"), "b")
            .groupBy("a")
            .agg(F.min("root").alias("seen"))
            .select(F.col("a").alias("node"), "seen")
        )
        both = labels.join(seen, "node").select("node", "root", F.least("root", "seen").alias("best"))
        offers = both.select("node", "best", F.col("root").alias("old")).union(
            both.where("best < root").select(F.col("root").alias("node"), "best", F.lit(None).cast("long").alias("old"))
        )
        hooked = offers.groupBy("node").agg(F.min("best").alias("root"), F.max("old").alias("old"))
        hooked = stages.keep(f"hooked{turn}", hooked, size)
        jumped = hooked.join(hooked.select(F.col("node").alias("root"), F.col("root").alias("next")), "root")
        after = stages.keep(f"round{turn}", jumped.select("node", F.least("root", "next").alias("root"), "old"), size)
        stages.drop(f"hooked{turn}", f"round{turn - 1}")
        labels = after.select("node", "root")
        if after.where("root <> old").isEmpty():
            stages.drop("links")
            return labels
