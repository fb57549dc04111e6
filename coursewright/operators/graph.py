"""The knowledge graph: typed vertices and edges, summaries and adjacency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Relation type to edge type.
EDGE_TYPES = {
    "prerequisite": "prerequisite", "contains": "contains", "relates_to": "references", "used_in": "references",
    "derived_from": "extends", "example_of": "illustrates",
}


def build_vertices(units: DataFrame, concepts: DataFrame) -> DataFrame:
    return units.select(
        "doc_id",
        F.col("unit_id").alias("vertex"),
        F.lit("unit").alias("node_type"),
        F.col("title").alias("label"),
        "difficulty",
        F.col("minutes").alias("minutes"),
    ).unionByName(
        concepts.select(
            "doc_id",
            F.col("concept_id").alias("vertex"),
            F.lit("concept").alias("node_type"),
            F.col("name").alias("label"),
            F.lit(None).cast("string").alias("difficulty"),
            F.lit(None).cast("long").alias("minutes"),
        )
    )


def drop_dangling_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    ends = vertices.select("doc_id", "vertex")
    return edges.join(ends.withColumnRenamed("vertex", "src"), ["doc_id", "src"], "left_semi").join(
        ends.withColumnRenamed("vertex", "dst"), ["doc_id", "dst"], "left_semi"
    )


def build_edges(units: DataFrame, prerequisites: DataFrame, unit_concepts: DataFrame, relations: DataFrame) -> DataFrame:
    """contains, depends_on, references and the mapped concept relations (ends not yet checked).

    ``prerequisites``: doc_id, unit_id, prerequisite_id.
    """
    mapping = F.create_map(*[F.lit(v) for kv in EDGE_TYPES.items() for v in kv])
    one = F.lit(1.0).alias("weight")
    parts = [
        units.where(F.col("parent_id").isNotNull()).select(
            "doc_id", F.col("parent_id").alias("src"), F.col("unit_id").alias("dst"), F.lit("contains").alias("edge_type"), one
        ),
        prerequisites.select(
            "doc_id", F.col("prerequisite_id").alias("src"), F.col("unit_id").alias("dst"), F.lit("depends_on").alias("edge_type"), one
        ),
        unit_concepts.select(
            "doc_id", F.col("unit_id").alias("src"), F.col("concept_id").alias("dst"), F.lit("references").alias("edge_type"), one
        ),
        relations.select(
            "doc_id",
            F.col("source_id").alias("src"),
            F.col("target_id").alias("dst"),
            F.try_element_at(mapping, F.col("relation_type")).alias("edge_type"),
            "weight",
        ).where(F.col("edge_type").isNotNull()),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def graph_summary(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Per document: sizes, counts by type, isolated vertices and average out-degree."""
    touched = edges.select("doc_id", F.explode(F.array("src", "dst")).alias("vertex")).distinct().withColumn("_hit", F.lit(1))
    sizes = vertices.join(touched, ["doc_id", "vertex"], "left").groupBy("doc_id").agg(
        F.count("*").alias("total_nodes"),
        F.count_if(F.col("node_type") == "unit").alias("unit_nodes"),
        F.count_if(F.col("node_type") == "concept").alias("concept_nodes"),
        F.count_if(F.col("_hit").isNull()).alias("isolated_nodes"),
    )
    kinds = sorted({"contains", "depends_on", *EDGE_TYPES.values()})
    links = edges.groupBy("doc_id").agg(
        F.count("*").alias("total_edges"), *[F.count_if(F.col("edge_type") == k).alias(f"{k}_edges") for k in kinds]
    )
    joined = sizes.join(links, "doc_id", "left").na.fill(0)
    return joined.withColumn("avg_out_degree", F.col("total_edges") / F.col("total_nodes"))


def adjacency_list(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Each vertex with its targets as ``label (edge type)``; vertices without edges stay."""
    names = vertices.select("doc_id", F.col("vertex").alias("dst"), F.col("label").alias("_target"))
    lines = edges.join(names, ["doc_id", "dst"]).select(
        "doc_id", F.col("src").alias("vertex"), F.concat("_target", F.lit(" ("), "edge_type", F.lit(")")).alias("line")
    )
    lists = lines.groupBy("doc_id", "vertex").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    out = vertices.join(lists, ["doc_id", "vertex"], "left")
    return out.select(
        "doc_id",
        "vertex",
        F.concat("label", F.lit(" ("), "node_type", F.lit(")")).alias("name"),
        F.coalesce(F.array_join("lines", "; "), F.lit("")).alias("targets"),
    )


def direct_prerequisites(edges: DataFrame) -> DataFrame:
    """One row per (lesson unit, predecessor); the list form is left to the sink."""
    rows = edges.where(F.col("edge_type").isin("depends_on", "prerequisite"))
    return rows.select("doc_id", F.col("dst").alias("unit_id"), F.col("src").alias("prerequisite_id")).distinct()
