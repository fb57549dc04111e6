"""The knowledge graph of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursewright.operators import concepts as C
from coursewright.operators import graph as G
from coursewright.operators import quality as D
from coursewright.operators import sequence as Q
from coursewright.operators import trees as R
from coursewright.plans import concepts as PC
from coursewright.plans.structure import nodes
from coursewright.plans.units import unit_nodes, units
from coursewright.session import stage
from coursewright.sources.nodes import scan_text_nodes
from coursewright.sources.sinks import write_graph_tables
from coursewright.sources.tables import runs, table
from coursewright.streaming.streams import new_folder


def numbered(placed):
    return Q.ordinal(placed.select("doc_id", "unit_id", "seq"), ["doc_id"], "seq", "k")


def prerequisites(placed):
    """Every second unit needs the one k % 3 + 1 places before it."""
    n = stage(numbered(placed))
    wanted = n.where(F.col("k") % 2 == 0).select("doc_id", "unit_id", (F.col("k") - 1 - F.col("k") % 3).alias("k"))
    return wanted.join(n.select("doc_id", "k", F.col("unit_id").alias("prerequisite_id")), ["doc_id", "k"]).drop("k")


def parts(s, sf):
    # Nodes and their units are derived once for units, concepts and the links between them.
    base = stage(nodes(s, sf))
    members = stage(unit_nodes(s, sf, base))
    placed = units(s, sf, members)
    raw = stage(C.concepts_from_annotations(PC.deduped(s, sf, base)))
    links = stage(C.concept_nodes(raw))
    concepts = C.merge_concepts(raw)
    vertices = G.build_vertices(placed, concepts)
    edges = G.build_edges(
        placed,
        prerequisites(placed),
        C.map_concepts_to_units(links, PC.members(s, sf, members)),
        C.concept_cooccurrence(links),
    )
    return stage(vertices), stage(G.drop_dangling_edges(edges, vertices))


def dangling(s, sf):
    """Edges whose concept ends are kept only for definitions."""
    vertices, edges = parts(s, sf)
    long = vertices.where((F.col("node_type") == "unit") | (F.length("label") > 12))
    return G.drop_dangling_edges(edges, long)


def knots(s, sf):
    """Lines pointing at the line numbered by their length: cycles and trees mixed."""
    lines = scan_text_nodes(table(s, sf, "documents"))
    edges = lines.select(
        "doc_id", F.col("seq").cast("long").alias("src"), (F.length("text") % 37).cast("long").alias("dst")
    ).where(F.col("src") != F.col("dst"))
    vertices = lines.select("doc_id", F.col("seq").cast("long").alias("vertex"))
    return R.acyclic_remainder(vertices, edges, ["doc_id"])


def is_dag(s, sf):
    return D.is_acyclic(knots(s, sf), table(s, sf, "documents"))


def graph_tables(s, sf):
    """The vertices as written and read again, with the number of edges that start there."""
    folder = new_folder(s, "graph")
    vertices, edges = parts(s, sf)
    write_graph_tables(vertices, edges, folder)
    starts = s.read.schema(edges.schema).parquet(f"{folder}/edges").groupBy("doc_id", F.col("src").alias("vertex")).agg(F.count("*").alias("n_out"))
    read = s.read.schema(vertices.schema).parquet(f"{folder}/vertices")
    return read.join(starts, ["doc_id", "vertex"], "left").na.fill(0, ["n_out"])


def artifact_counts(s, sf):
    base = nodes(s, sf)
    return D.artifact_counts(
        {
            "nodes": base,
            "headings": base.where(F.col("node_type") == "heading"),
            "pages": base.select("doc_id", "page").distinct(),
            "labels": table(s, sf, "labels"),
            "runs": runs(s, sf),
        }
    )


QUERIES = {
    "is_dag": is_dag,
    "artifact_counts": artifact_counts,
    "build_edges": lambda s, sf: parts(s, sf)[1].select("doc_id", "src", "dst", "edge_type", "weight"),
    "drop_dangling_edges": lambda s, sf: dangling(s, sf).select("src", "dst", "edge_type"),
    "write_graph_tables": graph_tables,
    "graph_summary": lambda s, sf: G.graph_summary(*parts(s, sf)),
    "adjacency_list": lambda s, sf: G.adjacency_list(*parts(s, sf)),
    "direct_prerequisites": lambda s, sf: G.direct_prerequisites(parts(s, sf)[1]).select("unit_id", "prerequisite_id"),
    "cycle_members": knots,
}
