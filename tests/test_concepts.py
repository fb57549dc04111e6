"""Concepts that share nodes: nodes with very many of them are dealt as tiles."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from coursewright.operators import concepts as C


def plain(rows, min_shared):
    nodes = {}
    for doc, concept, node in rows:
        nodes.setdefault((doc, node), set()).add(concept)
    shared = {}
    for (doc, _), held in nodes.items():
        for pair in combinations(sorted(held), 2):
            shared[doc, *pair] = shared.get((doc, *pair), 0) + 1
    return {(d, a, b, "relates_to", min(1.0, n / 4)) for (d, a, b), n in shared.items() if n >= min_shared}


@pytest.fixture(scope="module")
def rows():
    # One node holds a third of all links; the others share a few concepts with it and each other.
    hot = [(1, f"c{i}", "hot") for i in range(150)]
    rest = [(1, f"c{i * i % 40}", f"n{i % 60}") for i in range(400)] + [(2, f"c{i % 9}", f"n{i % 5}") for i in range(45)]
    return sorted({*hot, *rest})


@pytest.mark.parametrize(("min_shared", "tile"), [(1, 1), (1, 7), (1, 256), (2, 16), (3, 256)])
def test_pairs_whatever_the_tile(spark, rows, min_shared, tile):
    links = spark.createDataFrame(rows, "doc_id int, concept_id string, node_id string")
    got = [tuple(r) for r in C.concept_cooccurrence(links, min_shared, tile).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, min_shared)


def test_a_hot_node_is_spread(spark):
    links = spark.range(3000).select(F.lit(1).alias("doc_id"), F.md5(F.col("id").cast("string")).alias("concept_id"), F.lit("hot").alias("node_id"))
    assert C.concept_cooccurrence(links, 1, 100).count() == 3000 * 2999 // 2
    assert C.concept_cooccurrence(links, 2).count() == 0
    assert C.concept_cooccurrence(links.limit(0)).count() == 0


def test_merge_unites_the_lists(spark):
    rows = [
        (1, "Cell", "vocab", 0.5, 1, "n2", (0, 2), ["u2"], ["c"]), (1, "cell", "definition", 0.9, 2, "n1", (0, 1), ["u1", "u3"], []),
        (1, "CELL", "rule", 0.1, 4, None, (1, 0), ["u2", "u4"], ["C", "c", None]), (1, "cell", "skill", 0.2, 1, "n2", (0, 3), None, ["d"]),
        (1, "x", "fact", 0.3, 1, None, (1, 1), None, None), (2, "cell", "vocab", 0.4, 1, "n9", (0, 0), [], []),
    ]
    schema = "doc_id int, name string, category string, importance double, mentions long, node_id string, emit struct<s:int,o:int>, unit_ids array<string>, aliases array<string>"
    raw = spark.createDataFrame(rows, schema)
    got = {(r.doc_id, r.name, r.category, r.mentions, r.importance): (r.node_ids, r.unit_ids, r.aliases) for r in C.merge_concepts(raw).collect()}
    assert got == {
        (1, "cell", "definition", 8, 0.9): (["n1", "n2"], ["u1", "u3", "u2", "u4"], ["c", "d", "C"]),
        (1, "x", "fact", 1, 0.3): ([], [], []), (2, "cell", "vocab", 1, 0.4): (["n9"], [], []),
    }
    plain = {(r.doc_id, r.name): (r.node_ids, r.unit_ids, r.aliases) for r in C.merge_concepts(raw.drop("unit_ids", "aliases")).collect()}
    assert plain == {(1, "cell"): (["n1", "n2"], [], []), (1, "x"): ([], [], []), (2, "cell"): (["n9"], [], [])}
