"""Page views hold the ids of what is on a page, not only their numbers."""

from coursewright.operators import book as B


def test_page_views_hold_ids(spark):
    contexts = spark.createDataFrame(
        [(1, 0, "none", None, 1), (1, 1, "a" * 300, "H", 2), (1, 2, "b", None, 1), (None, 1, "c", None, 1)],
        "doc_id long, page int, page_text string, heading string, n_nodes long",
    )
    on = lambda name, rows: spark.createDataFrame(rows, f"doc_id long, page int, {name}_id string")
    found = B.page_views(
        contexts, on("unit", [(1, 1, "1/4"), (1, 1, "1/0"), (1, 1, "1/4"), (1, 0, "1/9")]),
        on("annotation", [(1, 1, "a"), (1, 2, "b"), (1, 2, None)]), on("concept", [(1, 2, "y, z"), (1, 2, "x")]),
    )
    got = {
        (r.doc_id, r.page): (r.title, r.preview, r.full_text, r.unit_ids, r.annotation_ids, r.concept_ids, r.n_units, r.n_annotations, r.n_concepts)
        for r in found.collect()
    }
    assert got == {
        (1, 1): ("H", "a" * 280, "a" * 300, ["1/0", "1/4"], ["a"], [], 2, 1, 0),
        (1, 2): ("", "b", "b", [], ["b"], ["x", "y, z"], 0, 1, 2),
        (None, 1): ("", "c", "c", [], [], [], 0, 0, 0),
    }
