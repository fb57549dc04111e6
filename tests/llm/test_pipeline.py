"""The pipeline against the plain versions of its stages, and each stage's effect."""

import base64

import brute
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from coursewright.llm import language


def library():
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rebuilt(rows):
    """Each document's ids from the sequences; every segment checked on the way."""
    parts = {}
    for r in rows:
        at = 0
        for g in r.segments:
            assert g.offset == at and g.length > 0
            at += g.length
            parts.setdefault(g.doc_id, []).append((g.piece, g.start, r.ids[g.offset : at]))
        assert at == len(r.ids) == r.n_tokens <= r.capacity
    out = {}
    for i, cut in parts.items():
        ids = []
        for k, (piece, start, held) in enumerate(sorted(cut)):
            assert (piece, start) == (k, len(ids))
            ids += held
        out[i] = ids
    return out


def test_run_against_plain_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    named = corpus_pipeline.identify(spark, docs, sf)
    assert named.columns == docs.columns
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
    assert sorted((r.doc_id, r.text) for r in named.collect()) == rows
    cut = brute.line_dedup(rows)
    rows = [(i, cut[i]) for i, t in rows if cut[i] == t or cut[i].replace("\n", "").strip(" ")]
    kept = brute.near_duplicates(rows, 5)
    rows = [(i, t) for i, t in rows if kept[i][2]]
    left = {i: (n, ws) for i, n, ws in brute.substring_dedup(rows)}
    rows = [(i, left[i][1]) for i, _ in rows if left[i][1] or not left[i][0]]
    got = rebuilt(corpus_pipeline.run(spark, sf).collect())
    assert sorted(got) == [i for i, _ in rows]
    known = library()
    for i, ids in got.items():  # the cut text's words, in order, and one end mark after them
        assert ids[-1] == corpus_pipeline.END and corpus_pipeline.END not in ids[:-1]
        text = known.decode(ids[:-1])
        assert brute.words_of(text) == list(dict(rows)[i]) and known.encode_ordinary(text) == ids[:-1]


def test_stages_on_odd_rows(spark, sf):
    run = "eins und zwei\nder die das\nvier und fünf"
    rows = [
        (1, run, "de", "a", 1), (2, f"{run}\nund noch eine", "de", None, None), (3, run, None, "b", 2), (4, None, "de", "c", 0),
        (5, "123", "en", "d", 3), (None, "ohne namen ist der text", "de", "e", 5), (6, "the end of it", "en", "f", 6),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_gone", F.lit(1))
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, sf)
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
    got = sorted((r.doc_id or 0, r.text, r.lang, r.n_chars) for r in docs.collect())
    assert [g[:2] for g in got] == [(0, rows[5][1]), (1, run), (2, "und noch eine"), (6, "the end of it")]
    assert all(g[3] is None or g[3] in (1, len(g[1]), 5, 6) for g in got)
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    held = final.collect()
    assert sum(len(r.segments) for r in held) == 4 and sum(list(r.ids).count(corpus_pipeline.END) for r in held) == 4
    empty = docs.limit(0)
    for _, step in corpus_pipeline.STAGES:
        empty = step(spark, empty, sf)
    assert empty.count() == 0 and language.UNKNOWN == "und"


def test_language_stage_without_labels(spark, sf):
    rows = [(1, "der die das", None, "a", 1), (2, None, None, "b", 0), (3, "12 !", None, "c", 4), (4, "the end", None, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert language.fit(docs).families == []
    got = corpus_pipeline.identify(spark, docs, sf)
    assert sorted(tuple(r) for r in got.collect()) == [rows[0], rows[3]]
    # Labels on held-out rows only are kept as given.
    held = docs.withColumn("lang", F.when(language.held_out(), F.lit("xx")))
    assert held.where("lang = 'xx'").count() > 0
    want = sorted(tuple(r) for r in held.where("doc_id IN (1, 4)").collect())
    assert sorted(tuple(r) for r in corpus_pipeline.identify(spark, held, sf).collect()) == want


def test_near_stage_judges_rows(spark, sf):
    words = lambda a: " ".join(f"{a}{i}" for i in range(60))
    a, b, c = words("a"), words("b"), words("c")
    rows = [
        (1, a, "en", "y", 1), (1, a, "en", "x", 1), (1, a, "en", "x", 1),  # one row of these
        (2, a + " end", "en", "z", 1), (None, a + " fin", "en", "z", 1),  # near copies of it
        (5, a + " more", "en", "z", 1), (5, b, "en", "z", 1),  # the clean text of the id stays
        (None, c, "en", "z", 1), (None, c, "en", "z", 1), (None, c + " end", "en", "z", 1),  # one of these
        (6, "", "en", "z", 0), (6, "", "en", "z", 0), (7, None, "en", "z", 0),  # no words: no group
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near(spark, docs, sf)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    found = [tuple(r) for r in got.collect()]
    assert sorted(r for r in found if r[0] and r[1]) == [rows[1], rows[6]]
    assert [(r[0], r[1] in (c, c + " end")) for r in found if r[0] is None] == [(None, True)]
    assert sorted((r[0], r[1] or "") for r in found if not r[1]) == [(6, ""), (6, ""), (7, "")]
    # Unique ids: the smallest stays.
    unique = spark.createDataFrame([rows[3], rows[6], (9, a, "en", "z", 1)], docs.schema)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near(spark, unique, sf).collect()) == [2, 5]
