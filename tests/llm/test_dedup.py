"""Line, near and substring deduplication against plain versions."""

import hashlib
import random

import brute
import pytest
from pyspark.sql import functions as F

from coursewright.llm import components, line_dedup, near_dedup, queries, staging, substring_dedup

SCHEMA = "doc_id long, text string"


def documents(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def near(spark, rows, size=2):
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), size=size).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}


@pytest.fixture(scope="module")
def copies():
    """A large group of near copies, chains of near copies, exact copies, periodic and short texts."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = []
    base = text(120)
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows.append(" ".join(copy))
    step = text(100)
    for k in range(12):
        rows.append(" ".join(step))
        step = step[4:] + text(4)
    rows += [" ".join(text(80))] * 7 + ["one", "One", "one two", "", " \t", "a " * 200, "a " * 150, "a b " * 70, "a b " * 90]
    rows += [" ".join(text(60)) for _ in range(30)]
    passage = " ".join(text(70))
    rows += [f"{' '.join(text(20))} {passage} {' '.join(text(15))}" for _ in range(15)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_on_made_cases(spark, copies):
    assert near(spark, copies) == brute.near_duplicates(copies, 2)


def test_near_query(spark, sf):
    rows = queries.QUERIES["op7_near_dedup"](spark, sf).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert got == brute.near_duplicates(documents(spark, sf), 2)


def test_near_edges(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (5, text), (5, "other words here"), (3, "other words here"), (None, None), (7, None), (7, "")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).withColumn("set", F.lit(1))).collect()
    found = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in got)
    assert found == [(-1, 0, -1, True), (-1, 36, 3, False), (3, 1, 3, True), (5, 1, 3, False), (5, 36, 3, False), (7, 0, 7, True), (7, 0, 7, True)]
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = near_dedup.near_duplicates(spark.createDataFrame([(None, "a b c d e f")], SCHEMA)).first()
    assert (alone.doc_id, alone.component_id, alone.kept) == (None, None, True)


def test_half_keys_meet_above_the_threshold():
    import numpy as np

    rng = np.random.default_rng(3)
    met = 0
    for _ in range(200):
        both, a, b = (np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (800, 100, 100))
        one, two = np.union1d(both, a), np.union1d(both, b)
        x, y = (near_dedup.half_keys(s, np.asarray([0, len(s)]))[0] for s in (one, two))
        same = x == y
        met += same[: near_dedup.HALVES].any() and same[near_dedup.HALVES :].any()
    assert met >= 199


def test_narrow_steps_write_few_files(spark, monkeypatch):
    """Rounds over a few links write a file each, however many shuffle partitions there are; more rows take more files."""
    written = []

    def keep(self, name, df, *size, known=staging.Stages.keep):
        out = known(self, name, df, *size)
        written.append((name, len(out.inputFiles()), out.count()))
        return out

    monkeypatch.setattr(staging.Stages, "keep", keep)
    held = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        edges = [(i, i + 1) for i in range(100, 160) if i != 130] + [(7, i) for i in range(200, 260)] + [(3, 3)]
        roots = components.components(spark.createDataFrame(edges, "a long, b long"))
        want = {i: 100 if i <= 130 else 131 for i in range(100, 161)} | {i: 7 for i in (7, *range(200, 260))}
        assert {r.node: r.root for r in roots.collect()} == want
        rounds = [w for w in written if w[0] != "links"]
        assert len(rounds) > 2 and all(files == 1 and n == len(want) for _, files, n in rounds)
        monkeypatch.setattr(staging, "FILE_ROWS", 50)
        many = staging.Stages(spark).keep("many", spark.range(0, 200, 1, 24), 200)
        assert sorted(r.id for r in many.collect()) == list(range(200)) and len(many.inputFiles()) == 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def substring(spark, rows, window=50):
    out = substring_dedup.substring_dedup(spark.createDataFrame(rows, SCHEMA), window).collect()
    return sorted((r.doc_id, r.word_count, brute.words_of(r.text)) for r in out)


@pytest.mark.parametrize("window", [50, 12])
def test_substring_on_made_cases(spark, copies, window):
    assert substring(spark, copies, window) == sorted(brute.substring_dedup(copies, window))


def test_substring_query(spark, sf):
    got = queries.QUERIES["op8_substring_dedup"](spark, sf).collect()
    want = brute.substring_dedup(documents(spark, sf))
    digest = lambda ws: hashlib.sha256(" ".join(ws).encode()).hexdigest()
    assert sorted((r.doc_id, r.n_words, r.n_words - r.n_removed, r.kept_sha256) for r in got) == sorted(
        (i, n, len(ws), digest(ws)) for i, n, ws in want
    )


def test_substring_edges(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [
        (1, f"a\n{passage}\nb", "x"), (2, f"c  {passage}\n\nd\n", "y"), (2, f"e {passage}", None), (None, passage, "z"),
        (3, None, None), (4, "", ""), (5, passage, "w"), (5, passage, "w"), (6, f"é {passage[:-1]}", "v"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumn("hash", F.lit(1)).withColumn("removed_count", F.lit("old"))
    out = substring_dedup.substring_dedup(docs)
    assert out.columns == ["doc_id", "text", "key", "hash", "word_count", "removed_count"]
    got = sorted(((r.doc_id or -1), r.text, r.key, r.removed_count) for r in out.collect() if r.text is not None)
    assert got == sorted(
        [(1, "a\nb", "x", 50), (2, "c  d\n", "y", 50), (2, "e ", None, 50), (-1, passage, "z", 0), (4, "", "", 0), (5, "", "w", 50), (5, "", "w", 50), (6, rows[-1][1], "v", 0)]
    )
    assert [r.removed_count for r in out.where("text IS NULL").collect()] == [0]
    assert substring_dedup.substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lines_on_made_cases(spark):
    rng = random.Random(9)
    line = lambda: rng.choice(["a", "b", " c", "d ", "", "  ", "long line of words", "four more  of them", "one line that has more than eight words in it"])
    rows = [(i, "\n".join(line() for _ in range(rng.randrange(1, 14)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "a\nb"), (203, "\n".join("z" * 9)), (204, "\n".join(["z"] * 50))]
    docs = spark.createDataFrame(rows, SCHEMA)
    for size, words in [(3, 8), (2, 5), (4, 100), (1, 1)]:
        got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs, size, words).collect()}
        assert got == brute.line_dedup(rows, size, words)


def test_a_run_whose_fingerprint_comes_first_elsewhere(spark):
    """All three lines of a later run go although each line stands first in another surrounding."""
    rows = [(1, "a b\nx\nc d"), (2, "p\nx\nq"), (3, "x\nq\nc d\np"), (4, "k\np\nx\nq\nl"), (5, "q\nc d\np")]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute.line_dedup(rows) == {1: rows[0][1], 2: rows[1][1], 3: rows[2][1], 4: "k\nl", 5: ""}


def test_short_documents_are_cut(spark):
    """One or two lines are a run if they hold eight words; a very long line counts as any other."""
    long = "word " * 300_000
    rows = [(1, "a line of eight words or a few more"), (2, "own\na line of eight words or a few more"), (3, "too short"), (4, "too short")]
    rows += [(5, long), (6, f"own\n{long}"), (7, "four words and more\nand these four too"), (8, "four words and more\nand these four too")]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: rows[0][1], 2: "own", 3: "too short", 4: "too short", 5: long, 6: "own", 7: rows[6][1], 8: ""}


def test_lines_edges(spark):
    run = "one\ntwo\nthree"
    rows = [(None, run, 1), (1, f"x\n{run}\ny", 2), (2, run, 3), (2, run, 4), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, version int").withColumn("lines", F.lit("kept"))
    out = line_dedup.line_dedup(docs)
    assert out.columns == ["doc_id", "text", "version", "lines", "line_count", "removed_count"]
    got = sorted((r.version or 0, r.text, r.line_count, r.removed_count, r.lines) for r in out.collect() if r.text is not None)
    assert got == [(1, run, 3, 0, "kept"), (2, "x\ny", 5, 3, "kept"), (3, "", 3, 3, "kept"), (4, "", 3, 3, "kept")]
    assert line_dedup.line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_rows_are_reduced_before_their_windows_are_gathered(spark):
    passage = "\n".join(f"p{i} of the line" for i in range(30))
    rows = [(1, passage), (3, "other")] + [(2, f"own {passage}\nend")] * 40
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    plan = lambda df: df._jdf.queryExecution().toString()
    lines = line_dedup.line_dedup(docs)
    assert "partial_collect_set(at" in plan(lines) and "collect_list" not in plan(lines)
    assert sorted({(r.doc_id, r.text, r.removed_count) for r in lines.collect()}) == [(1, passage, 0), (2, "own p0 of the line\nend", 29), (3, "other", 0)]
    cut = substring_dedup.substring_dedup(docs)
    assert "partial_collect_set(at" in plan(cut) and "collect_list" not in plan(cut)
    assert sorted({(r.doc_id, r.text, r.removed_count) for r in cut.collect()}) == [(1, passage, 0), (2, "own end", 120), (3, "other", 0)]
    assert lines.count() == cut.count() == 42


def test_columns_with_the_names_of_helpers_are_kept(spark):
    from coursewright.llm import language

    run = "one is a\ntwo is a\nthree is a"
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, run, "en"), (2, f"{run}\nend", "en"), (3, passage, "de"), (4, f"own {passage}", "de"), (5, None, None)]
    names = ["_lines", "_left", "_version", "_gone", "_GONE_id", "_gone_version", "_copy", "_key", "_key2", "_version2", "_lettered", "__gone"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    extra = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    model = language.fit(docs)
    for step in (line_dedup.line_dedup, substring_dedup.substring_dedup, lambda d: language.identify(d, model)):
        got = step(extra)
        assert [c for c in got.columns if c in extra.columns] == extra.columns
        assert all(r[n] == f"{n}{r.doc_id}" for r in got.collect() for n in names)
        plain = sorted(map(str, step(docs).collect()))
        assert sorted(map(str, got.select(*step(docs).columns).collect())) == plain
