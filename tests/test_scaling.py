"""Steps that move or repeat less than they did: same rows, other plans."""

from collections import Counter

from pyspark.sql import functions as F

from coursewright.functions import text as X
from coursewright.operators import annotate as A
from coursewright.operators import layout as L
from coursewright.operators import progress as P
from coursewright.operators import search as I
from coursewright.operators import structure as S
from coursewright.plans import layout as PL
from coursewright.session import shared_folder
from coursewright.sources.sinks import write_files


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_initial_progress_joins_lists_of_learners(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 2)
    enrolments = spark.createDataFrame([(u, u % 2) for u in range(9)] + [(4, 0), (None, 1), (50, None), (51, 9)], "user_id long, unit_id long")
    sections = spark.createDataFrame([(1, 0, 5), (2, 0, 3), (3, 1, 1), (4, None, 1)], "section_id long, unit_id long, display_order long")
    items = spark.createDataFrame(
        [(1, "lesson", 10), (2, "lesson", 10), (2, "quiz", 11), (3, "practice", None), (3, "lesson", 12), (3, "lesson", 12), (4, "quiz", 1)],
        "section_id long, kind string, item_id long",
    )
    found = P.initial_progress(enrolments, sections, items)
    first = {0: 2, 1: 3}
    unit = {1: 0, 2: 0, 3: 1}
    expected = Counter(
        (u, n, s, k, i, None if k == "quiz" else "not_started" if first[n] == s else "locked")
        for u, n in [tuple(r) for r in enrolments.collect()] for s, k, i in [tuple(r) for r in items.collect()] if s in unit and unit[s] == n
    )
    assert Counter(map(tuple, found.collect())) == expected
    # The product is made from lists, past the last join.
    assert "explode(_users" in plan(found) and plan(found).index("explode(_users") < plan(found).index("Join")


def test_initial_progress_comes_list_by_list(spark, monkeypatch):
    monkeypatch.setattr(P, "RUN", 4, raising=False)
    monkeypatch.setattr(P, "STRIPS", 1)
    enrolments = spark.range(10).select(F.col("id").alias("user_id"), F.lit(1).cast("long").alias("unit_id"))
    sections = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "section_id long, unit_id long, display_order long")
    items = spark.range(60).select((F.col("id") % 2 + 1).alias("section_id"), F.lit("lesson").alias("kind"), F.col("id").alias("item_id"))
    rows = P.initial_progress(enrolments, sections, items).collect()
    assert len(set(rows)) == len(rows) == 600
    # An item's rows hold the learners of one list, and so do those of the next item: what is written repeats itself.
    lists = [len(set(r.user_id for r in rows[i : i + 20])) for i in range(0, 600, 20)]
    assert max(lists) <= 4
    assert len({tuple(r.user_id for r in rows if r.item_id == i) for i in range(60)}) == 1


def test_files_are_written_by_the_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i % 3}/n{i}.txt", bytearray([i]) * i) for i in range(40)], "name string, content binary")
    rows.toLocalIterator = None  # the driver must not take the rows
    write_files(rows, str(tmp_path / "files"))
    files = {str(p.relative_to(tmp_path / "files")): p.read_bytes() for p in (tmp_path / "files").rglob("*") if p.is_file()}
    assert files == {f"{i % 3}/n{i}.txt": bytes([i]) * i for i in range(40)}


def test_postings_need_no_shuffle(spark):
    texts = {1: "A b, a\U0001d4b3 A", 2: "", 3: None, 4: "  é-É  _x1 é ", 5: "..", 6: "one"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = I.postings(docs, "doc_id", "text")
    assert "Aggregate" not in plan(found) and "Window" not in plan(found)
    assert sorted(tuple(r) for r in found.collect() if r.term.isascii() or r.id != 1) == [
        ("_x1", 4, [8]), ("a", 1, [1, 9]), ("b", 1, [3]), ("one", 6, [1]), ("é", 4, [3, 5, 12]),
    ]


def test_detectors_run_once_a_node(spark):
    nodes = spark.createDataFrame(
        [(1, "1/0", 0, "paragraph", "A cell is a unit. Def: x\nStep"), (1, "1/1", 1, "paragraph", None), (1, "1/2", 2, "list", "x is y"),
         (1, "1/3", 3, "heading", "GOAL: run; EXAMPLE: it\tmeans all")],
        "doc_id long, node_id string, seq int, node_type string, text string",
    )
    a = A.Annotator().register("definition", A.detect_definitions).register("objective", A.detect_objectives)
    hits = a.register("example", A.detect_examples).run(nodes)
    assert plan(hits).count(A.DEFINITION) == 2  # the whole match and its body; a filter by size would double them
    got = {(r.node_id, r.type, r.term, r.body) for r in hits.collect()}
    assert ("1/0", "definition", "cell", "a unit") in got and ("1/0", "definition", "Def", "x") in got
    assert {k[1] for k in got if k[0] == "1/3"} == {"objective", "example", "definition"} and not any(k[0] in ("1/1", "1/2") for k in got)


def test_strip_takes_off_all_unicode_blanks(spark):
    texts = [f"{w} \n{w}a{w}b{w}\r\n{w}" for w in X.WS_CHARS] + ["", X.WS_CHARS, "a\n", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.strip(F.col("t")).alias("s")).collect()
    assert all(r.s == (None if r.t is None else r.t.strip()) for r in rows) and "regexp_replace" not in str(X.strip(F.col("t")))


def test_segments_read_their_lines_once(spark):
    rows = [(1, "n", i, i // 2, f" w{i} ", "Courier" if i < 2 else "Times", 9.0 + (i == 5), False) for i in range(6)] + [(1, "m", 0, 0, "x", "Times", 9.0, False)]
    lines = spark.createDataFrame(rows, "doc_id long, node_id string, line_no int, block long, text string, font string, size double, bold boolean")
    found = L.split_by_block_and_style(lines)
    assert "Window" not in plan(found)  # what the two readers share is stored
    assert sorted(map(tuple, found.collect())) == [
        (1, "n", 0, "w0", "Courier", 1), (1, "n", 1, "w1", "Courier", 1), (1, "n", 2, "w2 w3", "Times", 2),
        (1, "n", 4, "w4", "Times", 1), (1, "n", 5, "w5", "Times", 1),
    ]


def test_styles_are_found_by_page_and_in_strips(spark, monkeypatch):
    box = lambda k: (None if k % 13 == 12 else k % 4 / 4, None if k % 17 == 16 else k % 7 / 8, k % 4 / 4 + k % 3 / 5, None if k % 19 == 18 else k % 7 / 8 + k % 5 / 20)
    texts = ["a", "", None, "Abc d", "x", " abc ", "zq", "q"]
    nodes = [(d if d < 3 else None, k % 5 or None, f"{d}/{k % 40}", texts[k * k % 8], *box(k)) for d in range(4) for k in range(45)]
    spans = [(d if d < 3 else None, k % 5 or None, k // 10, k % 10, texts[k * 3 % 7], *box(3 * k + 1), f"f{k}", k / 2, k % 2 == 0) for d in range(4) for k in range(60)]
    n = spark.createDataFrame(nodes, "doc_id long, page int, node_id string, text string, x0 double, y0 double, x1 double, y1 double")
    s = spark.createDataFrame(spans, "doc_id long, page int, line_no int, node_seq int, text string, x0 double, y0 double, x1 double, y1 double, font string, size double, bold boolean")
    stored = []
    monkeypatch.setattr(L, "stage", lambda df, keep=L.stage: stored.append(df.columns) or keep(df))
    found = Counter(map(tuple, L.best_overlap_style(n, s, 0.01).collect()))
    assert sum(found.values()) == len(nodes) and len(found) > 20 and not any("_span" in c for c in stored)

    def best(doc, node):
        pairs = []
        for d, p, i, t, *b in nodes:
            for e, q, line, seq, u, x0, y0, x1, y1, *style in spans if (d, i) == (doc, node) and d is not None and p is not None else ():
                if (d, p) == (e, q):
                    low, high = (lambda *v: min(x for x in v if x is not None)), (lambda *v: max(x for x in v if x is not None))
                    pad = [v if v is None else v + (-0.01 if k < 2 else 0.01) for k, v in enumerate(b)]
                    w, h = low(pad[2], x1) - high(pad[0], x0) if (pad[0], x0) != (None, None) else None, None if None in (pad[1], pad[3], y0, y1) else min(pad[3], y1) - max(pad[1], y0)
                    area = w * h if w is not None and h is not None and w > 0 and h > 0 else 0
                    mine, other = (v if v is None else v.strip().lower() for v in (t, u))
                    same = False if mine == "" else None if mine is None or other is None else mine in other or other in mine
                    if area > 0:
                        pairs.append(((1, -1 if same is None else int(same), 0 if same else area, -line, -seq), style))
                    elif same and other != "":
                        pairs.append(((0, 1, 0, -line, -seq), style))
        return tuple(max(pairs)[1]) if pairs else (None, None, None)

    assert found == Counter((d, i, *best(d, i)) for d, _, i, *_ in nodes)
    monkeypatch.setattr(L, "CROWD", 8)  # some pages by strips
    assert Counter(map(tuple, L.best_overlap_style(n, s, 0.01).collect())) == found
    monkeypatch.setattr(L, "CROWD", 0)
    assert Counter(map(tuple, L.best_overlap_style(n, s, 0.01).collect())) == found


def test_lines_move_once_and_are_cut_in_place(spark, monkeypatch):
    rows = [
        (d, f"{d}/{n}", k, None if k % 11 == 10 else k * 7 % 30 // 12 + k // 9, [None, "", " a ", f"w{k}", "b"][(k + n) % 5],
         ["Courier", "DejaVu Mono", None, "Times"][(k // 4 + n) % 4 if n % 3 else k % 2], [9.0, 9.001, 10.0, None][(k * n) % 4], [True, False, None][n % 3 if k % 5 else 1])
        for d in (1, 2) for n in range(12) for k in range(3 * n)
    ] + [(None, "x", k, k, "t", "Times", 9.0, True) for k in range(3)] + [(1, "one", 4, 1, "t", "Times", 9.0, True)]
    lines = spark.createDataFrame(rows, "doc_id long, node_id string, line_no int, block int, text string, font string, size double, bold boolean")
    stored = []
    monkeypatch.setattr(L, "stage", lambda df, keep=L.stage: stored.append(df.columns) or keep(df))
    short = Counter(map(tuple, L.split_by_block_and_style(lines).collect()))
    assert short and not any("text" in c for c in stored)
    monkeypatch.setattr(L.Q, "BLOCK_ROWS", 4)  # by the scans
    assert Counter(map(tuple, L.split_by_block_and_style(lines).collect())) == short
    assert any("text" in c for c in stored)


def test_cells_are_folded_once(spark):
    cells = spark.createDataFrame([(t, r, c, f"{r}{c}", r == 1) for t in (1, 2) for r in range(3) for c in range(r + 1)], "table_id long, row_index int, col_index int, text string, is_header boolean")
    found = S.cells_to_rows(cells)
    assert "collect_list" not in plan(found)
    assert {tuple(r) for r in found.where("table_id = 1").collect()} == {
        (1, r, " | ".join(f"{r}{c}" for c in range(r + 1)), r == 1, 3, 3, "10 | 11") for r in range(3)
    }
    assert shared_folder(spark)


def test_passes_move_only_what_they_change(spark):
    rows = [
        (1, "1/0", None, 0, "heading", 3, "H", "bullet", False), (1, "1/1", None, 1, "paragraph", 0, "a ", "bullet", False),
        (1, "1/2", None, 2, "paragraph", 0, " b", "bullet", False), (1, "1/3", None, 3, "figure", 0, "f", "bullet", False),
        (1, "1/4", None, 4, "paragraph", 0, "Figure 1 x", "bullet", False), (1, "1/5", None, 5, "paragraph", 0, "Table 2 y", "bullet", True),
        (1, "1/6", None, 6, "list", 0, "l", "bullet", False), (1, "1/7", None, 7, "list", 0, "m", "bullet", False),
        (None, "n/0", None, 0, "equation", 0, "e", "bullet", False), (None, "n/1", None, 1, "paragraph", 0, "Eq. 3", "bullet", False),
        (1, "1/8", None, 8, None, None, None, None, None),
    ]
    schema = "doc_id long, node_id string, parent_id string, seq int, node_type string, level int, text string, list_style string, boundary_preserved boolean"
    nodes = spark.createDataFrame(rows, schema)
    spans = lambda df: plan(df).count("Window [")
    levels = S.repair_heading_levels(nodes)
    assert {r.node_id: r.level for r in levels.collect()} == {r[1]: 1 if r[1] == "1/0" else r[5] for r in rows}
    assert plan(levels).index("Union") < plan(levels).index("Window")
    captioned = S.attach_captions(nodes)
    assert captioned.columns == [*nodes.columns, "caption"] and spans(captioned) == 0  # the scan is done and holds no other text
    got = {r.node_id: r.caption for r in captioned.collect()}
    assert got == {r[1]: "Table 2 y" if r[1] == "1/3" else None for r in rows if r[1] not in ("1/4", "1/5", "n/1")}
    paragraphs = S.merge_paragraphs(nodes)
    assert {(r.node_id, r.text, r.n_merged) for r in paragraphs.collect() if r.node_type == "paragraph"} == {
        ("1/1", "a   b", 2), ("1/4", "Figure 1 x", 1), ("1/5", "Table 2 y", 1), ("n/1", "Eq. 3", 1),
    }
    lists = S.merge_lists(nodes)
    assert {(r.node_id, r.text, r.n_items) for r in lists.collect() if r.node_type == "list"} == {("1/6", "l\nm", 2)}
    for out in (paragraphs, lists):
        kept = plan(out).split("Join")[0]
        assert "Union" in kept and "Window" not in kept  # nodes that do not change come straight from the input


def test_lines_are_cut_by_one_split(spark, tmp_path):
    texts = ["a b\u00a0c\td e f  g\u2003 h", "", "   ", " one ", None]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = PL.lines(spark, str(tmp_path))
    assert "regexp" not in plan(found)
    assert sorted((r.node_id, r.line_no, r.text.split(": ")[-1]) for r in found.collect()) == [
        ("0/0", 0, "a b c d e"), ("0/0", 1, "f g h"), ("1/0", 0, "Example:"), ("2/0", 0, "Note:"), ("3/0", 0, "See Figure 0. one"),
    ]


def test_texts_are_folded_once_for_lines_in_boxes(spark):
    nodes = spark.createDataFrame([(1, 1, "n", " Ab  c\td ", 0.0, 0.0, 0.5, 0.1)], "doc_id long, page int, node_id string, text string, x0 double, y0 double, x1 double, y1 double")
    lines = spark.createDataFrame(
        [(1, 1, i, t, 0.0, 0.05, 0.1, 0.06) for i, t in enumerate(["B\u00a0C", " \u2003", None, "", "x", "AB c"])],
        "doc_id long, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double",
    )
    found = L.match_lines_in_box(nodes, lines, 0.01)
    assert plan(found).count("regexp_replace") == 2
    assert sorted(r.line_no for r in found.collect()) == [0, 5]
