"""Documented cases and brute-force twins of the operators without SQL."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from coursewright.functions import text as X
from coursewright.operators import book as B
from coursewright.operators import sequence as Q
from coursewright.operators import structure as S
from coursewright.operators import study as P
from coursewright.operators import tables as O


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("block", [1, 2, 5, 1000])
def test_scan_equals_fold(spark, block):
    rng = random.Random(block)
    data = [(d, i, rng.choice([None, rng.randint(0, 9)])) for d in range(4) for i in range(0, 40, rng.choice([1, 2, 3]))]
    df = spark.createDataFrame(data, "d int, i int, v int")
    specs = {
        "s": ("sum", F.coalesce("v", F.lit(0)).cast("long"), True),
        "m": ("max", F.col("v"), False),
        "l": ("last", F.col("v"), False),
    }
    got = {(r["d"], r["i"]): (r["s"], r["m"], r["l"]) for r in Q.scan(df, ["d"], "i", specs, block_rows=block).collect()}
    for d in range(4):
        total, top, last = 0, None, None
        for _, i, v in sorted(r for r in data if r[0] == d):
            total += v or 0
            assert got[d, i] == (total, top, last)
            if v is not None:
                top, last = max(v, top if top is not None else v), v


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_islands_equal_fold(spark, block):
    rng = random.Random(block)
    data = [(d, i, rng.choice("aab")) for d in range(5) for i in range(25)]
    df = spark.createDataFrame(data, "d int, i int, v string")
    out = Q.islands(df, ["d"], "i", "run", ["v"], lambda p, r: p["v"] == r["v"], block_rows=block)
    got = {(r["d"], r["i"]): r["run"] for r in out.collect()}
    for d in range(5):
        start, last = None, None
        for _, i, v in (r for r in data if r[0] == d):
            if v != last:
                start = i
            last = v
            assert got[d, i] == start


def nodes(spark, kinds):
    data = [(1, f"n{i}", None, i, k, lv, t, False) for i, (k, lv, t) in enumerate(kinds)]
    return spark.createDataFrame(
        data, "doc_id long, node_id string, parent_id string, seq int, node_type string, level int, text string, boundary_preserved boolean"
    )


def test_heading_gaps(spark):
    df = nodes(spark, [("heading", lv, "h") for lv in (3, 4, 4, 1, 3)])
    assert [r["level"] for r in S.repair_heading_levels(df).orderBy("seq").collect()] == [1, 2, 3, 1, 2]


def test_caption_follows_figure_only(spark):
    df = nodes(
        spark,
        [("figure", 0, ""), ("paragraph", 0, "Figure 1 a"), ("paragraph", 0, "Fig. 2 b"), ("paragraph", 0, "x"), ("paragraph", 0, "Table 3 c")],
    )
    out = S.attach_captions(df)
    assert rows(out, "node_id", "caption") == sorted([("n0", "Fig. 2 b"), ("n3", None), ("n4", None)], key=lambda r: r[0])


def test_paragraph_merge_strips_as_it_goes(spark):
    df = nodes(spark, [("paragraph", 0, "a "), ("paragraph", 0, " b "), ("paragraph", 0, "c"), ("list", 0, "l"), ("paragraph", 0, " d ")])
    assert rows(S.merge_paragraphs(df), "seq", "text") == [(0, "a   b c"), (3, "l"), (4, " d ")]


def test_long_word_runs_do_not_overflow(spark):
    """Thousands of words without a stop: a recursive matcher would exhaust the stack."""
    from coursewright.operators import annotate as A

    text = "word " * 60000 + "thing is a fact. Next"
    df = nodes(spark, [("paragraph", 0, text)])
    hit = A.Annotator().register("d", A.detect_definitions).run(df).collect()
    assert len(hit) == 1 and hit[0]["body"] == "a fact" and hit[0]["term"].endswith("word thing")


def brute_order(ranks, edges, n):
    waiting = [0] * n
    for _, d in edges:
        waiting[d] += 1
    ready = [i for i in range(n) if waiting[i] == 0]
    out, recent = [], []
    while ready:
        if len(ready) == 1 or not recent:
            i = ready.pop(0)
        else:
            streak = 0
            for r in reversed(recent):
                if r != recent[-1]:
                    break
                streak += 1
            best, i = float("-inf"), None
            for j in ready:
                score = 0.0
                if streak >= 2:
                    score += -10.0 if ranks[j] == recent[-1] else 5.0
                score += (2 - ranks[j]) * 0.5
                if score > best:
                    best, i = score, j
            ready.remove(i)
        out.append(i)
        recent = [*recent, ranks[i]][-5:]
        for s, d in edges:
            if s == i:
                waiting[d] -= 1
                if waiting[d] == 0:
                    ready.append(d)
    return out


def test_topological_order_equals_brute_force(spark):
    rng = random.Random(7)
    names = ("basic", "intermediate", "advanced")
    units, edges, want = [], [], {}
    for doc in range(30):
        n = rng.randint(1, 12)
        ranks = [rng.randint(0, 2) for _ in range(n)]
        own = sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(n)) if a != b and (a < b or doc % 3 == 0)})
        units += [(doc, f"{doc}.{i}", i, names[r]) for i, r in enumerate(ranks)]
        edges += [(doc, f"{doc}.{a}", f"{doc}.{b}") for a, b in own]
        want[doc] = [f"{doc}.{i}" for i in brute_order(ranks, own, n)]
    out = P.balanced_topological_order(
        spark.createDataFrame(units, "doc_id long, unit_id string, ord int, difficulty string"),
        spark.createDataFrame(edges, "doc_id long, src string, dst string"),
    ).collect()
    for doc, order in want.items():
        got = sorted((r["position"], r["unit_id"]) for r in out if r["doc_id"] == doc)
        assert [u for _, u in got] == order


def test_overlap_assignment_equals_brute_force(spark):
    rng = random.Random(3)
    segments, units, want = [], [], []
    for doc in range(20):
        segs = {s: {rng.randrange(12) for _ in range(4)} for s in range(rng.randint(1, 4))}
        us = {u: {rng.randrange(12) for _ in range(4)} for u in range(rng.randint(1, 5))}
        segments += [(doc, s, f"{doc}/{n}") for s, ns in segs.items() for n in ns]
        units += [(doc, u, f"u{u}", f"{doc}/{n}") for u, ns in us.items() for n in ns]
        got, left = {}, set(us)
        while True:
            best = (0, None, None)
            for s in segs:
                for u in sorted(left):
                    if s not in got and len(segs[s] & us[u]) > best[0]:
                        best = (len(segs[s] & us[u]), s, u)
            if not best[0]:
                break
            got[best[1]] = best[2]
            left.remove(best[2])
        for s, u in zip([s for s in segs if s not in got], sorted(left), strict=False):
            got[s] = u
        want += [(doc, s, f"u{got[s]}" if s in got else None) for s in segs]
    out = B.assign_units_by_overlap(
        spark.createDataFrame(segments, "doc_id long, segment long, node_id string"),
        spark.createDataFrame(units, "doc_id long, unit_ord long, unit_id string, node_id string"),
    )
    assert sorted(map(str, rows(out.fillna("-"), "doc_id", "segment", "unit_id"))) == sorted(
        str((d, s, u or "-")) for d, s, u in want
    )


def test_resolve_lessons_uses_each_once(spark):
    book = spark.createDataFrame(
        [(1, 0, "p1", "Intro", ""), (1, 1, None, "intro ", ""), (1, 2, None, "Other", "INTRO"), (1, 3, None, "Intro", "none")],
        "course_id long, ord long, unit_id string, title string, unit_title string",
    )
    course = spark.createDataFrame(
        [(1, 10, "p1", "Intro", 2), (1, 11, None, "Intro", 1), (1, 12, None, "Intro", 3)],
        "course_id long, lesson_id long, plan_id string, title string, display_order long",
    )
    got = {r["ord"]: r["lesson_id"] for r in B.resolve_lessons(book, course).collect()}
    assert got == {0: 10, 1: 11, 2: 12, 3: None}


def test_matching_ratio(spark):
    from coursewright.operators.review import matching_ratio

    pairs = [("alpha beta gamma", "alpha gamma"), ("same", "same"), ("", "x")]
    df = spark.createDataFrame(pairs, "a string, b string").select(matching_ratio("a", "b").alias("r"))
    assert [r["r"] for r in df.collect()] == [round(SequenceMatcher(a=a, b=b).ratio(), 6) for a, b in pairs]


def test_chunk_sizes_sum(spark):
    df = spark.range(1, 121).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.col("id") - 1)).alias("i"))
    got = {}
    for r in df.select("n", B.chunk_of(F.col("i"), F.col("n")).alias("c")).groupBy("n", "c").count().collect():
        got.setdefault(r["n"], {})[r["c"]] = r["count"]
    for size, chunks in got.items():
        k = 1
        if size > 6:
            valid = [c for c in range(1, size + 1) if 4 * c <= size <= 6 * c]
            k = min(valid, key=lambda c: abs(size / c - 5)) if valid else max(1, round(size / 5))
        assert [chunks[c] for c in sorted(chunks)] == [size // k + (1 if i < size % k else 0) for i in range(k)]


def test_slug_cases(spark):
    cases = [
        ("https://example.com/path/to/page?q=1", "example_com_path_to_page.pdf"),
        ("https://docs.python.org/3/library/re.html#x", "docs_python_org_3_library_re_html.pdf"),
        ("https://", "document.pdf"),
        ("https://a.b/" + "x" * 200, ("a_b_" + "x" * 200)[:100] + ".pdf"),
    ]
    df = spark.createDataFrame(cases, "u string, want string").select(X.url_to_slug(F.col("u")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in df.collect())


def test_insert_if_absent_marks_new_rows(spark):
    base = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    assert rows(O.insert_if_absent(base, new, ["k"]), "k", "v", "inserted") == [(1, "a", False), (2, "c", True)]


def test_inventory_names(spark):
    from coursewright.sources.nodes import parse_inventory_name

    cases = [
        ("/s/ab__name=n__sha=x__mode=path.pdf", ("ab", "n.pdf", "x", "path")), ("ab__name=n__junk__sha=x.pdf", ("ab", "n.pdf", "x", "base64")),
        ("ab__name=n__sha=x__mode=ftp.pdf", None), ("ab__name=n.pdf", None), ("ab__name=n__sha=x__mode=path.txt", None),
        ("ab__sha=x__sha=y__k=v.pdf", ("ab", "document.pdf", "y", "base64")),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "p string").select("p", parse_inventory_name(F.col("p")).alias("e"))
    assert {r.p: r.e and tuple(r.e) for r in df.collect()} == dict(cases)


def test_promote_keeps_the_first_row_of_a_key(spark):
    src = spark.createDataFrame([(3, "a", "z"), (1, "a", "y"), (2, "b", None), (4, None, "n")], "user_id int, email string, rest string")
    out = O.promote_missing(src, src.where("email = 'b'"), "email", "user_id")
    assert out.columns == src.columns
    assert sorted(map(str, map(tuple, out.collect()))) == ["(1, 'a', 'y')", "(4, None, 'n')"]


@pytest.mark.parametrize("offset", [0, 9, 10, 37, 95, 118, 119, 120, 500])
def test_pages_far_down_are_sought(spark, monkeypatch, offset):
    monkeypatch.setattr(O, "SEEK", 10)
    monkeypatch.setattr(O, "RANGES", 8)
    keys = [None] * 12 + [5] * 40 + list(range(0, 204, 3))
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int").repartition(3)
    want = sorted(keys, key=lambda k: (k is not None, k))[offset : offset + 25]
    got = O.paginate(df, "k", offset, 25).collect()
    assert [r.k for r in got] == want
    assert all(r.total == 120 and r.next_offset == (offset + 25 if offset + 25 < 120 else None) for r in got)


def test_a_sought_page_filters_its_range(spark, monkeypatch, sf):
    monkeypatch.setattr(O, "SEEK", 10)
    lines = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    page = O.paginate(lines, "o_orderkey", 700, 20)
    want = [r[0] for r in lines.orderBy("o_orderkey").offset(700).limit(20).collect()]
    assert [r.o_orderkey for r in page.collect()] == want
    assert "GreaterThanOrEqual(o_orderkey" in page._jdf.queryExecution().toString()


def test_boxes_over_several_strips_meet_once(spark):
    from coursewright.operators import layout as L

    node = spark.createDataFrame([(1, 1, "n", "Some  long text", 0.0, 0.0, 1.0, 1.0)], "doc_id int, page int, node_id string, text string, x0 double, y0 double, x1 double, y1 double")
    rows = [(1, 1, "l1", "long", 0.1, 0.2, 0.3, 0.9), (1, 1, "l2", "other", 0.1, 0.2, 0.3, 0.3), (1, 1, "l3", "text", 2.0, 0.2, 2.5, 0.3), (1, 2, "l4", "text", 0.0, 0.0, 1.0, 1.0)]
    line = spark.createDataFrame(rows, "doc_id int, page int, line string, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r.line for r in L.match_lines_in_box(node, line, 0.01).collect()] == ["l1"]
    boxes = line.withColumnRenamed("line", "rect_id")
    assert sorted(r.rect_id for r in L.spatial_cover_anti_join(boxes, node).collect()) == ["l3", "l4"]
