"""HTML blocks: hand-made pages, and no visible character lost on the given ones."""

import re
import time
from html.parser import HTMLParser

import pytest

from coursewright.sources import html, nodes

CASES = [
    ("text <b>in</b> the body", [("paragraph", 0, "text in the body", None)]),
    ("<div>one</div>two<p>three</p>four", [("paragraph", 0, t, None) for t in ("one", "two", "three", "four")]),
    ("<p>a<p>b<br>c<div>d", [("paragraph", 0, t, None) for t in ("a", "b c", "d")]),
    ("<p title='a>b'>x</p><p title=\"</p>\">y", [("paragraph", 0, "x", None), ("paragraph", 0, "y", None)]),
    ("&#8212; &eacute;&#x41; &amp;lt; a&nbsp;b &bogus;", [("paragraph", 0, "— éA &lt; a b &bogus;", None)]),
    ("<h2>T<i>it</i>le</h2><H6 class=x>U</H6>", [("heading", 2, "Title", None), ("heading", 6, "U", None)]),
    ("<ul><li>a<li>b<ul><li>c</ul>d</li></ul>e", [*[("list", 0, t, None) for t in "abcd"], ("paragraph", 0, "e", None)]),
    ("<dl><dt>term<dd>what it is<p>more</dl>", [("list", 0, t, None) for t in ("term", "what it is", "more")]),
    ("<table><tr><td>1<td>2<tr><th>3</table>after", [*[("table", 0, t, None) for t in "123"], ("paragraph", 0, "after", None)]),
    ("<table><tr><td>1<table><tr><td>in</table>out</table>", [("table", 0, t, None) for t in ("1", "in", "out")]),
    ("<pre>\n a\n  b\n</pre>", [("code", 0, " a\n  b", None)]),
    ("<blockquote>said<p>so</blockquote>", [("paragraph", 0, "said", None), ("paragraph", 0, "so", None)]),
    (
        "<figure><img src=x alt='A &lt; B'><figcaption>Fig. <b>1</b></figcaption><img alt=two></figure><p>x",
        [("figure", 0, "Fig. 1", "A < B two"), ("paragraph", 0, "x", None)],
    ),
    ("<p>a <img alt=pic> b</p>", [("paragraph", 0, "a b", None), ("figure", 0, "", "pic")]),
    ("<figure><table><tr><td>c</table>note</figure>", [("figure", 0, "note", None), ("table", 0, "c", None)]),
    ("<head><title>t</title><p>shown", [("paragraph", 0, "shown", None)]),
    ("<script>var a='</p><p>no';</script>yes<style>p{}</style><!-- <p>no --><nav>no</nav><footer>no</footer>", [("paragraph", 0, "yes", None)]),
    ("a < b, a<3 and <", [("paragraph", 0, "a < b, a<3 and <", None)]),
    ("x<p", [("paragraph", 0, "x<p", None)]),
    ("</p></div>odd</li>ends", [("paragraph", 0, "odd", None), ("paragraph", 0, "ends", None)]),
    ("<textarea><b>raw</b></textarea>", [("paragraph", 0, "<b>raw</b>", None)]),
    ("<script>never ended", []),
    ("", []),
]


@pytest.mark.parametrize("page, want", CASES)
def test_made_pages(page, want):
    assert [tuple(b) for b in html.page_blocks(page)] == want


class Visible(HTMLParser):
    """Text outside head, script, style, nav and footer, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("head", "script", "style", "nav", "footer"):
            self.skip.append(tag)

    def handle_endtag(self, tag):
        if tag in self.skip:
            self.skip.remove(tag)

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_no_visible_character_is_lost(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    blocks = {}
    for r in nodes.scan_html_blocks(pages).orderBy("page_id", "seq").collect():
        blocks.setdefault(r.page_id, []).append(r.text)
    squeezed = lambda t: re.sub(r"\s+", "", t)
    n = 0
    for r in pages.collect():
        parser = Visible()
        parser.feed(r.html)
        parser.close()
        assert squeezed("".join(blocks.get(r.page_id, []))) == squeezed("".join(parser.out)), r.page_id
        n += 1
    assert n == pages.count() > 0


def test_null_pages_ids_and_other_columns(spark):
    rows = [("a", None, 1), (None, "<p>x", 2), ("a", "<li>y", 3), ("a", "<li>y", 3)]
    out = nodes.scan_html_blocks(spark.createDataFrame(rows, "page_id string, html string, seq int"))
    assert sorted((r.page_id or "", r.seq, r.node_type, r.text) for r in out.collect()) == [
        ("", 0, "paragraph", "x"), ("a", 0, "list", "y"), ("a", 0, "list", "y"),
    ]
    assert nodes.scan_html_blocks(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_long_pages_take_linear_time():
    started = time.time()
    page = "<div>" * 100_000 + "<p>a &amp; b" * 60_000 + "<" * 1000
    assert len(html.page_blocks(page)) == 60_000
    assert time.time() - started < 30
