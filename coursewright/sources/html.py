"""Content blocks of HTML pages: tags in one pass, with a stack of open blocks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa

# Element names by their part in a page.
HIDDEN = frozenset("head title script style template noscript nav footer iframe object svg".split())
RAW = frozenset("script style title textarea iframe noscript".split())  # hold no tags
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OF_HEAD = frozenset("base link meta noscript script style template title".split())
TYPED = {
    "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "li": "list", "dt": "list",
    "dd": "list", "pre": "code", "td": "table", "th": "table", "figure": "figure", "figcaption": "figure",
}
BLOCKS = frozenset(TYPED) | HIDDEN | frozenset(
    "html body p div section article main aside header address blockquote ul ol dl menu table caption thead tbody tfoot tr form fieldset "
    "legend details summary hr".split()
)
# A start tag ends these open elements, unless one of the second kind is opened within them.
_ROWS, _TABLE = ("tr", "td", "th"), ("table",)
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), _TABLE),
    "th": (("td", "th"), _TABLE), "tr": (_ROWS, _TABLE), "thead": ((*_ROWS, "thead", "tbody", "tfoot"), _TABLE),
    "tbody": ((*_ROWS, "thead", "tbody", "tfoot"), _TABLE), "tfoot": ((*_ROWS, "thead", "tbody", "tfoot"), _TABLE),
}
_P_HOLDERS = ("td", "th", "caption", "button")
# An end tag inside a table cell does not reach beyond the table, and so on.
_SCOPES = frozenset("table html body".split())

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL,
)
_ALT = re.compile(r"\salt\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_BLANKS = re.compile("[ \t\n\f\r ]+")


class _Page:
    """State of the pass: open blocks, the text of the block at hand, and the blocks done."""

    def __init__(self):
        self.open: list[str] = []
        self.count: Counter[str] = Counter()  # of open elements by name
        self.kinds: list[tuple[str, int]] = [("paragraph", 0)]  # of open elements that have one
        self.hidden = 0
        self.text: list[str] = []
        self.blocks: list[list | None] = []
        self.figures: list[list] = []  # [place in blocks, captions, alternative texts] of open figures
        self.alone: list[str] = []  # alternative texts of images outside figures, for after the block

    def flush(self) -> None:
        """The text so far is a block, of the kind of the nearest open element that has one."""
        raw = unescape("".join(self.text))
        self.text.clear()
        kind, level = self.kinds[-1]
        text = raw.strip("\r\n") if kind == "code" and raw.strip() else _BLANKS.sub(" ", raw).strip(" ")
        if text and kind == "figure" and self.figures:
            self.figures[-1][1].append(text)
        elif text:
            self.blocks.append([kind, level, text, None])
        self.blocks += [["figure", 0, "", alt] for alt in self.alone]
        self.alone.clear()

    def pop(self) -> None:
        self.flush()
        name = self.open.pop()
        self.count[name] -= 1
        self.hidden -= name in HIDDEN
        if name in TYPED:
            self.kinds.pop()
        if name == "figure":
            place, captions, alts = self.figures.pop()
            if captions or alts:
                self.blocks[place] = ["figure", 0, " ".join(captions), " ".join(alts) or None]

    def end(self, names: tuple[str, ...], within: tuple[str, ...] | frozenset[str]) -> None:
        """Closes the nearest open element of ``names``, and what is open in it; not beyond one of ``within``."""
        if not any(self.count[name] for name in names):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i] in names:
                while len(self.open) > i:
                    self.pop()
                return
            if self.open[i] in within:
                return

    def start_tag(self, name: str, attributes: str) -> None:
        if self.count["head"] and name not in OF_HEAD and name != "head":
            self.end(("head",), ())
        if name == "img" and not self.hidden:
            alt = _ALT.search(" " + attributes)
            value = _BLANKS.sub(" ", unescape(next(x for x in alt.groups() if x is not None))).strip(" ") if alt else ""
            if value:
                (self.figures[-1][2] if self.figures else self.alone).append(value)
        if name == "br":
            self.text.append("\n")
        if name not in BLOCKS:
            return
        self.flush()
        self.end(("p",), _P_HOLDERS)
        for names, within in filter(None, [IMPLIED.get(name)]):
            for _ in names:
                self.end(names, within)
        if name in VOID:
            return
        self.open.append(name)
        self.count[name] += 1
        self.hidden += name in HIDDEN
        if name in TYPED:
            self.kinds.append((TYPED[name], int(name[1]) if TYPED[name] == "heading" else 0))
        if name == "figure":
            self.figures.append([len(self.blocks), [], []])
            self.blocks.append(None)

    def end_tag(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
            self.end((name,), frozenset() if name in _SCOPES else _SCOPES)


def page_blocks(html: str) -> list[list]:
    """[kind, level, text, alt] of the blocks of a page, in order; see ``scan_html_blocks``."""
    page, at, lowered = _Page(), 0, html.lower()
    if len(lowered) != len(html):  # some capitals grow; then only A-Z count
        lowered = "".join(c.lower() if c < "\x80" else c for c in html)
    while at < len(html):
        token = _TOKEN.match(html, at)
        at = token.end()
        if token["text"] is not None:
            if not page.hidden:
                page.text.append(token["text"])
        elif token["name"]:
            name = token["name"].lower()
            if token["close"]:
                page.end_tag(name)
                continue
            page.start_tag(name, token["attributes"])
            if name in RAW:
                stop = lowered.find(f"</{name}", at)
                stop = len(html) if stop < 0 else stop
                if not page.hidden:
                    page.text.append(html[at:stop])
                at = stop
    while page.open:
        page.pop()
    page.flush()
    return [block for block in page.blocks if block]


def block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, html) to (page_id, seq, node_type, level, text, alt)."""
    for batch in batches:
        ids, pages = batch.column("page_id"), batch.column("html")
        for i in range(batch.num_rows):
            found = page_blocks(pages[i].as_py() or "")
            if found:
                kinds, levels, texts, alts = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([i] * len(found), pa.int64())),
                        pa.array(range(len(found)), pa.int32()),
                        *[pa.array(x, t) for x, t in ((kinds, pa.string()), (levels, pa.int32()), (texts, pa.string()), (alts, pa.string()))],
                    ],
                    names=["page_id", "seq", "node_type", "level", "text", "alt"],
                )
