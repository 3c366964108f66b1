"""HTML extraction by layout-aware rendering.

A tree builder reads tags, closes elements that others imply closed (paragraphs
before blocks, list items, table parts, options, definition terms) and opens
implied rows. Rendering walks the tree without recursion and emits all visible
text: blocks on lines of their own, paragraphs and headings apart by an empty
line, list items with bullets or numbers and indented by depth, preformatted text
as it is, and table cells padded to columns, with cells that span rows or columns. Head matter, scripts, styles,
templates, embedded media, hidden elements and closed details are not visible.

Null and empty pages give empty text. A tag cut off by the end of the page is
dropped with what follows; an unclosed element reaches to the end. Time and text are
linear in the page whatever it holds: each ``<`` is looked at once, indentation ends
at INDENT_MOST characters, a table line pads no cell beyond LINE_MOST, and tables
nested deeper than NEST_MOST give their cells to the last one above. Rows stay apart
whatever their ids. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablespec.llm.shared import small_batches

#: a quote opens a string only where a value begins; elsewhere it is a plain character
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|(?![\"'])[^\s>]*+))?+)*+)>", re.S)
ATTR = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|(?![\"'])([^\s>]*+)))?+")
OPENS = re.compile(r"<(?:/?[a-zA-Z]|[!?])")
INDENT_MOST, CELL_MOST, LINE_MOST, SPAN_MOST, NEST_MOST = 40, 80, 400, 1000, 16
SPACE = re.compile(r"[ \t\n\f\r]+")
#: fixed values: element classes of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head title script style template noembed noframes iframe object video audio canvas svg math datalist area base col link meta param source track map".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr".split())
BLOCKS = PARAGRAPHS | frozenset("html body address article aside details dialog dd div dt figcaption footer form header hgroup legend li main menu nav search section summary center caption tr thead tbody tfoot optgroup option".split())
CLOSES_P = BLOCKS - frozenset("html body li dd dt caption tr thead tbody tfoot option optgroup legend".split())
#: fixed values: an opening tag closes the nearest of these, unless a boundary comes first
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
}
STOPS = frozenset({"table", "td", "th", "caption", "html", "template"})


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.children = tag, attrs, []

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(self.attrs)} if self.attrs else {}


class Builder:
    """Builds the tree; ``open`` holds the open elements, ``count`` how many of each tag they are."""

    def __init__(self):
        self.root = Node("html", "")
        self.open, self.count = [self.root], {"html": 1}

    def text(self, s: str) -> None:
        if self.open[-1].tag == "head" and s.strip():
            self._pop(len(self.open) - 1)
        self.open[-1].children.append(s)

    def _pop(self, to: int) -> None:
        for n in self.open[to:]:
            self.count[n.tag] -= 1
        del self.open[to:]

    def _close(self, tags, stops) -> None:
        if not any(self.count.get(t) for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            t = self.open[i].tag
            if t in tags:
                self._pop(i)
                return
            if t in stops:
                return

    def start(self, tag: str, attrs: str) -> Node | None:
        if tag == "html":
            return None
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
            if tag in ("td", "th") and self.count.get("table") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
                self.start("tr", "")
            if tag in ("tr", "tbody", "thead", "tfoot"):
                self._close({"td", "th"}, {"table"})
                if tag != "tr":
                    self._close({"tr"}, {"table"})
        if tag in CLOSES_P:
            self._close({"p"}, STOPS)
        if self.open[-1].tag == "head" and tag in BLOCKS:
            self._pop(len(self.open) - 1)
        node = Node(tag, attrs.strip().removesuffix("/") if attrs else "")
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1
        return node

    def end(self, tag: str) -> None:
        if tag == "p" and not self.count.get("p"):
            self.open[-1].children.append(Node("p", ""))
        elif tag in VOID:
            if tag == "br":
                self.open[-1].children.append(Node("br", ""))
        elif tag not in ("html", "body") and self.count.get(tag):
            self._close({tag}, STOPS - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "template") else ())


def parse(page: str) -> Node:
    b, at, n = Builder(), 0, len(page)
    while at < n:
        opens = OPENS.search(page, at)
        if not opens or opens.start() > at:
            b.text(page[at : opens.start() if opens else n])
        # what opens a tag and does not match is cut off by the end of the page
        m = TAG.match(page, opens.start()) if opens else None
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            b.end(tag)
            continue
        b.start(tag, m[3])
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            b.text(page[at : close.start()] if close else page[at:])
            at = close.start() if close else n
            if not close:
                break
    return b.root


def hidden(node: Node) -> bool:
    if node.tag in UNSEEN:
        return True
    if not node.attrs and node.tag != "dialog":
        return False
    a = node.attributes()
    style = SPACE.sub("", a.get("style", "")).lower()
    return "hidden" in a or "display:none" in style or "visibility:hidden" in style or node.tag == "dialog" and "open" not in a or node.tag == "input" and a.get("type", "").lower() == "hidden"


class Writer:
    """Collects lines: inline text in a buffer, blank lines pending, and prefixes of lists."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.blank, self.space, self.pre = 0, True, 0
        self.indent: list[int] = []
        self.depth = 0
        self.marker: str | None = None

    def text(self, s: str) -> None:
        s = html.unescape(s) if "&" in s else s
        if self.pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self.parts.append(first)
            for line in rest:
                self.line(keep=True)
                self.parts.append(line)
            self.space = False
            return
        s = SPACE.sub(" ", s)
        if self.space and s[:1] == " ":
            s = s[1:]
        if s:
            self.parts.append(s)
            self.space = s[-1] == " "

    def line(self, keep: bool = False) -> None:
        """Ends the line; with keep an empty line stays."""
        s = "".join(self.parts)
        s = s.rstrip() if not keep else s
        self.parts, self.space = [], True
        if not s and not keep and self.marker is None:
            return
        if not s.strip() and self.marker is None and not keep:
            return
        if self.lines:
            self.lines += [""] * self.blank
        self.blank = 0
        prefix = " " * min(self.depth, INDENT_MOST)
        if self.marker is not None:
            prefix, self.marker = prefix[: max(0, len(prefix) - len(self.marker))] + self.marker, None
        self.lines.append((prefix + s).rstrip())

    def shift(self, width: int) -> None:
        """Indents what follows; a width of 0 takes the last one back."""
        if width:
            self.indent.append(width)
        self.depth += width or -self.indent.pop()

    def block(self, margin: int) -> None:
        if self.parts:
            self.line(keep=False)
        self.blank = max(self.blank, margin)

    def result(self) -> list[str]:
        self.block(0)
        return self.lines


def _table_lines(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of (lines of a cell, columns and rows it spans), padded so that columns align.

    A cell goes to the first column that no cell from above still takes."""
    width: dict[int, int] = {}
    taken: dict[int, int] = {}  # column -> rows that a cell from above still takes
    placed = []
    for row in rows:
        c, cells, fresh = 0, [], {}
        for lines, across, down in row:
            while taken.get(c):
                c += 1
            cells.append((c, lines, across))
            if across == 1:
                width[c] = max(width.get(c, 0), min(CELL_MOST, max(map(len, lines), default=0)))
            if down > 1:
                fresh |= {k: down for k in range(c, c + across)}
            c += across
        taken = {k: n - 1 for k, n in {**taken, **fresh}.items() if n > 1}
        placed.append(cells)
    columns = sorted(width)
    left, at = {}, 0
    for k in columns:
        left[k] = at
        at += width[k] + 2
    out = []
    for cells in placed:
        # a column that only wide cells reach starts where the last known one ends
        start = [left[columns[i]] if (i := bisect_left(columns, c)) < len(columns) else at for c, _, _ in cells]
        for i in range(max((len(lines) for _, lines, _ in cells), default=0)):
            line = ""
            for (c, lines, _), x in zip(cells, start):
                if i < len(lines) and lines[i]:
                    line = line.ljust(min(x, LINE_MOST)) if not line else (line + "  ").ljust(min(x, LINE_MOST))
                    line += lines[i]
            out.append(line.rstrip())
    return out


def render(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    writers, lists, tables = [Writer()], [], []
    stack: list[tuple[Node | str, bool]] = [(parse(page), False)]
    while stack:
        node, leaving = stack.pop()
        w = writers[-1]
        if isinstance(node, str):
            if not (tables and tables[-1][1] is w and not node.strip()):
                w.text(node)
            continue
        tag = node.tag
        if not leaving:
            if hidden(node):
                continue
            if tag == "br":
                w.line(keep=True)
                continue
            if tag in BLOCKS:
                w.block(1 if tag in PARAGRAPHS and not (tag in ("ul", "ol") and lists) else 0)
            if tag in ("ul", "ol", "menu"):
                start = node.attributes().get("start", "1")
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                numbered = bool(lists) and lists[-1][0]
                mark = f"{lists[-1][1]}. " if numbered else "- "
                if numbered:
                    lists[-1][1] += 1
                w.shift(len(mark))
                w.marker = mark
            elif tag in ("dd", "blockquote"):
                w.shift(2)
            elif tag == "pre":
                w.pre += 1
            elif tag == "table":
                tables.append(([], w) if len(tables) < NEST_MOST else tables[-1])
            elif tag == "tr" and tables:
                tables[-1][0].append([])
            elif tag in ("td", "th") and tables:
                writers.append(Writer())
            stack.append((node, True))
            kids = node.children
            if tag == "details" and "open" not in node.attributes():
                kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"]
            if tag == "pre" and kids and isinstance(kids[0], str):
                kids = [kids[0].removeprefix("\r").removeprefix("\n"), *kids[1:]]
            stack += [(k, False) for k in reversed(kids)]
            continue
        if tag in ("td", "th") and tables:
            lines = writers.pop().result()
            spans = [node.attributes().get(a, "1") for a in ("colspan", "rowspan")]
            spans = [min(SPAN_MOST, max(1, int(x))) if re.fullmatch(r"\d{1,9}", x) else 1 for x in spans]
            if not tables[-1][0]:
                tables[-1][0].append([])
            tables[-1][0][-1].append((lines, *spans))
            continue
        if tag == "table":
            rows = tables.pop()[0]
            w.block(1)
            for line in _table_lines(rows) if not tables or tables[-1][0] is not rows else ():
                w.parts.append(line)
                w.line(keep=True)
        elif tag in ("ul", "ol", "menu"):
            w.block(0)
            lists.pop()
        elif tag == "li":
            w.block(0)
            if w.marker is not None:
                w.line(keep=True)
            w.shift(0)
        elif tag in ("dd", "blockquote"):
            w.block(0)
            w.shift(0)
        elif tag == "pre":
            w.block(0)
            w.pre -= 1
        if tag in BLOCKS:
            w.block(1 if tag in PARAGRAPHS and not (tag in ("ul", "ol") and lists) else 0)
    return "\n".join(writers[0].result())


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The id and the visible text of each page."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([render(x) for x in batch.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col), F.col(html_col)).mapInArrow(run, f"`{id_col}` {kind}, text string")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
