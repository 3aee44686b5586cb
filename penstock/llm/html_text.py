"""Layout-aware text of HTML pages: a tree builder with implied tags, visibility rules, and a renderer.

All visible text comes out: blocks stand on lines of their own, paragraphs and headings with a blank line between,
list items get a bullet, number or letter (also counted down) and an indent per level, table cells are padded to aligned
columns (a cell over several columns widens the last of them, one over several rows keeps its columns free below; wide
characters take two cells), and preformatted text and text areas keep their white space. Options, buttons, values of
fields that show them and SVG texts stand on lines of their own; text that only screen readers pass over comes out, and so does what is made visible
inside of something hidden by visibility. Style sheets and labels in attributes are not read.

Defined cases: null and empty pages give an empty text; unclosed and misnested tags are closed by the tree
builder; nesting may be of any depth (the walk has a stack of its own); repeated rows give equal results; an empty
table gives an empty table; only the named columns are carried.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Elements by how they are laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript head title iframe object audio video canvas datalist defs symbol desc metadata annotation annotation-xml".split())
#: Inline elements whose contents stand on a line of their own.
LINE = frozenset("option text button textarea".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote ul ol dl table figure".split())
#: Elements that stay in an open head; anything else ends it.
HEAD = frozenset("base link meta noscript script style template title".split())
#: An opening tag closes these open elements, unless one of the second set stands between.
IMPLIED = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"),
    "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("thead tbody tfoot tr td th caption", "table"), "thead": ("tbody tr td th caption", "table"), "tfoot": ("thead tbody tr td th", "table"),
}
#: Kinds of fields that show their value.
FIELDS = frozenset("text search email tel url number date time submit reset button".split()) | {""}
_gone = re.compile(r"display\s*:\s*none", re.I)
_visibility = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)


class Node:
    """hidden: nothing below shows; shown: False if its text is invisible, True if made visible again, None as around it."""

    __slots__ = ("tag", "children", "hidden", "shown", "start", "span", "down", "kind", "back")

    def __init__(self, tag: str, hidden: bool = False, shown: bool | None = None, start: int | None = None, span: int = 1, down: int = 1, kind: str = "", back: bool = False):
        self.tag, self.children, self.hidden, self.shown, self.start, self.span, self.down, self.kind, self.back = tag, [], hidden, shown, start, span, down, kind, back


def _number(text: str) -> int | None:
    return int(text) if text.isascii() and text.isdigit() and len(text) < 9 else None


def ordinal(k: int, kind: str) -> str:
    """The mark of an ordered list's item: a number, letters (a, A) or a Roman number (i, I); what these lack is a number."""
    if kind in ("a", "A") and k > 0:
        out = ""
        while k:
            k, r = divmod(k - 1, 26)
            out = chr(97 + r) + out
    elif kind in ("i", "I") and 0 < k < 4000:
        out = ""
        for value, letters in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split()):
            out += letters * (k // value)
            k %= value
    else:
        return str(k)
    return out.upper() if kind.isupper() else out


def cells(text: str) -> int:
    """Columns that a text takes: two a wide character, none a combining one."""
    return len(text) if text.isascii() else sum(0 if unicodedata.category(c) in ("Mn", "Me", "Cf") else 1 + (unicodedata.east_asian_width(c) in "WF") for c in text)


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]

    def _close(self, tags: set[str], stops: set[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in stops:
                return
            if tag in tags:
                del self.open[k:]
                if tag in ("tr", "td", "th", "thead", "tbody", "tfoot", "caption") and len(tags) > 1:
                    return self._close(tags, stops)
                return

    def _leave_head(self) -> None:
        if self.open[-1].tag == "head":
            self.open.pop()

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            if tag == "body":
                self._close({"head"}, set())
            return
        if tag not in HEAD:
            self._leave_head()
        values = {k: v or "" for k, v in attrs}
        if tag in IMPLIED:
            tags, stops = IMPLIED[tag]
            self._close(set(tags.split()), set(stops.split()))
        elif tag in BLOCK:
            self._close({"p"}, {"table", "td", "th", "li", "div", "button"})
        style = values.get("style", "")
        hidden = tag in HIDDEN or "hidden" in values or bool(_gone.search(style))
        seen = _visibility.findall(style)
        shown = seen[-1].lower() == "visible" if seen else None
        node = Node(tag, hidden, shown, _number(values.get("value" if tag == "li" else "start", "")), max(1, min(_number(values.get("colspan", "")) or 1, 1000)))
        down = _number(values.get("rowspan", ""))
        node.down = 1 if down is None else min(down, 65_534) or 65_534  # 0: to the end
        node.kind, node.back = values.get("type", ""), tag == "ol" and "reversed" in values
        self.open[-1].children.append(node)
        if tag == "input" and node.kind.lower() in FIELDS and values.get("value", "").strip() and not hidden:
            node.tag = "button"
            node.children.append(values["value"])
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open[-1].tag == tag and tag not in VOID and len(self.open) > 1:
            self.open.pop()

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        self._close({tag}, {"td", "th", "table"} - {tag} if tag not in ("tr", "tbody", "thead", "tfoot", "table") else {"table"} - {tag})

    def handle_data(self, data):
        if data.strip():
            self._leave_head()
        if self.open[-1].tag in ("pre", "textarea", "listing") and not self.open[-1].children:
            data = data.removeprefix("\n")  # the first line end is not part of the text
        self.open[-1].children.append(data)


def walk(task) -> object:
    """Run a generator that yields generators, each sent the result of the one it yielded: recursion without Python's limit."""
    stack, value = [task], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as e:
            stack.pop()
            value = e.value
    return value


class Renderer:
    """Lines of the visible text; ``gap`` is the number of blank lines that the next block asks for."""

    def __init__(self, shown: bool = True):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.lead = ""
        self.shown = shown

    def end_line(self) -> None:
        text = " ".join("".join(self.line).split())
        self.line = []
        if text:
            self.put([text])
            self.gap = 0

    def put(self, texts: list[str]) -> None:
        """Lines with the lead in front; a bullet stands before the first one only."""
        if self.lines and self.gap:
            self.lines.append("")
        for text in texts:
            self.lines.append((self.lead + text).rstrip())
            self.lead = " " * len(self.lead)

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = max(self.gap, int(spaced))

    def node(self, node: Node):
        counter = node.start if node.start is not None else sum(not isinstance(x, str) and x.tag == "li" and not x.hidden for x in node.children) if node.back else 1
        for child in node.children:
            if isinstance(child, str):
                if self.shown:
                    self.line.append(child)
                continue
            if child.hidden:
                continue
            around = self.shown
            self.shown = around if child.shown is None else child.shown
            if child.tag == "br":
                self.end_line()
            elif child.tag in ("pre", "listing", "textarea"):
                yield self.preformatted(child, child.tag != "textarea")
            elif child.tag == "table":
                yield self.table(child)
            elif child.tag == "li":
                self.end_line()
                outer = self.lead
                counter = child.start if child.start is not None else counter
                self.lead = " " * len(outer) + (f"{ordinal(counter, child.kind or node.kind)}. " if node.tag == "ol" else "- ")
                counter += -1 if node.back else 1
                yield self.node(child)
                self.end_line()
                self.lead = outer
            elif child.tag in ("ul", "ol", "menu", "blockquote", "dd"):
                nested = child.tag in ("ul", "ol", "menu") and bool(self.lead)
                self.block(child.tag in SPACED and not nested)
                outer = self.lead
                self.lead = " " * len(outer) + ("  " if child.tag in ("blockquote", "dd") else "")
                yield self.node(child)
                self.block(child.tag in SPACED and not nested)
                self.lead = outer
            elif child.tag in BLOCK or child.tag in LINE:
                self.block(child.tag in SPACED)
                yield self.node(child)
                self.block(child.tag in SPACED)
            else:
                yield self.node(child)
            self.shown = around

    def preformatted(self, node: Node, spaced: bool):
        self.block(spaced)
        out: list[str] = []
        yield texts(node, out, self.shown)
        lines = "".join(out).split("\n")
        if any(x.strip() for x in lines):
            self.put([x.rstrip() for x in lines])
            self.gap = 0
        self.gap = max(self.gap, int(spaced))

    def table(self, node: Node):
        self.block(True)
        rows, rest = [], []
        todo = list(reversed(node.children))
        while todo:
            child = todo.pop()
            if isinstance(child, str):
                rest.append(child if self.shown else "")
            elif child.hidden:
                continue
            elif child.tag == "tr":
                row = []
                for x in child.children:
                    if isinstance(x, str):
                        rest.append(x if self.shown else "")
                    elif not x.hidden:
                        text = yield rendered(x, self.shown if child.shown is None else child.shown)
                        # what stands in a row outside of its cells is a cell, if it shows anything
                        if text or x.tag in ("td", "th"):
                            row.append((text.split("\n"), x.span, x.down))
                rows.append(row)
            elif child.tag in ("thead", "tbody", "tfoot", "colgroup"):
                todo += reversed(child.children)
            else:
                text = yield rendered(child, self.shown)
                rows.append([(text.split("\n"), 1, 1)])
        if "".join(rest).strip():
            rows.insert(0, [([" ".join("".join(rest).split())], 1, 1)])
        # cells by their columns: a cell over several rows keeps its columns free in the rows below
        placed, busy = [], {}
        for row in rows:
            k, here, taken = 0, [], {}
            for lines, span, down in row:
                while k in busy:
                    k += 1
                here.append((k, lines, span))
                if down > 1:
                    taken |= dict.fromkeys(range(k, k + span), down)
                k += span
            placed.append((here, len(row) < 2 and not busy))
            busy = {c: n - 1 for c, n in (busy | taken).items() if n > 1}
        width: dict[int, int] = {}
        for here, alone in placed:
            for k, lines, span in here:
                if span == 1 and not alone:
                    width[k] = max(width.get(k, 0), max(map(cells, lines)))
        for here, alone in placed:  # a cell over several columns widens the last of them
            for k, lines, span in here:
                if span > 1 and not alone:
                    lack = max(map(cells, lines)) - sum(width.get(c, 0) for c in range(k, k + span)) - 2 * (span - 1)
                    width[k + span - 1] = width.get(k + span - 1, 0) + max(0, lack)
        begins = [0]
        for c in range(max((k for here, _ in placed for k, _, _ in here), default=0)):
            begins.append(begins[-1] + width.get(c, 0) + 2)
        made = []
        for here, _ in placed:
            for j in range(max((len(lines) for _, lines, _ in here), default=0)):
                text = ""
                for k, lines, _ in here:
                    text += " " * (begins[k] - cells(text)) + (lines[j] if j < len(lines) else "")
                made.append(text.rstrip())
        if any(made):
            self.put([x for x in made if x])
        self.gap = 1


def texts(node: Node, out: list[str], shown: bool):
    for child in node.children:
        if isinstance(child, str):
            out.append(child if shown else "")
        elif child.tag == "br":
            out.append("\n")
        elif not child.hidden:
            yield texts(child, out, shown if child.shown is None else child.shown)


def rendered(node: Node, shown: bool = True):
    made = Renderer(shown if node.shown is None else node.shown)
    yield made.node(node)
    made.end_line()
    return "\n".join(made.lines)


def html_to_text(html: str | None) -> str:
    if not html:
        return ""
    built = TreeBuilder()
    built.feed(html.replace("\r\n", "\n").replace("\r", "\n"))
    built.close()
    return walk(rendered(built.root))


def extract(df: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of every whole page: one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([html_to_text(x.as_py()) for x in batch.column(1)], pa.string())], names=["key", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col).alias("key"), F.col(html_col).alias("html")), run, f"key {kind}, text string").withColumnRenamed("key", id_col)
