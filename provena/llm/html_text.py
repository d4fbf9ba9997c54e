"""HTML to text by layout: a tree with implied tags, visibility rules, and rendered blocks.

The tokenizer never fails: what is no tag is text. The builder closes what HTML lets authors
leave open (p, li, dt, dd, tr, td, th, option, thead ...), ignores stray ends, and keeps raw
text elements whole. Rendering leaves out what a browser doesn't show (head, script, style,
template, noscript, closed details, hidden, and display:none or visibility:hidden in a style
attribute; rules of style elements are not read) and nothing else: menus, asides, footers and the
words of svg and math are visible; what is astray in a table stands before it. Blocks stand on
their own lines, paragraphs and headings with an empty line around them, list items with markers
and indent, table cells in aligned columns, with spans over columns and rows.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Generator, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm import batches

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
HIDDEN = {"head", "script", "style", "template", "noscript", "title", "iframe", "noembed", "noframes", "datalist", "object", "audio", "video", "canvas"}
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "pre", "blockquote", "table", "figure", "hr", "fieldset"}
BLOCK = SPACED | {
    "html", "body", "div", "section", "article", "main", "nav", "aside", "header", "footer", "address", "form", "li", "dt", "dd", "tr", "caption",
    "figcaption", "details", "summary", "legend", "center", "thead", "tbody", "tfoot", "option", "optgroup", "menu", "dir", "hgroup", "search",
}
#: Elements that hold only each other: what else opens in a PARTED one stands before the table.
PARTED = {"table", "thead", "tbody", "tfoot", "tr"}
CELLS = {"table", "td", "th", "caption"}
TABLE_PARTS = {"caption", "colgroup", "col", "thead", "tbody", "tfoot", "tr", "td", "th"}
#: Within svg and math: what shows nothing, what holds HTML again, and HTML tags that end them.
UNSEEN = {"desc", "metadata", "defs", "symbol", "clippath", "mask", "marker", "pattern", "lineargradient", "radialgradient", "filter", "annotation", "annotation-xml"}
INTEGRATION = {"foreignobject", "desc", "title", "annotation-xml", "mi", "mo", "mn", "ms", "mtext"}
BREAKOUT = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: An opening tag closes these open elements, up to the scope that bounds the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"} | CELLS), "dt": ({"dt", "dd"}, {"dl"} | CELLS), "dd": ({"dt", "dd"}, {"dl"} | CELLS),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    **dict.fromkeys(("caption", "colgroup", "col"), ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"})), "body": ({"head"}, {"html"}),
}
CLOSES_P = (BLOCK - {"html", "body", "li", "dt", "dd", "tr", "caption", "thead", "tbody", "tfoot", "option", "optgroup", "legend", "summary", "figcaption"}) | {"li", "dt", "dd"}
SCOPE = {"html", "body", "table", "td", "th", "caption", "button", "object", "template"}
#: Marks an element that stands on a line of its own; no attribute has this name.
OWN_LINE = "/line"
IN_HEAD = {"title", "meta", "link", "style", "script", "base", "noscript", "template"}
#: Items, quotes and cells within so many others are laid out without further indent or columns, so that lines stay short.
MAX_DEPTH = 200
#: Columns are aligned up to this width, longer cells push what follows; tables of more columns have each cell on lines of its own.
ALIGNED = 120
MAX_COLUMNS = 1000
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534

_TAG = re.compile(r"<(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAMED = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
_STOP = re.compile("[>\"']")
#: Characters in which most tags end.
NEAR = 512
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_ALONE = re.compile(r"(?:^|[\s\"']|(?:^|\s)[^\s=\"']+)/\s*\Z")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_VISIBLE = re.compile(r"(?:^|;)\s*visibility\s*:\s*visible", re.I)


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # Node or str


class _Tags:
    """Finds the tag at a place. Every stop (a quote or an end) is passed at most once on ways that lead nowhere, and looked for once, so the time for all tags grows with the source."""

    def __init__(self, source: str) -> None:
        self.source, self.final = source, source.rfind(">")
        self.dead: set[int] = set()  # stops from which no end of a tag is reached
        self.asked, self.stop = 0, -1  # between these two there is no stop

    def _next(self, at: int) -> int:
        if not self.asked <= at <= self.stop:
            m = _STOP.search(self.source, at)
            self.asked, self.stop = at, m.start() if m else len(self.source)
        return self.stop

    def at(self, lt: int) -> tuple[bool, str, str, int] | None:
        """Whether it is an end tag, name, attributes and where it ends; none if no tag starts there or it never ends."""
        source = self.source
        if lt > self.final:
            return None
        m = _TAG.match(source, lt, lt + NEAR)
        if m:
            return bool(m["end"]), m["name"], m["attrs"], m.end()
        m = _NAMED.match(source, lt)
        if not m:
            return None
        at, passed = m.end(), []
        while (i := self._next(at)) < len(source):
            if source[i] == ">":
                return bool(m[1]), m[2], source[m.end() : i], i + 1
            if i in self.dead:
                break
            passed.append(i)
            close = source.find(source[i], i + 1)
            if close < 0:
                break
            at = close + 1
        self.dead.update(passed)
        return None


def tokens(source: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", text, {}), ("open", name, attributes) and ("close", name, {}), in order."""
    at, text_from, n, foreign = 0, 0, len(source), 0
    tags = _Tags(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            break
        mark = source[lt + 1 : lt + 2]
        found = None
        if mark in ("!", "?"):
            close = "-->" if source.startswith("<!--", lt) else ">"
            end = source.find(close, lt + 2 * len(close) - 2)
            end = n if end < 0 else end + len(close)
        else:
            found = tags.at(lt)
            if not found:
                at = lt + 1
                continue
            end = found[3]
        if lt > text_from:
            yield "text", entities.unescape(source[text_from:lt]), {}
        at = text_from = end
        if not found:
            continue
        name, given = found[1].lower(), found[2]
        if found[0]:
            foreign -= name in ("svg", "math") and foreign > 0
            yield "close", name, {}
            continue
        attrs = {k.lower(): entities.unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(given)}
        alone = (foreign > 0 or name in ("svg", "math")) and bool(_ALONE.search(given))
        foreign += name in ("svg", "math") and not alone
        yield "open", name, attrs
        if alone:
            # Only svg and math know elements that close themselves.
            yield "close", name, {}
        elif name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            end = close.start() if close else n
            if end > at:
                raw = source[at:end]
                yield "text", entities.unescape(raw) if name in ("title", "textarea") else raw, {}
            yield "close", name, {}
            at = text_from = close.end() if close else n
    if text_from < n:
        yield "text", entities.unescape(source[text_from:]), {}


def tree(source: str) -> Node:
    """The document's tree. Text and elements before any body go in an implied body."""
    root = Node("html")
    stack = [root]
    places: dict[str, list[int]] = {}  # of open elements in the stack, by name

    def last(names: Iterable[str]) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut(i: int) -> None:
        while len(stack) > i:
            places[stack.pop().tag].pop()

    def close_to(names: set[str], scope: set[str]) -> None:
        bound = last(scope)
        found = [places[x][k] for x in names if places.get(x) and (k := bisect_right(places[x], bound)) < len(places[x])]
        if found:
            cut(min(found))

    def attach(child: Node | str) -> None:
        """Add to the innermost element; what is astray in a table stands before it."""
        if stack[-1].tag in PARTED and not (child.tag in TABLE_PARTS or child.tag in HIDDEN if isinstance(child, Node) else not child.strip()):
            into = stack[places["table"][-1] - 1].children if places.get("table") else stack[-1].children
            into.insert(len(into) - bool(places.get("table")), child)
        else:
            stack[-1].children.append(child)

    for kind, value, attrs in tokens(source):
        if kind == "text":
            if stack[-1].tag in ("head", "colgroup") and value.strip():
                cut(len(stack) - 1)
            attach(value)
        elif kind == "open":
            if value in ("html", "body"):
                known = root if value == "html" else next((stack[i] for i in places.get("body", [])), None)
                if known is not None:
                    known.attrs = attrs | known.attrs
                    continue
            if stack[-1].tag == "head" and value not in IN_HEAD or stack[-1].tag == "colgroup" and value not in ("col", "template"):
                cut(len(stack) - 1)
            drawing = last(("svg", "math"))
            if drawing > last(INTEGRATION | CELLS):
                if value in BREAKOUT:
                    cut(min(x for name in ("svg", "math") for x in places.get(name, []) if x > last(INTEGRATION | CELLS)))
                else:
                    attrs = attrs | dict.fromkeys((["hidden"] if value in UNSEEN else []) + ([OWN_LINE] if value == "text" else []), "")
            if value in TABLE_PARTS and stack[inner := last(PARTED | CELLS)].tag in PARTED:
                cut(inner + 1)
            if stack[-1].tag in PARTED and value == "form":
                continue
            if stack[-1].tag in PARTED and value == "table" and places.get("table"):
                cut(places["table"][-1])
            if value in CLOSES:
                close_to(*CLOSES[value])
            if value in CLOSES_P:
                close_to({"p"}, SCOPE)
            if value in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                row = Node("tr")
                stack[-1].children.append(row)
                push(row)
            node = Node(value, attrs)
            attach(node)
            if value not in VOID:
                push(node)
        elif value == "br" or value == "p" and not places.get("p"):
            attach(Node(value))
        else:
            bound = {"td", "th", "caption"} if value not in ("table", "tr", "thead", "tbody", "tfoot", "td", "th", "caption", "body", "html") else set()
            if places.get(value) and places[value][-1] > last(bound | ({"table"} if value != "table" else set())):
                cut(places[value][-1])
    return root


class _Lines:
    """Text as lines; remembers how much space is due before the next piece."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.due = 0  # empty lines before the next text; 0 within a line
        self.space = False
        self.marks: list[str] = []  # what the next text of a deep list item starts with, an item each

    def text(self, value: str) -> None:
        words = _SPACE.sub(" ", value)
        if not words:
            return
        if words[0] == " " and self.now:
            self.space = True
        body = words.strip(" ")
        if not body:
            return
        self.gap()
        self.now.append((" " if self.space and self.now else "") + self.marked() + body)
        self.space = words[-1] == " "

    def marked(self) -> str:
        """The marks that are due, which are due no longer."""
        out = "".join(self.marks)
        self.marks.clear()
        return out

    def gap(self) -> None:
        if self.due and self.lines:
            self.lines += [""] * (self.due - 1)
        self.due = 0

    def end(self, empty: int = 0) -> None:
        """End the line; at least ``empty`` empty lines come before the next text."""
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []
        self.space = False
        self.due = max(self.due, empty + 1) if self.lines else 0

    def add(self, lines: list[str], empty: int) -> None:
        """Whole lines, with empty ones around."""
        self.end(empty)
        if lines:
            self.gap()
            self.lines += [self.marked() + lines[0], *lines[1:]] if self.marks else lines
            self.end(empty)

    def done(self) -> list[str]:
        self.end()
        return self.lines


def _seen(node: Node, shown: bool) -> tuple[bool, bool]:
    """Whether an element is laid out, and whether its own text shows (visibility is inherited and can be reset)."""
    style = node.attrs.get("style", "")
    if node.tag in HIDDEN or "hidden" in node.attrs or (node.tag == "input" and node.attrs.get("type", "").lower() == "hidden"):
        return False, False
    if node.tag == "dialog" and "open" not in node.attrs:
        return False, False
    if style:
        if re.search(r"(?:^|;)\s*display\s*:\s*none", style, re.I):
            return False, False
        if _INVISIBLE.search(style):
            return True, False
        if _VISIBLE.search(style):
            return True, True
    return True, shown


def _rows(table: Node) -> Iterator[Node]:
    for c in table.children:
        if isinstance(c, Node) and "hidden" not in c.attrs and _seen(c, True)[0]:
            if c.tag == "tr":
                yield c
            elif c.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(c)


def _span(cell: Node, name: str, most: int) -> int:
    value = cell.attrs.get(name, "1").strip()
    if not (value.isascii() and value.isdigit() and len(value) < 10):
        return 1
    return min(most, int(value)) or (most if name == "rowspan" else 1)


def _places(rows: list[list[Node]]) -> list[list[int]]:
    """The column in which each cell of each row starts: the first that no cell from the rows above reaches into."""
    out: list[list[int]] = []
    held: list[tuple[int, int, int]] = []  # start, end, first free row; by start
    for r, cells in enumerate(rows):
        held = [x for x in held if x[2] > r]
        at, i, places = 0, 0, []
        for c in cells:
            while i < len(held) and held[i][0] <= at:
                at = max(at, held[i][1])
                i += 1
            places.append(at)
            at += _span(c, "colspan", MAX_COLSPAN)
        out.append(places)
        new = [(p, p + _span(c, "colspan", MAX_COLSPAN), r + down) for p, c in zip(places, cells, strict=True) if (down := _span(c, "rowspan", MAX_ROWSPAN)) > 1]
        held = sorted(held + new) if new else held
        if at > MAX_COLUMNS * MAX_COLSPAN or len(held) > MAX_COLUMNS:
            break
    return out


def _run(work: Generator) -> object:
    """The result of a generator that yields generators and gets their results: calls without Python's stack."""
    stack, value = [work], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as e:
            stack.pop()
            value = e.value
    return value


def _table(node: Node, out: _Lines, shown: bool, level: int) -> Generator:
    """A table: columns as wide as their widest one-column cell, two spaces apart. Columns in which no cell starts take no place."""
    rows, around = [], []
    for row in _rows(node):
        row_shown = _seen(row, shown)[1]
        rows.append([c for c in row.children if isinstance(c, Node) and c.tag in ("td", "th") and _seen(c, row_shown)[0]])
        around.append(row_shown)
    places = _places(rows)
    columns = sorted({p for r in places for p in r})
    if level >= MAX_DEPTH or len(columns) > MAX_COLUMNS or len(places) < len(rows):
        yield _deep_table(node, out, shown, level)
        return
    rank = {p: i for i, p in enumerate(columns)}
    width = [0] * len(columns)
    grid: list[list[tuple[int, list[str]]]] = []
    for cells, own, row_shown in zip(rows, places, around, strict=True):
        grid.append([])
        for c, p in zip(cells, own, strict=True):
            lines = _Lines()
            yield _render(c, lines, _seen(c, row_shown)[1], 0, level + 1)
            text = lines.done()
            grid[-1].append((rank[p], text))
            end = p + _span(c, "colspan", MAX_COLSPAN)
            if rank[p] + 1 == len(columns) or columns[rank[p] + 1] >= end:
                width[rank[p]] = max(width[rank[p]], min(ALIGNED, max(map(len, text), default=0)))
    starts = [0, *accumulate(w + 2 for w in width)]
    made = []
    for c in node.children:
        if isinstance(c, Node) and c.tag == "caption" and _seen(c, shown)[0]:
            lines = _Lines()
            yield _render(c, lines, _seen(c, shown)[1], 0, level + 1)
            made += lines.done()
    for cells in grid:
        for i in range(max((len(lines) for _, lines in cells), default=0)):
            line, size = [], 0
            for at, lines in cells:
                if i < len(lines) and lines[i]:
                    gap = starts[at] - size if size <= starts[at] or not size else 2
                    line += [" " * gap, lines[i]]
                    size += gap + len(lines[i])
            made.append("".join(line))
    while made and not made[-1]:
        made.pop()
    out.add(made, 1)


def _deep_table(node: Node, out: _Lines, shown: bool, level: int) -> Generator:
    """A table too deep or wide to align: its captions, then every cell on lines of its own."""
    out.end(1)
    cells = [(c, shown) for c in node.children if isinstance(c, Node) and c.tag == "caption"]
    for row in _rows(node):
        cells += [(c, _seen(row, shown)[1]) for c in row.children if isinstance(c, Node) and c.tag in ("td", "th")]
    for c, around in cells:
        laid, seen = _seen(c, around)
        if laid:
            yield _render(c, out, seen, 0, level + 1)
            out.end()
    out.end(1)


def _marker(parent: Node, n: int) -> str:
    return f"{n}. " if parent.tag == "ol" else "- "


def _render(node: Node, out: _Lines, shown: bool, depth: int, level: int) -> Generator:
    """A node's children; ``shown`` is whether its text is visible, ``level`` how many items, quotes and cells are around."""
    number = 1
    if node.tag == "ol":
        start = node.attrs.get("start", "1").strip()
        number = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
    children = node.children
    if node.tag == "details" and "open" not in node.attrs:
        children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
    for c in children:
        if isinstance(c, str):
            if shown:
                out.text(c)
            continue
        laid, seen = _seen(c, shown)
        if not laid:
            continue
        if c.tag == "br":
            if shown and not out.now:
                out.gap()
                out.lines.append("")
            out.end()
        elif c.tag == "hr":
            out.end(1)
        elif c.tag == "img":
            if seen and c.attrs.get("alt", "").strip():
                out.text(c.attrs["alt"])
        elif c.tag == "input":
            if seen and c.attrs.get("type", "").lower() in ("submit", "button", "reset") and c.attrs.get("value"):
                out.text(c.attrs["value"])
        elif c.tag in ("pre", "textarea", "xmp"):
            raw = _raw(c, seen).replace("\r\n", "\n")
            raw = raw[1:] if raw.startswith("\n") else raw
            out.add([line.rstrip() for line in raw.rstrip("\n ").split("\n")] if raw.strip() else [], 1)
        elif c.tag == "table":
            yield _table(c, out, seen, level)
        elif c.tag in ("li", "dd", "blockquote") and level >= MAX_DEPTH:
            out.end(int(c.tag == "blockquote"))
            before = len(out.marks)
            if c.tag == "li":
                out.marks.append(_marker(node, number))
                number += 1
            yield _render(c, out, seen, depth + 1, level + 1)
            del out.marks[before:]
            out.end(int(c.tag == "blockquote"))
        elif c.tag == "li":
            inner = _Lines()
            yield _render(c, inner, seen, depth + 1, level + 1)
            lines = inner.done()
            mark = _marker(node, number)
            number += 1
            if lines:
                out.add([mark + lines[0], *[" " * len(mark) + x if x else "" for x in lines[1:]]], 0)
        elif c.tag in ("dd", "blockquote"):
            inner = _Lines()
            yield _render(c, inner, seen, depth, level + 1)
            out.add(["  " + x if x else "" for x in inner.done()], int(c.tag == "blockquote"))
        elif c.tag in BLOCK or OWN_LINE in c.attrs:
            # A list within an item follows its text at once.
            empty = int(c.tag in SPACED and not (c.tag in ("ul", "ol", "dl") and depth))
            out.end(empty)
            yield _render(c, out, seen, depth, level)
            out.end(empty)
        else:
            yield _render(c, out, seen, depth, level)


def _raw(node: Node, shown: bool) -> str:
    out, todo = [], [(c, shown) for c in reversed(node.children)]
    while todo:
        c, around = todo.pop()
        if isinstance(c, str):
            out.append(c if around else "")
        elif c.tag == "br":
            out.append("\n")
        else:
            laid, seen = _seen(c, around)
            if laid:
                todo += [(x, seen) for x in reversed(c.children)]
    return "".join(out)


def render(source: str | None) -> str:
    """All visible text of a page, laid out; null and empty pages give the empty string."""
    if not source:
        return ""
    root, out = tree(source), _Lines()
    _run(_render(root, out, _seen(root, True)[1], 0, 0))
    lines = out.done()
    while lines and not lines[0]:
        lines.pop(0)
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` with ``visible_text`` in place of any such column. Null and empty pages give the empty string.

    Other columns pass as they are, whatever their names; repeated rows stay, an empty table gives
    none. Pages are read whole, however long; a pass without a shuffle.
    """
    batches.bound(df.sparkSession)

    @F.pandas_udf("string")
    def rendered(pages: pd.Series) -> pd.Series:
        return pd.Series([render(x) for x in pages], dtype=object)

    return df.withColumn("visible_text", rendered(F.col(f"`{html}`")))


def op3_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's visible text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return extract(pages).select("page_id", F.col("visible_text").alias("text"), F.length("visible_text").cast("long").alias("n_chars"))


QUERIES = {"op3_html_layout": op3_html_layout}
ORACLE_SQL: dict[str, str] = {}
