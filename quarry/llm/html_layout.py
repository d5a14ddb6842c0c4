r"""HTML extraction by layout-aware rendering.

A scanner splits the page into tags and text; a tree builder closes implied
tags (``p``, ``li``, table parts, options and so on), gives void elements no
content and reads raw text elements verbatim; the renderer walks the tree, leaves
out what is not visible, and lays out the rest: blank lines between blocks, list
markers with nesting, preformatted text as it is, and tables with aligned columns.
Both take time in proportion to the page and what it renders to: the places of open elements
are kept by name, so no tag searches the open ones.

A head ends at the first tag or text that it cannot hold.

Not visible are head, script, style, template, noscript and the like, closed dialogs,
elements with ``hidden`` or ``aria-hidden="true"``, and those whose inline style has
``display: none`` or ``visibility: hidden``. Form text is visible: buttons, options and their
groups' labels, text areas, and the values of inputs that show one.

Bounds of the layout, which lose no text: cells align up to ``MAX_WIDTH`` characters, a longer cell
only shifts the rest of its own row, and within the first ``MAX_LINE`` characters of a line; cells
that start in the first ``MAX_HELD`` columns hold room in rows below; indentation stops at ``MAX_INDENT`` levels; tables
nested deeper than ``MAX_TABLES`` are laid out as plain blocks; spans are read up to the HTML standard's
greatest, 1000 columns and 65,534 rows.

Results for odd input: null pages give null text; empty ones the empty text; very long ones are rendered
whole; broken markup never fails: stray end tags are ignored, open elements end with the page,
a ``<`` that starts no tag is text, and a tag that the page's end cuts off is none of it; repeated
pages get equal text; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe object video audio canvas desc metadata annotation annotation-xml datalist noembed noframes meta link base area param source track col colgroup".split())
#: Inputs that show no value as text.
VALUELESS = frozenset("hidden checkbox radio password file color range image".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table ul caption".split())
#: Blocks set off by a blank line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl blockquote pre table figure hr article section".split())
#: A start tag of the key ends an open element of the value, up to the given boundary.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: What a head may hold; any other start tag, and text that is not blank, ends it.
HEAD = frozenset("base basefont bgsound link meta title noscript noframes script style template".split())
#: Block starts end an open paragraph; these elements shield paragraphs outside of them.
SHIELDS = frozenset("table td th caption button object html body".split())

OPENING = re.compile(r"<(?:(?P<comment>!--)|(?P<other>[!?])|(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*))")
#: The rest of a tag. A quote after ``=`` holds all up to its pair; any other is an ordinary character.
REST = re.compile(r"(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)>")
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
BLANK = re.compile(r"[ \t\n\r\f]+")
#: Bounds of the layout, see above.
MAX_WIDTH, MAX_LINE, MAX_HELD, MAX_INDENT, MAX_TABLES, MAX_COLSPAN, MAX_ROWSPAN = 80, 1000, 100, 40, 40, 1000, 65534


class Node:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: str = ""):
        self.name, self.attrs, self.children = name, attrs, []

    def attr(self, name: str) -> str | None:
        for m in ATTR.finditer(self.attrs):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None

    def number(self, name: str, default: int, least: int, most: int) -> int:
        found = re.match(r"\s*([0-9]+)", self.attr(name) or "")
        digits = found[1].lstrip("0") if found else None
        value = default if digits is None else most if len(digits) > 9 else int(digits or 0)
        return min(value, most) if value >= least else default

    def visible(self) -> bool:
        if self.name in UNSEEN:
            return False
        if self.name == "dialog" and self.attr("open") is None:
            return False
        if not self.attrs or self.attrs.isspace():
            return True
        if self.attr("hidden") is not None or (self.attr("aria-hidden") or "").strip().lower() == "true":
            return False
        style = self.attr("style")
        return not (style and HIDDEN_STYLE.search(style))


#: An end tag of another name does not leave these.
CELLS = frozenset("table td th".split())
TABLE_PARTS = frozenset("table tr tbody thead tfoot html body".split())


class Open:
    """The open elements, and for each name where they stand."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        """End the element at a place and all within it."""
        while len(self.stack) > at:
            self.places[self.stack.pop().name].pop()

    def last(self, names) -> int:
        """The place of the innermost open element of some names; 0 if there is none."""
        return max((found[-1] for n in names if (found := self.places.get(n))), default=0)

    def close(self, names, bounds) -> None:
        """A start tag ends the innermost open element of ``names`` inside ``bounds``, and those of ``names`` right around it."""
        at = self.last(names)
        if at and at > self.last(bounds):
            while at > 1 and self.stack[at - 1].name in names:
                at -= 1
            self.cut(at)

    def end(self, name: str) -> None:
        """An end tag; one without its start is ignored, as is one that would leave a table's cell."""
        at = self.last((name,))
        if at and (name in TABLE_PARTS or at >= self.last(CELLS)):
            self.cut(at)


def parse(page: str) -> Node:
    """The page's tree."""
    root = Node("#root")
    opened = Open(root)
    stack = opened.stack

    def text(s: str) -> None:
        if stack[-1].name == "head" and BLANK.sub("", s):
            opened.cut(len(stack) - 1)
        stack[-1].children.append(html.unescape(s))

    at = 0
    while m := OPENING.search(page, at):
        if m.start() > at:
            text(page[at : m.start()])
        if m["comment"]:
            at = page.find("-->", m.end())
            at = at + 3 if at >= 0 else len(page)
            continue
        if m["other"]:
            at = page.find(">", m.end()) + 1 or len(page)
            continue
        rest = REST.match(page, m.end())
        if rest is None:  # the page ends inside the tag
            return root
        at = rest.end()
        name = m["name"].lower()
        if m["end"]:
            opened.end(name)
            continue
        if stack[-1].name == "head" and name not in HEAD:
            opened.cut(len(stack) - 1)
        if name == "button":
            opened.close({"button"}, SHIELDS - {"button"})
        if name in CLOSES:
            opened.close(*CLOSES[name])
        if name in BLOCK and name not in ("html", "body"):
            opened.close({"p"}, SHIELDS)
        node = Node(name, rest["attrs"])
        stack[-1].children.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else len(page)
            held = page[at:stop]
            node.children.append(html.unescape(held.removeprefix("\n")) if name == "textarea" else held)
            after = page.find(">", stop) if end else -1
            at = after + 1 if after >= 0 else len(page)
        elif name not in VOID:  # "/>" ends no element of HTML
            opened.push(node)
    if at < len(page):
        text(page[at:])
    return root


class Page:
    """Lines of text; blank lines are asked for and merge."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0
        self.depth = 0
        self.marker = ""

    @property
    def indent(self) -> str:
        return "  " * min(self.depth, MAX_INDENT)

    def text(self, s: str) -> None:
        parts = BLANK.split(s)
        if len(parts) == 1 and not parts[0]:
            return
        if not parts[0]:
            self.space = True
        for i, w in enumerate(parts):
            if i:
                self.space = True
            if w:
                if self.space and self.now:
                    self.now.append(" ")
                self.now.append(w)
                self.space = False

    def end_line(self) -> None:
        if self.now:
            self.put(self.indent + self.marker + "".join(self.now))
            if self.marker:
                self.marker = " " * len(self.marker)
        self.now, self.space = [], False

    def put(self, line: str) -> None:
        if self.lines and self.gap:
            self.lines.append("")
        self.gap = 0
        self.lines.append(line.rstrip())

    def block(self, blank: bool) -> None:
        self.end_line()
        self.gap |= blank


def walk(node: Node, page: Page, tables: int = 0) -> None:
    # an explicit stack: pages may nest deeper than Python recurses; a list is (the lists around it, its kind, next number, depth)
    todo: list = [("open", node, None, False)]
    while todo:
        what, node, lists, pre = todo.pop()
        if what == "close":
            lists()
            continue
        if isinstance(node, str):
            if pre:
                first, *rest = node.split("\n")
                page.now.append(first)
                for line in rest:
                    page.put(page.indent + page.marker + "".join(page.now))
                    page.now = [line]
            else:
                page.text(node)
            continue
        if node.name != "#root" and not node.visible():
            continue
        name = node.name
        if name == "br":
            if page.now:
                page.end_line()
            else:
                page.gap = 1
            continue
        if name == "hr":
            page.block(True)
            page.put("---")
            page.gap = 1
            continue
        if name == "img":
            if alt := node.attr("alt"):
                page.text(f" {alt} ")
            continue
        if name == "input":
            kind = (node.attr("type") or "").strip().lower()
            if value := node.attr("alt" if kind == "image" else "value") if kind == "image" or kind not in VALUELESS else None:
                page.text(f" {value} ")
            continue
        if name in ("select", "option", "optgroup", "textarea"):
            page.text(" ")
            if name == "optgroup" and (label := node.attr("label")):
                page.text(f"{label} ")
        if name == "table" and tables < MAX_TABLES:
            page.block(True)
            for line in table(node, tables + 1):
                page.put(page.indent + page.marker + line)
                page.marker = " " * len(page.marker)
            page.block(True)
            continue
        block, blank = name in BLOCK, name in SPACED and not (lists and name in ("ul", "ol", "menu"))
        if block:
            page.block(blank)
        before = page.depth, page.marker
        if name in ("ul", "ol", "menu"):
            start = node.attr("start") or "1"
            lists = [lists, name, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1, lists[3] + 1 if lists else 0]
        elif name == "li":
            page.depth = lists[3] if lists else 0
            page.marker = "- "
            if lists and lists[1] == "ol":
                page.marker = f"{lists[2]}. "
                lists[2] += 1
        elif name in ("blockquote", "dd"):
            page.depth += 1
        elif name == "pre":
            pre = True

        def leave(before=before, block=block, blank=blank, name=name):
            if name == "pre" and page.now:
                page.put(page.indent + page.marker + "".join(page.now))
                page.now = []
            if block:
                page.block(blank)
                page.depth, page.marker = before[0], " " * len(before[1])
            elif name in ("select", "option", "optgroup", "textarea"):
                page.text(" ")

        todo.append(("close", None, leave, False))
        todo.extend(("open", c, lists, pre) for c in reversed(node.children))


def table(node: Node, tables: int) -> list[str]:
    """Rows of a table; cells start at their columns, which are as wide as their widest cell within ``MAX_WIDTH``.

    Columns in which no cell with text starts take no room.
    """
    rows: list[list[tuple[int, str]]] = []
    before: list[str] = []
    # columns held by cells of rows above: (first, end) to the number of the row that is free of it
    held: list[tuple[int, int, int]] = []

    def stray(child) -> None:
        if isinstance(child, str):
            if child.strip():
                before.append(BLANK.sub(" ", child).strip())
        elif child.visible():
            before.append(line(child))

    def row(cells: list) -> None:
        nonlocal held
        number, at, own = len(rows), 0, []
        held = sorted(h for h in held if h[2] > number)
        i = 0
        for cell in cells:
            if isinstance(cell, str) or cell.name not in ("td", "th"):
                stray(cell)
                continue
            if not cell.visible():
                continue
            while i < len(held) and held[i][0] <= at:
                at, i = max(at, held[i][1]), i + 1
            text = line(cell)
            if text:
                own.append((at, text))
            end = at + cell.number("colspan", 1, 1, MAX_COLSPAN)
            down = cell.number("rowspan", 1, 0, MAX_ROWSPAN) or MAX_ROWSPAN
            if down > 1 and at < MAX_HELD:
                held.append((at, end, number + down))
            at = end
        rows.append(own)

    def part(parent: Node) -> None:
        nonlocal held
        loose: list = []
        for child in parent.children:
            is_cell = not isinstance(child, str) and child.name in ("td", "th")
            if loose and not is_cell and (not isinstance(child, str) or child.strip()):
                row(loose)
                loose = []
            if is_cell:
                loose.append(child)
            elif isinstance(child, str):
                stray(child)
            elif child.visible():
                if child.name == "tr":
                    row(child.children)
                elif child.name in ("thead", "tbody", "tfoot"):
                    held = []
                    part(child)
                    held = []
                else:
                    before.append(line(child))
        if loose:
            row(loose)

    def line(cell: Node) -> str:
        page = Page()
        wrapped = Node("#root")
        wrapped.children = cell.children
        if cell.name in ("select", "input", "img", "textarea", "option", "button"):
            wrapped.children = [cell]
        walk(wrapped, page, tables)
        page.end_line()
        return " ".join(x.strip() for x in page.lines if x.strip())

    part(node)
    wide: dict[int, int] = {}
    for own in rows:
        for at, text in own:
            if len(text) <= MAX_WIDTH:
                wide[at] = max(wide.get(at, 0), len(text))
            else:
                wide.setdefault(at, 0)
    left, room = {}, 0
    for at in sorted(wide):
        left[at] = room
        room = min(room + wide[at] + 2, MAX_LINE)
    lines = []
    for own in rows:
        out, length = [], 0
        for at, text in own:
            gap = max(left[at] - length, 2 if length else 0)
            out += [" " * gap, text]
            length += gap + len(text)
        lines.append("".join(out).rstrip())
    return [x for x in before if x] + [x for x in lines if x.strip()]


def render(page: str | None) -> str | None:
    if page is None:
        return None
    out = Page()
    walk(parse(page), out)
    out.end_line()
    return "\n".join(out.lines).strip("\n")


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) of every page."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(render, batch.column(1).to_pylist()), pa.string())], names=["page_id", "text"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    return map_arrow(rows, work, f"page_id {pages.schema[id_col].dataType.simpleString()}, text string")


def op7_layout_html(pages: DataFrame) -> DataFrame:
    return extract(pages)
