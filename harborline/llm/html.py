"""Visible text of web pages: a tree with implied tags, visibility rules and a layout of blocks, lists and tables."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

START = re.compile(r"<(?:[!?]|(/?)([a-zA-Z][^\s/>]*+))")
# All up to the end of a tag: a quote opens a value only after an equals sign.
INSIDE = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NOT_DISPLAYED = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
# Deeper elements are attached here, as browsers do.
DEEPEST = 150
# A table is aligned unless that makes it longer than this many characters and this many times its text.
PADDED_CHARS, PADDED_TIMES = 100_000, 20
# Cells span no further than this column; cells beyond it stand alone.
SPANNED_COLUMNS = 1_000

# Fixed values of the HTML standard: elements without content, with raw content, not rendered, and laid out as blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas svg math "
                   "datalist meta link base param source track".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
                  "search section summary table tbody td tfoot th thead tr ul caption".split())
# Blocks with an empty line around them.
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir article section".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
                           "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd "
                           "dt".split())
# An opening tag closes an open element of these names, looked for up to the given ancestors.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "body": ({"head"}, {"html"}),
}
# An end tag does not reach beyond these.
SCOPE = frozenset("table td th caption html".split())
PARAGRAPH_SCOPE = SCOPE | {"button", "object"}
TABLE_PARTS = frozenset("table tbody thead tfoot tr td th caption".split())
HEAD_ONLY = frozenset("title meta link base style script template noscript".split())


class Node:
    __slots__ = ("name", "attributes", "children", "unseen")

    def __init__(self, name: str, attributes: dict[str, str], unseen: bool = False):
        self.name, self.attributes, self.children = name, attributes, []
        # Inherited visibility, which an element inside can turn on again.
        styled = VISIBILITY.findall(attributes["style"]) if "style" in attributes else ()
        self.unseen = styled[-1].lower() != "visible" if styled else unseen


def _tags(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, inside) of all tags, comments (without a name) and declarations, in order.

    Send a position to go on from there. Each character is read a bounded number of times: a value whose quote never
    closes is met once for each kind of quote, and tags up to it end at their first >. Without a > ahead the rest is text.
    """
    at, broken_to = 0, -1
    last = source.rfind(">")
    while m := START.search(source, at):
        if source.startswith("<!--", m.start()):
            end = source.find("-->", m.start() + 4)
            found = m.start(), end + 3 if end >= 0 else len(source), "", "", ""
        elif m[2] is None:
            end = source.find(">", m.end())
            found = m.start(), end + 1 if end >= 0 else len(source), "", "", ""
        elif m.end() > last:
            at = m.end()
            continue
        else:
            end = len(source)
            if m.start() >= broken_to:
                end = INSIDE.match(source, m.end()).end()
                if source[end : end + 1] != ">":
                    broken_to, end = end, len(source)
            if end == len(source):
                end = source.find(">", m.end())
            found = m.start(), end + 1, m[1], m[2].lower(), source[m.end() : end]
        at = (yield found) or found[1]


def parse_tree(source: str) -> Node:
    """Tree of elements and text with implied start and end tags. Any text gives a tree, in time linear in its length."""
    root = Node("html", {})
    stack = [root]
    opened = Counter()
    at = 0

    def open_(node: Node) -> None:
        stack.append(node)
        opened[node.name] += 1

    def leave(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop().name] -= 1

    def close(names: set[str], stop: set[str] | frozenset[str]) -> None:
        if not any(opened[n] for n in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                leave(k)
                return
            if stack[k].name in stop:
                return

    def add_text(text: str) -> None:
        if text:
            if stack[-1].name == "head" and not text.isspace():
                leave(len(stack) - 1)
            if not stack[-1].unseen:
                stack[-1].children.append(text)

    tags = _tags(source)
    tag = next(tags, None)
    while tag:
        start, end, slash, name, inside = tag
        add_text(entities.unescape(source[at:start]))
        at = end
        goto = None
        if not name or name == "html":
            pass
        elif slash:
            if name == "p" and not opened["p"]:
                _child(stack[-1], "p", {})
            elif name == "br":
                _child(stack[-1], "br", {})
            else:
                close({name}, ({"table", "html"} if name in TABLE_PARTS else SCOPE) - {name})
        else:
            if stack[-1].name == "head" and name not in HEAD_ONLY:
                leave(len(stack) - 1)
            if name in ENDS_PARAGRAPH:
                close({"p"}, PARAGRAPH_SCOPE)
            if name in IMPLIED_END:
                close(*IMPLIED_END[name])
            if name in ("td", "th") and stack[-1].name in ("table", "tbody", "thead", "tfoot"):
                open_(_child(stack[-1], "tr", {}))
            attributes = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(inside)} if inside else {}
            node = _child(stack[-1], name, attributes)
            if name in RAW:
                ending = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                goto = source.find(">", ending.end()) + 1 if ending else 0
                text = source[at : ending.start() if goto else len(source)]
                if not node.unseen:
                    node.children.append(entities.unescape(text) if name == "textarea" else text)
                goto = at = goto or len(source)
            elif name not in VOID and len(stack) < DEEPEST:
                open_(node)
        try:
            tag = tags.send(goto)
        except StopIteration:
            break
    add_text(entities.unescape(source[at:]))
    return root


def _child(parent: Node, name: str, attributes: dict[str, str]) -> Node:
    node = Node(name, attributes, parent.unseen)
    parent.children.append(node)
    return node


def visible(node: Node) -> bool:
    a = node.attributes
    return not (node.name in UNSEEN or "hidden" in a or (node.name == "dialog" and "open" not in a)
                or ("style" in a and NOT_DISPLAYED.search(a["style"])))


class Layout:
    """Lines of text with at most one empty line between them."""

    def __init__(self):
        self.lines: list[str] = []
        self.run: list[str] = []
        self.gap = False

    def text(self, value: str, kept: bool) -> None:
        if kept:
            first, *more = value.split("\n")
            self.run.append(first)
            for line in more:
                self.flush(kept=True)
                self.run.append(line)
        else:
            self.run.append(SPACE.sub(" ", value))

    def flush(self, kept: bool = False) -> None:
        line = "".join(self.run)
        self.run = []
        if not kept:
            line = SPACE.sub(" ", line).strip(" ")
        if line or kept:
            self.put([line.rstrip(" ")])

    def put(self, lines: list[str]) -> None:
        if not lines:
            return
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        self.lines.extend(lines)

    def space(self) -> None:
        self.flush()
        self.gap = True


def _lay_out(node: Node, out: Layout, kept: bool = False) -> None:
    for child in node.children:
        if isinstance(child, str):
            out.text(child, kept)
            continue
        name = child.name
        if not visible(child):
            continue
        if name == "br":
            if kept:
                out.flush(kept=True)
            else:
                out.flush()
        elif name in ("ul", "ol", "menu", "dir"):
            _list(child, out)
        elif name == "select":
            _select(child, out)
        elif name == "table":
            out.space()
            out.put(_table(child))
            out.gap = True
        elif name in BLOCK:
            spaced = name in SPACED
            out.flush()
            out.gap = out.gap or spaced
            if name == "details" and "open" not in child.attributes:
                child = _with(child, [x for x in child.children if isinstance(x, Node) and x.name == "summary"][:1])
            if name == "dd":
                inner = Layout()
                _lay_out(child, inner)
                inner.flush()
                out.put([f"  {x}".rstrip() for x in inner.lines])
            else:
                _lay_out(child, out, kept or name == "pre")
                out.flush(kept=name == "pre" and any(out.run))
            out.gap = out.gap or spaced
        else:
            _lay_out(child, out, kept or name in ("textarea", "xmp"))


def _list(node: Node, out: Layout) -> None:
    out.space()
    number = node.attributes.get("start", "1")
    number = int(number) if number.lstrip("-").isdigit() and len(number) < 9 else 1
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                out.text(child, False)
            continue
        if not visible(child):
            continue
        inner = Layout()
        _lay_out(child, inner) if child.name == "li" else _lay_out(_wrapped(child), inner)
        inner.flush()
        if child.name == "li":
            value = child.attributes.get("value", "")
            number = int(value) if value.isdigit() and len(value) < 9 else number
            mark = f"{number}. " if node.name == "ol" else "- "
            number += 1
        else:
            mark = "  "
        out.flush()
        lines = [x for x in inner.lines if x]
        out.put([(mark if i == 0 else " " * len(mark)) + x for i, x in enumerate(lines)])
    out.flush()
    out.gap = True


def _with(node: Node, children: list[Node | str]) -> Node:
    box = Node(node.name, {})
    box.children.extend(children)
    return box


def _wrapped(node: Node) -> Node:
    return _with(Node("div", {}), [node])


def _options(node: Node) -> Iterator[Node]:
    for child in node.children:
        if isinstance(child, Node) and visible(child):
            if child.name == "option":
                yield child
            else:
                yield from _options(child)


def _select(node: Node, out: Layout) -> None:
    """A list box shows all options and the labels of its groups, a closed menu the selected option or the first."""
    if "multiple" in node.attributes or node.attributes.get("size", "1") not in ("", "0", "1"):
        out.flush()
        _lay_out(node, out)
        out.flush()
        return
    options = list(_options(node))
    chosen = [o for o in options if "selected" in o.attributes][-1:] or options[:1]
    for option in chosen:
        _lay_out(option, out)


def _span(node: Node, name: str) -> int:
    value = node.attributes.get(name, "")
    return min(1000, int(value)) if value.isdigit() and len(value) < 5 and int(value) > 0 else 1


def _table(node: Node) -> list[str]:
    """Rows with cells padded to their columns, two spaces apart; a spanned place is left empty.

    Text of the table or of a row outside all cells stands before it. Where one very wide cell would pad many rows, cells
    stay two spaces apart and are not aligned.
    """
    before, rows = [], []

    def gather(parent: Node) -> None:
        for child in parent.children:
            if isinstance(child, str) or not visible(child):
                if isinstance(child, str) and child.strip():
                    before.append(SPACE.sub(" ", child).strip())
            elif child.name in ("thead", "tbody", "tfoot"):
                gather(child)
            elif child.name == "tr":
                before.extend(SPACE.sub(" ", c).strip() for c in child.children if isinstance(c, str) and c.strip())
                rows.append([c for c in child.children if not isinstance(c, str) and visible(c)])
            else:
                inner = Layout()
                _lay_out(_wrapped(child), inner)
                inner.flush()
                before.extend(inner.lines)

    gather(node)
    # Filled places only: (column, lines) of each row, and the first row below each column that is free again.
    grid: list[list[tuple[int, list[str]]]] = []
    free: dict[int, int] = {}
    width: dict[int, int] = {}
    for r, cells in enumerate(rows):
        line: list[tuple[int, list[str]]] = []
        column = 0
        for cell in cells:
            while free.get(column, 0) > r:
                column += 1
            inner = Layout()
            _lay_out(cell if cell.name in ("td", "th") else _wrapped(cell), inner)
            inner.flush()
            lines = [x for x in inner.lines if x]
            if lines:
                line.append((column, lines))
                width[column] = max(width.get(column, 0), *map(len, lines))
            after = max(column + 1, min(SPANNED_COLUMNS, column + _span(cell, "colspan")))
            below = r + _span(cell, "rowspan")
            if below > r + 1 and after <= SPANNED_COLUMNS:
                free.update((k, below) for k in range(column, after))
            column = after
        grid.append(line)
    starts, total = {}, 0
    for column in sorted(width):
        starts[column] = total
        total += width[column] + 2
    text = sum(len(x) for line in grid for _, lines in line for x in lines)
    padded = sum(starts[line[-1][0]] * max(len(lines) for _, lines in line) for line in grid if line)
    aligned = padded <= max(PADDED_CHARS, PADDED_TIMES * text)
    out = before
    for line in grid:
        for i in range(max((len(lines) for _, lines in line), default=0)):
            parts, length = [], 0
            for column, lines in line:
                if i < len(lines):
                    gap = starts[column] - length if aligned else 2 * bool(parts)
                    parts += [" " * gap, lines[i]]
                    length += gap + len(lines[i])
            out.append("".join(parts).rstrip())
    return out


def visible_text(source: str | None) -> str | None:
    """All visible text of a page, laid out in lines. NULL stays NULL."""
    if source is None:
        return None
    out = Layout()
    root = parse_tree(source)
    _lay_out(root, out)
    out.flush()
    return "\n".join(out.lines).strip("\n").replace(" ", " ")


def _texts(pages: pd.Series) -> pd.Series:
    return pd.Series([visible_text(x) for x in pages], dtype=object)


def rendered(page: Column) -> Column:
    return F.pandas_udf(_texts, "string")(page)


def extract_pages(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """The id and `text` of every page, and `n_chars`, its length.

    NULL pages give NULL text, empty ones and ones without visible text an empty text. Broken markup never fails and
    takes time linear in its length. Repeated rows and NULL ids are rows like any other. An empty table gives no rows;
    extra columns are not read. Visibility comes from elements, attributes and their `style`; rules of style sheets and
    anything a script would do are out of scope. Closed `details` show their summary, closed menus one option.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_column), rendered(F.col(html_column)).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
