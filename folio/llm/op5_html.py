"""Text of HTML pages as a reader sees it: a tree builder and a renderer that keeps the layout.

The builder follows the public parsing rules that matter for text: void elements, raw-text elements,
tags implied by their neighbours (p, li, dt, dd, option, table parts), end tags without a start ignored,
elements without an end closed by their parents. Nesting beyond ``DEPTH`` elements continues as siblings,
as browsers do, and what is hidden there stays hidden. A page is read once from front to back: a tag whose
quotes never close ends at its first ``>``, and from there on quotes count for nothing.

The renderer leaves out what isn't shown (head, scripts, styles, templates, comments, ``hidden``,
``display:none``, ``visibility:hidden`` but for visible elements in it, hidden inputs, options that aren't
chosen, drawings but for their text) and emits all other text, formulas included: white space collapsed
outside ``pre``, blocks on lines of their own with a blank line around paragraphs, headings, lists and tables,
list markers with indentation, and table cells in aligned columns.

Null and empty pages give an empty text, as do pages without visible text. Rows that repeat are each
rendered; other columns pass through, and an input column named like an output is replaced.
"""

from __future__ import annotations

import html
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import words as W

DEPTH = 400
MAX_PAD = 40

# Element names by their roles in the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes datalist audio video canvas object defs desc metadata annotation annotation-xml".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary ul optgroup option table caption tr td th thead tbody tfoot".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl blockquote pre figure table hr fieldset".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt summary".split())
#: An open element of the set ends when the tag starts, unless one of the walls stands between.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "thead": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
}
#: End tags don't reach through these.
WALLS = frozenset("table td th caption template body html".split())
INLINE_FORMAT = frozenset("a b i em strong span u s small font code tt big label q cite abbr sub sup mark".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_GONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)


class Element:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip(" \t\r\n\f/") else {}


class _Tree:
    """Open elements of a page under construction. Beyond DEPTH only their tags are held, and content goes to the
    deepest element that the tree has, unless one of them hides it."""

    def __init__(self) -> None:
        self.root = Element("html", {})
        self.stack = [self.root]
        self.open = Counter(["html"])
        self.deep: list[str] = []
        self.deep_open: Counter[str] = Counter()
        self.hides: int | None = None

    def add(self, child: Element | str) -> None:
        if self.hides is None:
            self.stack[-1].children.append(child)

    def push(self, node: Element) -> None:
        if len(self.stack) < DEPTH:
            self.stack.append(node)
            self.open[node.tag] += 1
            return
        self.deep.append(node.tag)
        self.deep_open[node.tag] += 1
        if self.hides is None and (hidden(node) or sight(node, True) is False):
            self.hides = len(self.deep) - 1

    def cut(self, i: int) -> None:
        """End the open elements from the i-th on."""
        for node in self.stack[i:]:
            self.open[node.tag] -= 1
        del self.stack[i:]
        self.deep, self.hides = [], None
        self.deep_open.clear()

    def close(self, tags: frozenset[str], walls: frozenset[str]) -> None:
        """End open elements of these tags, but for those behind a wall."""
        while not self.deep and any(self.open[t] for t in tags):
            at = next((i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].tag in tags or self.stack[i].tag in walls), 0)
            if not at or self.stack[at].tag not in tags:
                return
            self.cut(at)

    def end(self, tag: str) -> None:
        if self.deep_open[tag]:
            while True:
                top = self.deep.pop()
                self.deep_open[top] -= 1
                if top == tag:
                    break
            if self.hides is not None and self.hides >= len(self.deep):
                self.hides = None
            return
        if not self.open[tag]:
            return
        through = tag in ("table", "tr", "thead", "tbody", "tfoot", "body", "html")
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                return self.cut(i)
            if self.stack[i].tag in WALLS and not (through and self.stack[i].tag != "table"):
                return


def parse(page: str) -> Element:
    """The tree of a page; its root has the tag ``html``."""
    tree = _Tree()
    at, end, quotes = 0, len(page), True
    while at < end:
        sign = page.find("<", at)
        if sign != at:
            tree.add(html.unescape(page[at : sign if sign >= 0 else end]))
            if sign < 0:
                break
        after = page[sign + 1 : sign + 4]
        if after == "!--":
            stop = page.find("-->", sign + 4)
            at = end if stop < 0 else stop + 3
            continue
        if after[:1] in ("!", "?"):
            at = page.find(">", sign) + 1 or end
            continue
        name = _NAME.match(page, sign + (2 if after[:1] == "/" else 1))
        if name is None:
            tree.add("<")
            at = sign + 1
            continue
        tag = name[0].lower()
        if after[:1] == "/":
            at = page.find(">", name.end()) + 1 or end
            if tag == "br":
                tree.add(Element("br", {}))
            else:
                tree.end(tag)
            continue
        stop = _TAG_END.match(page, name.end()) if quotes else None
        if stop is None:
            quotes = False
        at = stop.end() if stop else page.find(">", name.end()) + 1
        if not at:
            break
        at = _start(tree, page, at, Element(tag, _attributes(page[name.end() : at - 1])))
    return tree.root


def _start(tree: _Tree, page: str, at: int, node: Element) -> int:
    """Put a started element into the tree; where the page goes on."""
    tag = node.tag
    if tag in ("html", "body"):
        if tag == "html" or tree.open["body"]:
            if hidden(node) or sight(node, True) is False:
                (tree.root if tag == "html" else next(e for e in tree.stack if e.tag == "body")).attributes.update(node.attributes)
            return at
        tree.close(frozenset(["head"]), frozenset())
    elif tree.stack[-1].tag == "head" and tag in BLOCKS:
        tree.cut(len(tree.stack) - 1)
    if tag in CLOSES_P:
        tree.close(frozenset(["p"]), frozenset("table td th li div section article button caption".split()))
    if tag in IMPLIED:
        tree.close(*IMPLIED[tag])
    tree.add(node)
    if tag in RAW:
        stop = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
        if tag not in UNSEEN:
            node.children.append(html.unescape(page[at : stop.start() if stop else len(page)]))
        return len(page) if stop is None else page.find(">", stop.start()) + 1 or len(page)
    if tag not in VOID:
        tree.push(node)
    return at


def hidden(node: Element) -> bool:
    """Whether nothing of the element is shown."""
    a = node.attributes
    if node.tag in UNSEEN:
        return True
    return bool(a) and ("hidden" in a or bool(_GONE.search(a.get("style", ""))) or (node.tag == "input" and a.get("type", "").lower() == "hidden"))


def sight(node: Element, now: bool) -> bool:
    """Whether the element's own text can be seen, where its parent's can or can't."""
    m = _VISIBILITY.search(node.attributes.get("style", "")) if node.attributes else None
    return m[1].lower() == "visible" if m else now


def _chosen(node: Element) -> list[Element]:
    """The options that a select shows."""
    options, todo = [], [node]
    while todo:
        x = todo.pop()
        if x.tag == "option":
            options.append(x)
        else:
            todo += [c for c in reversed(x.children) if isinstance(c, Element) and not hidden(c)]
    if "multiple" in node.attributes or node.attributes.get("size", "1").strip() not in ("", "0", "1"):
        return options
    return [x for x in options if "selected" in x.attributes][-1:] or options[:1]


def _drawn(node: Element) -> list[Element]:
    """The texts of a drawing."""
    if node.tag in ("text", "foreignobject"):
        return [node]
    return [x for c in node.children if isinstance(c, Element) and not hidden(c) for x in _drawn(c)]


class _Lines:
    """Lines under construction: collapsed inline text, and the blank lines due before what follows."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0

    def text(self, s: str) -> None:
        parts = re.split(r"[ \t\n\f\r]+", s)
        for i, part in enumerate(parts):
            if i:
                self.space = True
            if part:
                if self.now and self.space:
                    self.now.append(" ")
                self.now.append(part)
                self.space = False

    def end_line(self) -> None:
        if self.now:
            self._put("".join(self.now))
        self.now, self.space = [], False

    def _put(self, line: str) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        self.lines.append(line)

    def block(self, lines: list[str], gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)
        for line in lines:
            self._put(line)
        if lines:
            self.gap = gap

    def line_break(self) -> None:
        if self.now:
            self.end_line()
        elif self.lines:
            self.gap = max(self.gap, 1)


def _inline(node: Element, out: _Lines, pre: bool, seen: bool) -> None:
    for child in node.children:
        if isinstance(child, str):
            if not seen:
                continue
            if pre:
                first, *rest = child.split("\n")
                out.now.append(first)
                for line in rest:
                    out._put("".join(out.now))
                    out.now = [line]
            else:
                out.text(child)
        elif child.tag == "br":
            if seen:
                out.line_break()
        elif not hidden(child):
            here = sight(child, seen)
            if child.tag in BLOCKS:
                out.block(_block(child, pre, here), 1 if child.tag in SPACED else 0)
            elif child.tag == "input":
                if here and child.attributes.get("type", "").lower() in ("submit", "button", "reset") and child.attributes.get("value"):
                    out.text(f" {child.attributes['value']} ")
            elif child.tag in ("select", "svg"):
                for part in _chosen(child) if child.tag == "select" else _drawn(child):
                    out.text(" ")
                    _inline(part, out, False, sight(part, here))
                    out.text(" ")
            else:
                _inline(child, out, pre, here)


def _block(node: Element, pre: bool, seen: bool) -> list[str]:
    """The lines of an element; seen: whether its own text can be seen."""
    if node.tag == "table":
        return _table(node, seen)
    out = _Lines()
    if node.tag in ("ul", "ol", "menu", "dir"):
        try:
            number = int(node.attributes.get("start", "1"))
        except ValueError:
            number = 1
        for child in node.children:
            if isinstance(child, Element) and child.tag == "li" and not hidden(child):
                marker = f"{number}. " if node.tag == "ol" else "- "
                number += 1
                lines = _block(child, pre, sight(child, seen))
                pad = " " * len(marker)
                out.block([(marker if i == 0 else pad if line else "") + line for i, line in enumerate(lines)], 0)
            else:
                holder = Element("div", {})
                holder.children = [child]
                out.block(_indented(_block(holder, pre, seen), "  "), 0)
        return out.lines
    _inline(node, out, pre or node.tag in ("pre", "textarea"), seen)
    out.end_line()
    if node.tag == "pre":
        shown = [i for i, line in enumerate(out.lines) if line.strip()]
        out.lines = out.lines[shown[0] : shown[-1] + 1] if shown else []
    return _indented(out.lines, "  ") if node.tag in ("blockquote", "dd") else out.lines


def _indented(lines: list[str], by: str) -> list[str]:
    return [by + x if x else x for x in lines]


def _rows(node: Element, before: list[list[str]], rows: list[list[tuple[int, list[str]]]], seen: bool) -> None:
    for child in node.children:
        if isinstance(child, str):
            if seen and child.strip(" \t\n\f\r"):
                loose = _Lines()
                loose.text(child)
                loose.end_line()
                before.append(loose.lines)
        elif hidden(child):
            continue
        elif child.tag in ("thead", "tbody", "tfoot"):
            _rows(child, before, rows, sight(child, seen))
        elif child.tag == "tr":
            here, cells = sight(child, seen), []
            for cell in child.children:
                if isinstance(cell, Element) and cell.tag in ("td", "th"):
                    span = cell.attributes.get("colspan", "1")
                    cells.append((min(int(span), 1000) if span.isdigit() and int(span) else 1, [] if hidden(cell) else _block(cell, False, sight(cell, here))))
                elif isinstance(cell, Element) and not hidden(cell):
                    before.append(_block(cell, False, sight(cell, here)))
                elif isinstance(cell, str) and here and cell.strip(" \t\n\f\r"):
                    before.append([" ".join(cell.split())])
            rows.append(cells)
        elif child.tag not in ("colgroup", "col"):
            before.append(_block(child, False, sight(child, seen)))


def _table(node: Element, seen: bool) -> list[str]:
    before: list[list[str]] = []
    rows: list[list[tuple[int, list[str]]]] = []
    _rows(node, before, rows, seen)
    widths: dict[int, int] = {}
    for cells in rows:
        column = 0
        for span, lines in cells:
            if span == 1:
                widths[column] = max([widths.get(column, 0), *(min(len(x), MAX_PAD) for x in lines)])
            column += span
    out = [x for lines in before for x in lines]
    for cells in rows:
        height = max([len(lines) for _, lines in cells], default=0)
        for i in range(height):
            line, column = [], 0
            for span, lines in cells:
                room = sum(widths.get(c, 0) for c in range(column, column + span)) + 2 * (span - 1)
                line.append((lines[i] if i < len(lines) else "").ljust(room))
                column += span
            out.append("  ".join(line).rstrip())
    return out


def render(page: str | None) -> str:
    """All visible text of a page, laid out on lines."""
    if not page:
        return ""
    if sys.getrecursionlimit() < 6 * DEPTH:
        sys.setrecursionlimit(6 * DEPTH)
    root = parse(page)
    return "" if hidden(root) else "\n".join(_block(root, False, sight(root, True)))


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """Add ``text`` and ``n_lines`` to the rows of pages, in place of the page."""
    kept = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in (page.lower(), "text", "n_lines")])
    schema = T.StructType([*kept.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in W.chunks(batches, "__page"):
            texts = [render(r) for r in rows]
            columns = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n != "__page"]
            columns += [("text", pa.array(texts, pa.string())), ("n_lines", pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()))]
            yield pa.RecordBatch.from_arrays([c for _, c in columns], names=[n for n, _ in columns])

    return pages.select(*kept.columns, F.col(f"`{page}`").cast("string").alias("__page")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: per page its visible text and the number of lines."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "text", "n_lines", F.length("text").cast("long").alias("n_chars"))
