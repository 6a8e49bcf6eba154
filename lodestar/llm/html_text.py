"""Visible text of web pages by a small layout: tree, visibility, blocks, tables.

Three steps per page: a tree builder reads tags in order, closes what HTML lets
authors leave open (paragraphs, list items, cells, rows, options) and wraps
stray rows; visibility rules drop what a browser doesn't show; a renderer walks
the tree and writes text as it would stand on the page:

* blocks stand on lines of their own; paragraphs, headings, lists, quotes and
  tables are set off by an empty line; space runs are one space, except in pre;
* list items have a bullet or their number, nested lists are indented by two;
* table cells are aligned in columns as wide as their widest line, by " | ";
* a text area shows its text, a drop-down its chosen option (the first without a
  choice), a list of choices all of them; a cell keeps its columns in the rows it spans;
* br breaks a line, hr is a line of dashes, images give their alt text.

Not visible: head, script, style, template, noscript and other data elements;
``hidden``, ``aria-hidden="true"``, ``display:none`` and ``visibility:hidden``
(inline or by a plain class, id or tag rule of the page's own style sheets, the
last one for a selector; rules for other media or sizes than a screen's don't count);
input of type hidden; closed details beyond their summary; comments.

* A null page gives null; a page without visible text the empty string.
* All walks use explicit stacks, so depth is bounded by memory only; a table
  nested deeper than TABLES levels is rendered as plain blocks.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources.storage import ship_package

#: Fixed values of HTML: element groups by name.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset(
    "head script style template noscript title meta link base iframe object audio video canvas svg math "
    "datalist noframes noembed col colgroup param source track".split()
)
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol p pre search section summary table "
    "caption ul tbody thead tfoot tr td th".split()
)
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption html body summary legend".split()) | {"hr"}

#: Opening one of these closes an open one of those, up to the nearest fence.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
TABLES = 8
LISTS = frozenset({"ul", "ol", "menu", "dir"})

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:"[^"]*"|'[^']*'|[^"'>])*+)>""")
#: Characters within which nearly every tag ends; longer ones are found by ``_TagEnds``.
SHORT_TAG = 2000
_NAME_END, _SIGN = re.compile(r"[\s/>]"), re.compile(r"""["'>]""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACES = re.compile(r"[ \t\n\f\r]+")
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_CSS_PIECE = re.compile(r"[^{};]*([{};])")
_SELECTOR = re.compile(r"[.#]?[\w-]+")
_SCREEN = re.compile(r"(?:only\s+)?(?:all|screen)", re.I)
_HIDES = {"display": {"none"}, "visibility": {"hidden", "collapse"}}
_HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)


def _number(text: str | None, other: int, most: int) -> int:
    """A decimal attribute up to ``most``; ``other`` if it is none."""
    text = (text or "").strip()
    if not (text.isascii() and text.isdecimal()):
        return other
    text = text.lstrip("0") or "0"
    # Digits are counted first: a page may hold any number of them.
    return most if len(text) > len(str(most)) else min(int(text), most)


class Node:
    """An element; ``children`` are nodes and strings."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def attribute(self, name: str) -> str | None:
        if name not in self.attrs.lower():
            return None
        for m in _ATTRIBUTE.finditer(self.attrs):
            if m[1].lower() == name:
                return html.unescape(next((g for g in m.groups()[1:] if g is not None), ""))
        return None


class _Builder:
    """Open elements as a stack; ``open`` counts them by tag, so that searches for absent ones are free."""

    def __init__(self):
        self.root = Node("html")
        self.stack = [self.root]
        self.open: dict[str, int] = {"html": 1}

    def push(self, tag: str, attrs: str) -> None:
        node = Node(tag, attrs)
        self.stack[-1].children.append(node)
        self.stack.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1

    def pop(self) -> None:
        if len(self.stack) > 1:
            self.open[self.stack.pop().tag] -= 1

    def close_to(self, tags: set[str], fence: set[str]) -> None:
        """Closes the nearest open element of ``tags`` unless one of ``fence`` stands above it."""
        if not any(self.open.get(t) for t in tags):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[at].tag
            if tag in tags:
                while len(self.stack) > at:
                    self.pop()
                return
            if tag in fence:
                return

    def start(self, tag: str, attrs: str) -> None:
        if tag == "html":
            return
        if tag in CLOSES_P:
            self.close_to({"p"}, {"table", "td", "th", "button", "caption"})
        if tag in IMPLIED:
            closed, fence = IMPLIED[tag]
            if tag in ("tr", "tbody", "thead", "tfoot"):
                self.close_to({"td", "th", "caption"}, {"table"})
            if tag in ("tbody", "thead", "tfoot"):
                self.close_to({"tr"}, {"table"})
            self.close_to(closed, fence)
        if tag in ("td", "th") and self.open.get("table") and self.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.push("tr", "")
        if tag in VOID:
            self.stack[-1].children.append(Node(tag, attrs))
        else:
            self.push(tag, attrs)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif self.open.get(tag) and tag != "html":
            fence = {"table"} if tag not in ("table", "body") else set()
            self.close_to({tag}, fence - {tag})


class _TagEnds:
    """Where tags of a page end, each answer following from signs that are listed once.

    A tag ends at the first ``>`` outside quotes. What follows a sign is the same
    for all tags that come to it, so it is remembered: tags that never end cost
    their own length only.
    """

    def __init__(self, page: str):
        self._page, self._length = page, len(page)
        self._signs = [m.start() for m in _SIGN.finditer(page)]
        self._places = {q: [p for p in self._signs if page[p] == q] for q in "\"'"}
        self._names = [m.start() for m in _NAME_END.finditer(page)]
        self._known: dict[int, int] = {}

    def _next(self, places: list[int], at: int) -> int:
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def find(self, lt: int) -> re.Match | None:
        """The match of the tag at ``lt``, if it is one that ends."""
        start = lt + 1 + self._page.startswith("/", lt + 1)
        if not (start < self._length and self._page[start].isascii() and self._page[start].isalpha()):
            return None
        name_end = self._next(self._names, start)
        end = self._end(name_end) if name_end >= 0 else -1
        return _TAG.match(self._page, lt, end + 1) if end >= 0 else None

    def _end(self, at: int) -> int:
        passed = []
        while True:
            sign = self._next(self._signs, at)
            if sign < 0 or sign in self._known:
                end = self._known.get(sign, -1)
                break
            passed.append(sign)
            if self._page[sign] == ">":
                end = sign
                break
            close = self._next(self._places[self._page[sign]], sign + 1)
            if close < 0:
                end = -1
                break
            at = close + 1
        for sign in passed:
            self._known[sign] = end
        return end


def parse(page: str) -> Node:
    """The tree of a page, in time linear in its length but for look-ups in sorted places."""
    build = _Builder()
    at, n = 0, len(page)
    ends: _TagEnds | None = None
    lowered: str | None = None
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            build.stack[-1].children.append(page[at:])
            break
        if lt > at:
            build.stack[-1].children.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        match = _TAG.match(page, lt, lt + SHORT_TAG) if ends is None else ends.find(lt)
        if not match and ends is None and n - lt > SHORT_TAG:
            # Tags that go on for long: from here on their ends are looked up.
            ends = _TagEnds(page)
            match = ends.find(lt)
        if not match:
            # Not a tag, or one that never ends: its sign is text.
            nxt = page.find("<", lt + 1)
            build.stack[-1].children.append(page[lt : nxt if nxt > 0 else n])
            at = nxt if nxt > 0 else n
            continue
        at = match.end()
        tag, attrs = match[2].lower(), match[3]
        if match[1]:
            build.end(tag)
        elif tag in RAW:
            if lowered is None:
                lowered = page.lower() if len(page.lower()) == n else page
            end = lowered.find(f"</{tag}", at)
            node = Node(tag, attrs)
            node.children.append(page[at : end if end >= 0 else n])
            build.stack[-1].children.append(node)
            close = page.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else n
        else:
            build.start(tag, attrs)
            if attrs.endswith("/") and tag in ("svg", "math", "path"):
                build.end(tag)
    return build.root


def _on_screen(media: str) -> bool:
    """Whether a media list holds on any screen, whatever its size."""
    return not media.strip() or any(_SCREEN.fullmatch(part.strip()) for part in media.split(","))


def _plain_rules(css: str) -> Iterator[tuple[str, str]]:
    """Selector list and declarations of the rules that hold on any screen, in order."""
    css = _CSS_COMMENT.sub(" ", css)
    # Open blocks: True for a group of rules that holds, False for one to be skipped.
    groups: list[bool] = []
    selectors: str | None = None
    declared: list[str] = []
    for m in _CSS_PIECE.finditer(css + "}"):
        head, sign = m[0][:-1].strip(), m[1]
        if sign == "{":
            name, _, rest = head.partition("(" if head.lower().startswith("@media(") else " ")
            name = name.lower()
            inside = not groups or groups[-1]
            if name == "@media":
                groups.append(inside and _on_screen(head[len("@media") :]))
            elif name.startswith(("@supports", "@layer")):
                groups.append(inside)
            elif head.startswith("@") or selectors is not None:
                groups.append(False)
            else:
                groups.append(inside)
                selectors, declared = head, []
                depth = len(groups)
        elif sign == ";":
            if selectors is not None and len(groups) == depth:
                declared.append(head)
        elif groups:
            if selectors is not None and len(groups) == depth:
                if groups[-1]:
                    yield selectors, ";".join([*declared, head])
                selectors = None
            groups.pop()


def hiding_rules(root: Node) -> set[str]:
    """Plain selectors (``.class``, ``#id``, ``tag``) that the page's style sheets hide."""
    # Per selector and property: whether the value that wins is important, and whether it hides.
    values: dict[str, dict[str, tuple[bool, bool]]] = {}
    stack: list = [root]
    while stack:
        node = stack.pop()
        if node.tag != "style":
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
            continue
        if not _on_screen(node.attribute("media") or ""):
            continue
        for selectors, declarations in _plain_rules("".join(node.children)):
            names = [s for s in map(str.strip, selectors.split(",")) if _SELECTOR.fullmatch(s)]
            for declaration in declarations.split(";"):
                name, _, value = declaration.partition(":")
                name, (value, _, mark) = name.strip().lower(), value.lower().partition("!")
                if name not in _HIDES:
                    continue
                important = mark.strip() == "important"
                for selector in names:
                    own = values.setdefault(selector, {})
                    if important or not own.get(name, (False,))[0]:
                        own[name] = important, value.strip() in _HIDES[name]
    return {selector for selector, own in values.items() if any(hides for _, hides in own.values())}


def visible(node: Node, hidden: set[str]) -> bool:
    if node.tag in UNSEEN or node.tag in hidden:
        return False
    if not node.attrs:
        return True
    low = node.attrs.lower()
    if "hidden" in low:
        if node.attribute("hidden") is not None or (node.attribute("aria-hidden") or "").strip().lower() == "true":
            return False
        if node.tag == "input" and (node.attribute("type") or "").lower() == "hidden":
            return False
    if "style" in low and _HIDING.search(node.attribute("style") or ""):
        return False
    if hidden and ("class" in low or "id" in low):
        names = {"." + c for c in (node.attribute("class") or "").split()} | {"#" + (node.attribute("id") or "")}
        return not names & hidden
    return True


class _Page:
    """Lines written so far; ``gap`` is the empty lines owed before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = 0
        self.indent = 0
        self.mark = ""

    def break_line(self, apart: bool = False) -> None:
        text = "".join(self.parts).strip(" ")
        self.parts = []
        if text:
            self._write(text)
        self.gap = max(self.gap, int(apart))

    def _write(self, text: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = 0
        lead = " " * max(0, self.indent - len(self.mark)) + self.mark
        self.mark = ""
        self.lines.append(lead + text)

    def text(self, text: str) -> None:
        if self.parts and self.parts[-1].endswith(" ") or not self.parts:
            text = text.lstrip(" ")
        if text:
            self.parts.append(text)

    def pre_line(self) -> None:
        """Ends a line of preformatted text; its spaces stay."""
        line, self.parts = "".join(self.parts), []
        self.block([line])

    def block(self, lines: list[str]) -> None:
        """Lines to be kept as they are."""
        self.break_line()
        for line in lines:
            if line.strip():
                self._write(line.rstrip())
            elif self.lines and self.lines[-1]:
                self.lines.append("")


def render(root: Node, hidden: set[str], depth: int = 0) -> list[str]:
    """Lines of the visible text below ``root``."""
    page = _Page()
    # Entries are nodes and strings to write, or actions for the end of an element.
    stack: list = [(child, False) for child in reversed(root.children)]
    counters: list[list] = []
    while stack:
        item, pre = stack.pop()
        if callable(item):
            item()
            continue
        if isinstance(item, str):
            text = html.unescape(item).replace("\xa0", " ") if "&" in item or "\xa0" in item else item
            if pre:
                first, *others = text.split("\n")
                page.parts.append(first.expandtabs(4))
                for line in others:
                    page.pre_line()
                    page.parts = [line.expandtabs(4)]
            else:
                page.text(_SPACES.sub(" ", text))
            continue
        node: Node = item
        tag = node.tag
        if not visible(node, hidden):
            continue
        if tag == "br":
            page.break_line()
        elif tag == "hr":
            page.break_line(apart=True)
            page.block(["-" * 20])
            page.gap = 1
        elif tag == "img":
            page.text(_SPACES.sub(" ", node.attribute("alt") or ""))
        elif tag == "input":
            if (node.attribute("type") or "text").lower() in ("submit", "button", "reset"):
                page.text(node.attribute("value") or "")
        elif tag == "select":
            # A list of choices shows all of them, a drop-down the chosen one.
            for option in _shown_options(node, hidden):
                stack.append((" ", False))
                stack.extend((child, False) for child in reversed(option.children))
        elif tag == "table" and depth < TABLES:
            page.break_line(apart=True)
            page.block(_table(node, hidden, depth + 1))
            page.break_line(apart=True)
        elif tag in BLOCK:
            _open_block(page, node, tag, stack, counters, pre)
        else:
            stack.extend((child, pre) for child in reversed(node.children))
    page.break_line()
    while page.lines and not page.lines[-1]:
        page.lines.pop()
    return page.lines


def _shown_options(select: Node, hidden: set[str]) -> list[Node]:
    """Options of a select that a page shows, last first."""
    options: list[Node] = []
    stack: list = list(reversed(select.children))
    while stack:
        node = stack.pop()
        if isinstance(node, Node) and visible(node, hidden):
            if node.tag == "option":
                options.append(node)
            else:
                stack.extend(reversed(node.children))
    if select.attribute("multiple") is not None or _number(select.attribute("size"), 1, 1000) > 1:
        return options[::-1]
    chosen = [o for o in options if o.attribute("selected") is not None] or options[:1]
    return chosen[-1:]


def _open_block(page: _Page, node: Node, tag: str, stack: list, counters: list, pre: bool) -> None:
    """Breaks the line, sets marks and indents, and leaves the end of the block on the stack."""
    nested = tag in LISTS and bool(counters)
    apart = tag in APART and not nested
    page.break_line(apart)
    before = page.indent
    if tag in LISTS:
        start = _number(node.attribute("start"), 1, 2**31 - 1) if tag == "ol" else 1
        counters.append([tag == "ol", start])
    elif tag == "li":
        numbered = counters and counters[-1][0]
        page.mark = f"{counters[-1][1]}. " if numbered else "* "
        if numbered:
            counters[-1][1] += 1
        page.indent += max(2, len(page.mark))
    elif tag in ("dd", "blockquote"):
        page.indent += 2
    children = node.children
    if tag == "details" and node.attribute("open") is None:
        children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]

    def close() -> None:
        if tag == "pre":
            page.pre_line()
        page.break_line(apart)
        page.indent = before
        if tag in LISTS:
            counters.pop()
        if tag == "li":
            page.mark = ""

    stack.append((close, False))
    stack.extend((child, pre or tag == "pre") for child in reversed(children))


def _rows(table: Node, hidden: set[str]) -> tuple[list[list[Node]], list[Node | str]]:
    """Cells of each visible row of this table (not of nested ones), and its captions and stray text."""
    rows: list[list[Node]] = []
    captions: list[Node | str] = []
    stack: list = [c for c in reversed(table.children) if isinstance(c, Node)]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            if node.strip():
                captions.append(node)
            continue
        if not visible(node, hidden):
            continue
        if node.tag == "caption":
            captions.append(node)
        elif node.tag == "tr":
            cells = [c for c in node.children if isinstance(c, Node) and c.tag in ("td", "th")]
            rows.append([c for c in cells if visible(c, hidden)])
            stray = [c for c in node.children if isinstance(c, str) or c.tag not in ("td", "th")]
            stack.extend(reversed(stray))
        elif node.tag in ("td", "th"):
            rows.append([node])
        elif node.tag in ("tbody", "thead", "tfoot"):
            stack.extend(reversed(node.children))
        else:
            captions.append(node)  # misplaced content stands before the table
    return rows, captions


def _table(table: Node, hidden: set[str], depth: int) -> list[str]:
    """Aligned lines of a table; a cell that spans columns leaves the others empty."""
    rows, captions = _rows(table, hidden)
    lines: list[str] = []
    holder = Node("div")
    holder.children = [c for c in table.children if isinstance(c, str) and c.strip()] + captions
    if holder.children:
        lines += render(holder, hidden, depth)
    grid: list[list[list[str]]] = []
    # Columns that a cell of an earlier row goes on to fill, with the rows left of it.
    taken: dict[int, int] = {}
    for row in rows:
        cells: list[list[str]] = []
        going = {k: n - 1 for k, n in taken.items() if n > 1}

        def skip_taken() -> None:
            while len(cells) in taken:
                cells.append([])

        for cell in row:
            skip_taken()
            # Browsers limit a span to 1000 columns and 65534 rows; 0 rows are all that follow.
            across = max(1, _number(cell.attribute("colspan"), 1, 1000))
            down = _number(cell.attribute("rowspan"), 1, 65534) or 65534
            if down > 1:
                going.update((len(cells) + k, down - 1) for k in range(across))
            cells.append(render(cell, hidden, depth))
            cells.extend([] for _ in range(across - 1))
        taken = going
        while cells and not cells[-1]:
            cells.pop()
        if cells:
            grid.append(cells)
    widths = [0] * max((len(r) for r in grid), default=0)
    for row in grid:
        for k, cell in enumerate(row[:-1]):
            widths[k] = max([widths[k], *map(len, cell)])
    for row in grid:
        for level in range(max(map(len, row))):
            parts = [(c[level] if level < len(c) else "").ljust(widths[k] if k < len(row) - 1 else 0) for k, c in enumerate(row)]
            lines.append(" | ".join(parts).rstrip())
    return lines


def visible_text(page: str | None) -> str | None:
    if page is None:
        return None
    root = parse(page)
    return "\n".join(render(root, hiding_rules(root)))


def page_text(pages: DataFrame, html_column: str = "html", output: str = "page_text") -> DataFrame:
    """``pages`` with ``output`` (replaced if there is one), the visible text of ``html_column``.

    Only the html column passes through Python.
    """
    ship_package(pages.sparkSession)

    @F.pandas_udf("string")
    def extract(values):
        return values.map(visible_text, na_action="ignore")

    return pages.withColumn(output, extract(F.col(html_column)))
