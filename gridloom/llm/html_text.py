"""HTML extraction: a tree builder with implied tags, and a renderer that keeps the layout of visible text.

``build`` reads tags, comments, character references and raw-text elements into a tree: missing html, head, body, tbody
and tr are implied, an opening block ends an open paragraph, li, dt, dd, option, rows and cells end their like, an end
tag closes what is open inside, and one without a start is passed over (``</p>`` and ``</br>`` excepted). Nothing recurses,
and open elements are found by name, so time grows in proportion to the page however deep or misnested its tags are.

``render`` writes all visible text. Hidden: scripts, styles, the head, templates and other elements without own text,
the hidden attribute, closed details but for the summary, closed dialogs, and display:none or visibility:hidden by style
attribute or by a style sheet's rules (tags, classes, ids and attributes, also several on one element, its parents or
ancestors; the most specific rule wins; rules for other media than screens, with pseudo-classes or for siblings are passed
over). White space collapses outside pre and textarea; blocks start a line; headings, paragraphs, lists, tables and the like
have a blank line around; list items are marked and indented by depth (to INDENTS levels); a table's cells are padded to
aligned columns, cells over several rows or columns keep theirs free, several lines of a cell stay in its column. Tables in
more than TABLES others, and cells reaching down beside more than SPANS such, are written as if they were not: their
layout would grow with the square of the page.

Nulls and odd input: null and empty pages give empty texts; broken, cut off or deeply nested markup gives what can be
seen of it; repeated rows are equal; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HEAD = frozenset("base link meta title style script noscript template".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes object canvas audio video datalist rp param defs desc metadata symbol annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr fieldset".split())
BLOCKS = SPACED | frozenset("html body address article aside center details dialog dd div dir dt figcaption footer form header hgroup legend li main menu nav optgroup option search section summary tbody thead tfoot tr caption xmp".split())
CLOSES_P = BLOCKS - frozenset("html body tbody thead tfoot tr caption option optgroup legend".split())
#: An opening tag ends these, looking up to (not into) the barriers.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu td th table body".split())),
    "dt": (frozenset("dt dd".split()), frozenset("dl td th table body".split())),
    "dd": (frozenset("dt dd".split()), frozenset("dl td th table body".split())),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset("select".split())),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset(["table"])),
    "td": (frozenset("td th caption colgroup".split()), frozenset("table tr".split())),
    "th": (frozenset("td th caption colgroup".split()), frozenset("table tr".split())),
    **{x: (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])) for x in ("tbody", "thead", "tfoot", "caption", "colgroup")},
    "rt": (frozenset("rt rp".split()), frozenset(["ruby"])),
    "rp": (frozenset("rt rp".split()), frozenset(["ruby"])),
}
PARAGRAPH = frozenset(["p"])
SHAPES = frozenset("path circle rect line ellipse polygon polyline use stop g image mspace mprescripts none".split())
BARRIERS = frozenset("table td th caption button object template".split())
THROUGH = BARRIERS | frozenset("tr tbody thead tfoot".split())  # their end tags pass barriers
INDENTS, TABLES, SPANS = 32, 8, 64
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_BLANK = re.compile(r"[ \t\n\f\r]+")
_SIMPLE = re.compile(r"([.#]?)([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*[\"']?([^\]\"']*)[\"']?\s*)?\]|(\*)")
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([\w-]+)[^;]*?(!\s*important)?\s*(?=;|$)")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []


def attributes_of(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


class Open:
    """The open elements, and where those of each name are. Place 0 is the html element."""

    def __init__(self, root: Node):
        self.nodes: list[Node | None] = [root]  # None: closed before what is open inside
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        """Close the elements from a place on."""
        while len(self.nodes) > at or self.nodes[-1] is None:
            node = self.nodes.pop()
            if node is not None:
                self.places[node.tag].pop()
                if node.tag in BLOCKS:
                    self.blocks.pop()

    def last(self, names) -> int:
        """The innermost place with one of the names, 0 for none."""
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=0)

    def end(self, names: frozenset, barriers: frozenset) -> None:
        """Close the outermost of the names inside the innermost barrier."""
        inside = self.last(barriers)
        found = [p[k] for x in names if (p := self.places.get(x)) and (k := bisect_right(p, inside)) < len(p)]
        if found:
            self.cut(min(found))

    def end_tag(self, tag: str) -> bool:
        at = self.last((tag,))
        if not at or tag not in THROUGH and self.last(BARRIERS) > at:
            return False
        if tag not in BLOCKS and self.blocks and self.blocks[-1] > at:
            self.nodes[at] = None  # misnested formatting: the blocks inside stay open
            self.places[tag].pop()
        else:
            self.cut(at)
        return True


def build(page: str | None) -> tuple[Node, list[str]]:
    """The html node, and the texts of the style elements."""
    root = Node("html", {})
    head, body = Node("head", {}), Node("body", {})
    root.children = [head, body]
    opened = Open(root)
    stack = opened.nodes
    styles: list[str] = []
    page = page or ""

    def into_body() -> None:
        if len(stack) == 1 or stack[1] is head:
            opened.cut(1)
            opened.push(body)

    def say(text: str) -> None:
        if text:
            if len(stack) == 1 or stack[1] is head:
                if not text.strip():
                    return
                into_body()
            if stack[-1].tag in ("table", "tbody", "thead", "tfoot", "tr") and not text.strip():
                return
            stack[-1].children.append(text)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() < at:  # inside a raw-text element
            continue
        if m.start() > at:
            say(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:
            if tag in ("html", "body", "head"):
                if tag == "head" and len(stack) > 1 and stack[1] is head:
                    opened.cut(1)
                continue
            if tag == "br":
                into_body()
                stack[-1].children.append(Node("br", {}))
                continue
            if not opened.end_tag(tag) and tag == "p":
                into_body()
                stack[-1].children.append(Node("p", {}))
            continue
        found = attributes_of(m[3]) if m[3] and not m[3].isspace() else {}
        if tag in ("html", "head", "body"):
            node = {"html": root, "head": head, "body": body}[tag]
            node.attributes = {**found, **node.attributes}
            if tag == "head" and len(stack) == 1:
                opened.push(head)
            elif tag == "body":
                into_body()
            continue
        if tag in HEAD and (len(stack) == 1 or stack[1] is head):
            if len(stack) == 1:
                opened.push(head)
        else:
            into_body()
        if tag in CLOSES_P:
            opened.end(PARAGRAPH, BARRIERS)
        if tag in ENDS:
            opened.end(*ENDS[tag])
        if tag == "tr" and stack[-1].tag == "table" or tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            if stack[-1].tag == "table":
                stack[-1].children.append(Node("tbody", {}))
                opened.push(stack[-1].children[-1])
            if tag != "tr":
                stack[-1].children.append(Node("tr", {}))
                opened.push(stack[-1].children[-1])
        node = Node(tag, found)
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.IGNORECASE).search(page, at)
            text = page[at : close.start() if close else len(page)]
            if tag == "style":
                styles.append(text)
            elif tag in ("textarea", "title", "xmp"):
                node.children.append(text if tag == "xmp" else html.unescape(text))
            at = len(page) if not close else page.find(">", close.end()) + 1 or len(page)
        elif tag not in VOID and not ((m[3] or "").endswith("/") and tag in SHAPES):  # a slash ends no HTML element
            opened.push(node)
    if at < len(page):
        say(html.unescape(page[at:]))
    return root, styles


def _rules(style: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold on a screen; other at-rules are passed over."""
    style = re.sub(r"/\*.*?(?:\*/|\Z)", "", style, flags=re.DOTALL)
    at, skipped, depth = 0, None, 0
    for m in re.finditer(r"[{};]", style):
        head = style[at : m.start()].strip()
        if m[0] == "{":
            depth += 1
            if skipped is None and head.startswith("@") and not re.fullmatch(r"@media\s+(?:only\s+)?(?:screen|all)|@layer.*", head, re.IGNORECASE | re.DOTALL):
                skipped = depth
            selectors = head
        elif m[0] == "}":
            if skipped is None and selectors and not selectors.startswith("@"):
                yield selectors, style[start : m.start()]
            if skipped == depth:
                skipped = None
            depth, selectors = max(0, depth - 1), ""
        elif depth and not head.startswith("@"):
            continue  # a declaration goes on to the brace
        at = m.end()
        if m[0] == "{":
            start = at


def _declared(text: str) -> list[tuple[str, str, bool]]:
    return [(p, v, bool(i)) for p, v, i in _DECLARED.findall(text.lower())]


class Sheet:
    """The rules about what is seen. A selector's parts have numbers; what of it the elements above match goes down as a set of bits."""

    def __init__(self):
        self.by_key: dict[str, list[tuple]] = {}  # an element's tag, .class or #id, or *: parts that need it
        self.size = 0

    def add(self, style: str) -> None:
        for order, (selectors, text) in enumerate(_rules(style)):
            for rule in _declared(text):
                for selector in selectors.split(","):
                    self._selector(selector.strip(), rule, order)

    def _selector(self, selector: str, rule: tuple, order: int) -> None:
        steps = re.split(r"\s*(>)\s*|\s+", selector)  # parts with ">" or None between
        parts = []
        for step in steps[::2]:
            if not step or not re.fullmatch(rf"(?:{_SIMPLE.pattern})+", step):
                return
            found = _SIMPLE.findall(step)
            names = frozenset((kind + name) if kind else name.lower() for kind, name, *_ in found if name)
            parts.append((names, tuple((a.lower(), v if "=" in step else None) for _, _, a, v, _ in found if a)))
        weight = (sum(x.startswith("#") for names, _ in parts for x in names), sum(x.startswith(".") for names, _ in parts for x in names) + sum(len(a) for _, a in parts), sum(x[0] not in "#." for names, _ in parts for x in names))
        for k, (names, wanted) in enumerate(parts):
            last = k == len(parts) - 1
            key = min(names, key=lambda x: ("#.".find(x[0]) % 3, x), default="*")
            self.by_key.setdefault(key, []).append((1 << self.size, 1 << (self.size - 1) if k else 0, bool(k) and steps[2 * k - 1] == ">", names, wanted, (rule, (weight, len(self.by_key), order)) if last else None))
            self.size += 1

    def match(self, node: Node, above: int, parent: int) -> tuple[int, list]:
        """The parts that the node matches, as bits, given those of its ancestors and its parent; and the rules that hold."""
        names = {node.tag, *(f".{c}" for c in node.attributes.get("class", "").split())}
        if "id" in node.attributes:
            names.add("#" + node.attributes["id"])
        bits, rules = 0, []
        for key in (*names, "*"):
            for bit, before, child, needs, wanted, rule in self.by_key.get(key, ()):
                if before and not (parent if child else above) & before or not needs <= names:
                    continue
                if all(a in node.attributes and (v is None or node.attributes[a] == v) for a, v in wanted):
                    bits |= bit
                    if rule:
                        rules.append(rule)
        return bits, rules


@lru_cache(maxsize=256)
def _sheet(styles: tuple[str, ...]) -> Sheet | None:
    out = Sheet()
    out.add("\n".join(styles))
    return out if out.size else None


class Page:
    """Lines under construction: what must precede the next text, and the indents that lists add."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap, self.space = 0, False
        self.indents: list[str] = []
        self.marker: str | None = None
        self.open = False

    def _start(self) -> None:
        if self.gap and (self.open or self.lines):
            self._end_line()
            if self.gap > 1 and self.lines and self.lines[-1] != "":
                self.lines.append("")
        self.gap = 0
        if not self.open:
            self.open, self.space = True, False
            lead = "".join(self.indents[:INDENTS])
            if self.marker is not None:
                lead = "".join(self.indents[: min(INDENTS, len(self.indents) - 1)]) + self.marker
                self.marker = None
            self.parts = [lead]

    def _end_line(self) -> None:
        if self.open:
            self.lines.append("".join(self.parts).rstrip(" "))
            self.open, self.space = False, False

    def block(self, gap: int) -> None:
        self.gap = max(self.gap, gap)

    def words(self, text: str) -> None:
        flat = _BLANK.sub(" ", text)
        if flat == " ":
            self.space = self.space or self.open
            return
        if not flat:
            return
        fresh = self.gap or not self.open
        self._start()
        if not fresh and (self.space or flat[0] == " "):
            self.parts.append(" ")
        self.space = flat[-1] == " "
        self.parts.append(flat.strip(" "))

    def exact(self, text: str) -> None:
        for k, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if k:
                self.break_()
            if line:
                self._start()
                self.parts.append(line)

    def break_(self) -> None:
        if self.open and not self.gap:
            self._end_line()
        else:
            self._start()
            self._end_line()

    def put(self, lines: list[str]) -> None:
        for line in lines:
            self._start()
            self.parts.append(line)
            self._end_line()
        self.gap = max(self.gap, 2)

    def done(self) -> list[str]:
        self._end_line()
        lines = self.lines
        while lines and not lines[0]:
            lines = lines[1:]
        while lines and not lines[-1]:
            lines = lines[:-1]
        return lines


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells (lines, columns, rows) padded to columns, with a space, a bar and a space between.

    A cell starts at the first column that no cell from above reaches into; columns in which no cell starts don't count.
    """
    placed, down = [], []  # down: (first column, end, rows left)
    for row in rows:
        at, here, free = 0, [], sorted(down)
        for lines, wide, high in row:
            while free and free[0][0] < at + 1:
                at = max(at, free.pop(0)[1])
            here.append((lines, at, at + wide))
            if high > 1 and len(down) < SPANS:
                down.append((at, at + wide, high))
            at += wide
        placed.append(here)
        down = [(a, b, left - 1) for a, b, left in down if left > 1]
    starts = sorted({a for row in placed for _, a, _ in row})
    placed = [[(lines, k := bisect_left(starts, a), max(k + 1, bisect_left(starts, b))) for lines, a, b in row] for row in placed]
    widths = [0] * len(starts)
    for spanning in (False, True):
        for row in placed:
            for lines, a, b in row:
                if (b - a > 1) == spanning and lines:
                    widths[b - 1] += max(0, max(map(len, lines)) - sum(widths[a:b]) - 3 * (b - a - 1))
    out = []
    for row in placed:
        for k in range(max((len(c) for c, _, _ in row), default=0)):
            line, at = [], 0
            for lines, a, b in row:
                line += [" " * w for w in widths[at:a]]
                line.append((lines[k] if k < len(lines) else "").ljust(sum(widths[a:b]) + 3 * (b - a - 1)))
                at = b
            out.append(" | ".join(line).rstrip())
    return out


def _span(node: Node, name: str, most: int) -> int:
    value = node.attributes.get(name, "").strip()
    return min(int(value), most) if re.fullmatch(r"[0-9]{1,9}", value) and int(value) else 1


def render(root: Node, styles: list[str] = ()) -> str:
    sheet = _sheet(tuple(styles)) if styles else None
    pages, tables, lists, plain = [Page()], [], [], 0
    todo: list[tuple] = [(root, True, False, False, 0, 0)]  # node, visible, preformatted, leaving, rule parts above and at the parent
    while todo:
        node, visible, pre, leaving, above, parent = todo.pop()
        page = pages[-1]
        if isinstance(node, str):
            if visible:
                page.exact(node) if pre else page.words(node)
            continue
        tag = node.tag
        gap = 2 if tag in SPACED else 1 if tag in BLOCKS or tag == "text" else 0
        if leaving:
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
                gap = 2 if not lists else 1
            elif tag == "li":
                page.marker = None
                page.indents.pop()
            elif tag in ("dd", "blockquote"):
                page.indents.pop()
            elif tag == "table" and plain:
                plain -= 1
            elif tag in ("td", "th", "caption") and tables and not plain:
                pages.pop()
                lines = page.done()
                if tag == "caption":
                    tables[-1][0].append(lines)
                else:
                    tables[-1][1][-1].append((lines, _span(node, "colspan", 1000), _span(node, "rowspan", 65534)))
                continue
            elif tag == "table":
                captions, rows = tables.pop()
                lines = [x for c in captions for x in c] + aligned(rows)
                page.block(2)
                if lines:
                    page.put(lines)
                continue
            if gap:
                page.block(gap)
            continue
        if tag in HIDDEN or "hidden" in node.attributes or tag == "dialog" and "open" not in node.attributes:
            continue
        bits = 0
        if node.attributes or sheet:
            bits, rules = sheet.match(node, above, parent) if sheet else (0, [])
            said: dict[str, tuple] = {}
            own = [(rule, ((2, 0, 0), 0, k)) for k, rule in enumerate(_declared(node.attributes["style"]))] if "style" in node.attributes else []
            for (what, value, important), rank in [*((r, ((0, *w), *o)) for r, (w, *o) in rules), *own]:
                said[what] = max(said.get(what, (False, (), "")), (important, rank, value))
            if said.get("display", ("",))[-1] == "none":
                continue
            if "visibility" in said:
                visible = said["visibility"][-1] not in ("hidden", "collapse")
        if tag == "br":
            page.break_()
            continue
        in_table = tag in ("td", "th", "caption", "tr", "tbody", "thead", "tfoot")
        if gap and (not in_table or plain):
            page.block(1 if tag in ("ul", "ol", "menu", "dir") and lists else gap)
        children = node.children
        if tag == "hr":
            continue
        if tag == "details" and "open" not in node.attributes:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        if tag in ("ul", "ol", "menu", "dir"):
            start = node.attributes.get("start", "")
            lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
        elif tag == "li":
            marker = "- "
            if lists and lists[-1][0] == "ol":
                marker = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            page.indents.append(" " * len(marker))
            page.marker = marker
            page.block(1)
        elif tag in ("dd", "blockquote"):
            page.indents.append("  ")
        elif tag == "table" and (plain or len(tables) > TABLES):
            plain += 1
        elif tag == "table":
            tables.append(([], []))
        elif tag == "tr" and tables and not plain:
            tables[-1][1].append([])
        elif tag in ("td", "th", "caption") and tables and not plain:
            if tag != "caption" and not tables[-1][1]:
                tables[-1][1].append([])
            pages.append(Page())
        pre = pre or tag in ("pre", "textarea", "xmp", "listing")
        todo.append((node, visible, pre, True, 0, 0))
        todo += [(c, visible, pre, False, above | bits, bits) for c in reversed(children)]
    return "\n".join(pages[0].done())


def text_of(page: str | None) -> str:
    return render(*build(page))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of each page; no shuffle."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = pa.array([text_of(x) for x in part.column("html").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), texts], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")


def op2(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
