"""HTML extraction: layout-aware rendering of all visible text.

A tokenizer feeds a tree builder that supplies implied tags (html, body, tbody,
tr, closing p/li/dd/td and so on); visibility rules drop what a browser wouldn't
show; a renderer then writes blocks with their spacing, list markers with
indentation, preformatted text as it stands, and tables with aligned columns.

Defined results: null HTML gives null text, empty HTML empty text; an attribute whose
quote is not closed ends at the next >; unclosed
tags, comments and attributes end with the document; elements nest as deep as the
page says, but beyond ``MAX_INDENT`` levels no more blanks are put before lines;
repeated rows and rows with a null id are rendered alike; pages of any length are
rendered whole; an empty table gives no rows; other columns are never read.

Visible text is that of elements: drawings (svg text), formulas (math) and text areas
count, lists of choices (select) and values of input fields don't.  Cells that span
rows or columns hold their places; their text stands in the first of them.

Styles: rules of simple selectors (tag, .class, #id, tag.class, tag#id) for display and
visibility, by importance, specificity and order, as on a light screen of ``SCREEN``
pixels; @media by its condition, @supports without not and @layer as if they held,
other at-rules not at all.  Descendant, pseudo and nested selectors are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Levels of lists, quotes and definitions that are indented.
MAX_INDENT = 150
#: A column of a table is as wide as its widest cell, up to this width; longer cells are
#: broken between words (within a word only where one is longer), but for a row's last cell.
PAD_WIDTH = 100
#: Width and height that media conditions are held against.
SCREEN = {"width": 1280, "height": 800}

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title noscript iframe noembed noframes object audio video canvas datalist select defs symbol metadata desc annotation annotation-xml".split())
BLOCKS = frozenset("address article aside blockquote body center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table caption ul xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre xmp blockquote table figure menu dir".split())
CLOSES_P = BLOCKS - frozenset(("body", "html", "caption", "legend", "dd", "dt", "li")) | frozenset(("li", "dd", "dt"))
#: A start tag closes an open element of the set, up to the nearest barrier.
IMPLIED_END = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "tr": (frozenset(("tr", "td", "th", "caption", "colgroup")), frozenset(("table",))),
    "td": (frozenset(("td", "th", "caption", "colgroup")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th", "caption", "colgroup")), frozenset(("table", "tr"))),
    "tbody": (frozenset(("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup")), frozenset(("table",))),
    "thead": (frozenset(("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup")), frozenset(("table",))),
    "tfoot": (frozenset(("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup")), frozenset(("table",))),
}
HEAD_ONLY = frozenset("base link meta title style script template".split())

_TOKEN = re.compile(r"<!--(?:.*?--!?>|.*)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?|[^<]++|<", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_CSS_MARK = re.compile(r"/\*(?:.*?\*/|.*)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[{};]", re.S)
_COMMENT = re.compile(r"/\*(?:.*?\*/|.*)", re.S)
_MEDIA = re.compile(r"\s*(not\b|only\b)?\s*([a-z-]+(?=\s|\Z))?", re.I)
_FEATURE = re.compile(r"\(([^()]*)\)")
_LENGTH = re.compile(r"(\d*\.?\d+)\s*(px|r?em|)\Z")
_RANGE = re.compile(r"(?:([\d.a-z]+)\s*([<>]=?))?\s*(width|height)\s*(?:([<>]=?|=)\s*([\d.a-z]+))?\Z")
_SIMPLE = re.compile(r"(?:[a-z][a-z0-9]*)?[.#]?[\w-]+\Z", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def _pixels(value: str) -> float | None:
    m = _LENGTH.match(value.strip())
    return None if m is None else float(m[1]) * (16 if m[2] in ("em", "rem") else 1)


def _compare(a: float | None, sign: str, b: float | None) -> bool:
    if a is None or b is None:
        return False
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "=": a == b}[sign]


def _feature_holds(feature: str) -> bool:
    name, colon, value = (x.strip() for x in feature.partition(":"))
    if colon:
        end, _, side = name.partition("-")
        if end in ("min", "max") and side in SCREEN:
            return _compare(SCREEN[side], ">=" if end == "min" else "<=", _pixels(value))
        known = {"orientation": "landscape", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine"}
        return known.get(name) == value
    m = _RANGE.match(name)
    if m is None:
        return name in ("color", "hover", "any-hover", "pointer", "any-pointer")
    side = SCREEN[m[3]]
    return (m[1] is None or _compare(_pixels(m[1]), m[2], side)) and (m[4] is None or _compare(side, m[4], _pixels(m[5])))


def media_holds(query: str) -> bool:
    """Whether a media query list holds on the screen; unknown conditions don't."""

    def one(q: str) -> bool:
        m = _MEDIA.match(q)
        rest = q[m.end() :]
        parts = [_feature_holds(f) for f in _FEATURE.findall(rest)]
        holds = (any if re.search(r"\)\s*or\b", rest) else all)(parts) and (m[2] or "all") in ("all", "screen")
        return holds != (m[1] == "not")

    return not query.strip() or any(one(q.strip()) for q in query.lower().split(","))


def _at_rule_holds(prelude: str) -> bool:
    name, _, rest = prelude[1:].replace("(", " (", 1).partition(" ")
    name = name.strip().lower()
    if name == "media":
        return media_holds(rest)
    return name == "supports" and not rest.strip().lower().startswith("not") or name == "layer"


def css_rules(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold on the screen; open blocks end with the text."""
    open_: list[tuple[bool, str | None, list[str]]] = []  # holds, selectors (None: a group), declarations
    start = 0
    marks = [(m.start(), m.end(), m[0]) for m in _CSS_MARK.finditer(css) if m[0] in "{};"]
    for a, z, mark in [*marks, *[(len(css), len(css), "}")] * sum(m[2] == "{" for m in marks)]:
        piece, start = _COMMENT.sub(" ", css[start:a]).strip(), max(start, z)
        if mark == "{":
            piece = piece.removeprefix("<!--").strip()
            # What stands within a rule is not held.
            holds = not open_ or open_[-1][0] and open_[-1][1] is None
            if piece.startswith("@"):
                open_.append((holds and _at_rule_holds(" ".join(piece.split())), None, []))
            else:
                open_.append((holds, piece, []))
            continue
        if not open_:
            continue
        open_[-1][2].append(piece)
        if mark == "}":
            holds, selectors, own = open_.pop()
            if holds and selectors is not None:
                yield selectors, ";".join(own)


def shown_by(declarations: str) -> dict[str, tuple[bool, bool]]:
    """display and visibility: (important, hides), as far as declared."""
    out: dict[str, tuple[bool, bool]] = {}
    for part in declarations.lower().split(";"):
        name, colon, value = (x.strip() for x in part.partition(":"))
        if not colon or name not in ("display", "visibility"):
            continue
        plain, bang, rest = value.partition("!")
        important, plain = bang == "!" and rest.strip() == "important", plain.strip()
        if plain and (important or not out.get(name, (False, False))[0]):
            out[name] = (important, plain == "none" if name == "display" else plain in ("hidden", "collapse"))
    return out


class TreeBuilder:
    def __init__(self) -> None:
        self.root = Node("html", {})
        self.body = Node("body", {})
        self.root.children.append(self.body)
        self.stack = [self.body]
        #: Places in the stack by tag, so that no search walks through deep nesting.
        self.places: dict[str, list[int]] = {}
        #: selector -> property -> (important, specificity, order, hides) of the rule that wins.
        self.styles: dict[str, dict[str, tuple[bool, int, int, bool]]] = {}
        self.n_rules = 0

    def style(self, css: str) -> None:
        for selectors, body in css_rules(css):
            self.n_rules += 1
            found = shown_by(body)
            if not found:
                continue
            for x in (x.strip().lower() for x in selectors.split(",")):
                if not _SIMPLE.match(x):
                    continue
                rank = (100 if "#" in x else 10 if "." in x else 0) + (x[0] not in "#.")
                own = self.styles.setdefault(x, {})
                for name, (important, hides) in found.items():
                    own[name] = max(own.get(name, (False, -1, -1, False)), (important, rank, self.n_rules, hides))

    def text(self, data: str) -> None:
        self.stack[-1].children.append(data)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def close(self, at: int) -> None:
        """Close the open elements from place ``at`` on."""
        while len(self.stack) > at:
            self.places[self.stack.pop().tag].pop()

    def nearest(self, tags: frozenset) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close_until(self, tags: frozenset, barrier: frozenset) -> None:
        """Close the outermost open element of ``tags`` above the nearest barrier."""
        opened = [own for t in tags if (own := self.places.get(t))]
        if not opened:
            return
        wall = self.nearest(barrier)
        above = [own[k] for own in opened if (k := bisect_right(own, wall)) < len(own)]
        if above:
            self.close(min(above))

    def start(self, tag: str, attrs: dict[str, str], self_closing: bool) -> None:
        if tag in ("html", "body", "head"):
            if tag != "head":
                (self.root if tag == "html" else self.body).attrs.update(attrs)
            return
        if tag in CLOSES_P:
            self.close_until(frozenset(("p",)), frozenset(("table", "td", "th", "button", "div", "blockquote", "li", "section", "article")))
        if tag in IMPLIED_END:
            self.close_until(*IMPLIED_END[tag])
        if tag in ("td", "th") and self.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.start("tr", {}, False)
        if tag[0] == "h" and tag in ("h1", "h2", "h3", "h4", "h5", "h6") and self.stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.close(len(self.stack) - 1)
        node = Node(tag, attrs)
        self.stack[-1].children.append(node)
        if tag not in VOID and not (self_closing and tag in ("svg", "math", "path")):
            self.push(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {}, False)
            return
        barrier = frozenset() if tag in ("table", "body", "html") else frozenset(("table",)) if tag in ("tr", "tbody", "thead", "tfoot") else frozenset(("td", "th", "table"))
        own = self.places.get(tag)
        if own and own[-1] > self.nearest(barrier - {tag}):
            self.close(own[-1])
            return
        if tag == "p":
            self.stack[-1].children.append(Node("p", {}))


def parse(source: str) -> TreeBuilder:
    tree = TreeBuilder()
    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.match(source, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            t = m[0]
            if t[0] != "<" or t == "<":
                tree.text(html.unescape(t) if "&" in t else t)
            continue
        tag, closing, raw = tag.lower(), m[1] or m[4], m[3] if m[2] else m[6]
        if closing:
            tree.end(tag)
            continue
        attrs = attributes(raw) if raw and not raw.isspace() else {}
        tree.start(tag, attrs, raw.rstrip().endswith("/"))
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])|\Z", re.I).search(source, at)
            content = source[at : stop.start()]
            if tag == "style" and media_holds(attrs.get("media", "")):
                tree.style(content)
            elif tag == "xmp":
                tree.text(content)
            elif tag == "textarea":
                tree.text(html.unescape(content))
            at = stop.start()
    return tree


def finish(step: Generator) -> list[str]:
    """The value of a generator that yields further generators for the values it needs.

    Stands in for recursion, which deep pages would exhaust.
    """
    stack, value = [step], None
    while stack:
        try:
            step = stack[-1].send(value)
        except StopIteration as done:
            stack.pop()
            value = done.value
        else:
            stack.append(step)
            value = None
    return value


class Renderer:
    def __init__(self, styles: dict[str, dict[str, tuple[bool, int, int, bool]]]):
        self.styles = styles

    def hidden(self, node: Node) -> bool:
        if node.tag in HIDDEN or node.tag == "input":
            return True
        a = node.attrs
        won: dict[str, tuple[bool, int, int, bool]] = {}
        if self.styles:
            names = [node.tag]
            if a:
                marks = [*("." + c for c in a.get("class", "").lower().split()), *("#" + a["id"].lower() for _ in "x" if "id" in a)]
                names += marks + [node.tag + x for x in marks]
            for x in names:
                for name, rule in self.styles.get(x, {}).items():
                    won[name] = max(won.get(name, rule), rule)
        if "style" in a:
            for name, (important, hides) in shown_by(a["style"]).items():
                rule = (important, 1000, 0, hides)
                won[name] = max(won.get(name, rule), rule)
        # What the browser hides by itself, a page's display rule can show.
        display = won["display"][3] if "display" in won else "hidden" in a or node.tag == "dialog" and "open" not in a
        return display or "visibility" in won and won["visibility"][3]

    def lines(self, node: Node, pre: bool = False, level: int = 0) -> Generator:
        """The lines of a block's content (see finish); an empty string is a blank line between blocks.

        ``level``: how many elements around it indent their lines.
        """
        indented = level < MAX_INDENT
        out: list[str] = []
        run: list[str] = []  # inline text since the last block

        def flush() -> None:
            if not run:
                return
            text = "".join(run)
            run.clear()
            if pre:
                out.extend(x.rstrip() for x in text.strip("\n").split("\n"))
                return
            rows = [_SPACE.sub(" ", x).strip(" ") for x in text.split("\x00")]
            while rows and not rows[-1]:
                rows.pop()
            out.extend(rows)

        def block(rows: list[str], spaced: bool) -> None:
            flush()
            # The space of a first or last child reaches beyond its parent, once.
            inner = trimmed(rows)
            if not inner:
                return
            if (spaced or not rows[0]) and (not out or out[-1]):
                out.append("")
            out.extend(inner)
            if spaced or not rows[-1]:
                out.append("")

        def walk(parent: Node) -> Generator:
            number = _int(parent.attrs.get("start"), 1) if parent.tag == "ol" else None
            shut = parent.tag == "details" and "open" not in parent.attrs
            for child in parent.children:
                if isinstance(child, str):
                    if not shut:
                        run.append(child.replace("\x00", "") if not pre else child)
                    continue
                tag = child.tag
                if tag == "br":
                    run.append("\n" if pre else "\x00")
                    continue
                if shut and tag != "summary" or self.hidden(child):
                    continue
                if tag == "table":
                    block((yield self.table(child, level)), True)
                elif tag == "li":
                    number = _int(child.attrs.get("value"), number) if number is not None else None
                    mark = "- " if number is None else f"{number}. "
                    number = None if number is None else number + 1
                    rows = trimmed((yield self.lines(child, pre, level + 1)))
                    # A list inside an item follows its text without a blank line.
                    rows = [r for i, r in enumerate(rows) if r or not _listed(rows, i)]
                    block([(mark if i == 0 else " " * len(mark) if r and indented else "") + r for i, r in enumerate(rows)], False)
                elif tag == "dd":
                    block(["    " + r if r and indented else r for r in (yield self.lines(child, pre, level + 1))], False)
                elif tag == "blockquote":
                    block(["  " + r if r and indented else r for r in (yield self.lines(child, pre, level + 1))], True)
                elif tag in ("pre", "xmp", "textarea"):
                    block((yield self.lines(child, True, level)), tag != "textarea")
                elif tag == "text":
                    # A text of a drawing stands by itself.
                    block((yield self.lines(child, pre, level)), False)
                elif tag == "hr":
                    flush()
                    if out and out[-1]:
                        out.append("")
                elif tag in BLOCKS:
                    block((yield self.lines(child, pre, level)), tag in SPACED)
                else:
                    yield walk(child)

        yield walk(node)
        flush()
        return out

    def table(self, node: Node, level: int = 0) -> Generator:
        head: list[str] = []
        #: Cells of each row: lines, columns and rows that they span (None: to the end of their group).
        rows: list[list[tuple[list[str], int, int | None]]] = []
        groups: list[int] = []  # the group of each row

        def collect(parent: Node, group: int) -> Generator:
            for child in parent.children:
                if isinstance(child, str):
                    if child.strip():
                        head.append(_SPACE.sub(" ", child).strip())
                elif self.hidden(child) or child.tag == "col":
                    continue
                elif child.tag == "tr":
                    cells = [c for c in child.children if isinstance(c, Node) and c.tag in ("td", "th") and not self.hidden(c)]
                    loose = [c for c in child.children if isinstance(c, Node) and c.tag not in ("td", "th") or isinstance(c, str) and c.strip()]
                    if loose:
                        extra = Node("div", {})
                        extra.children = loose
                        head.extend(trimmed((yield self.lines(extra, False, level))))
                    row: list[tuple[list[str], int, int | None]] = []
                    for c in cells:
                        text = yield self.lines(c, False, level)
                        down = _int(c.attrs.get("rowspan"), 1)
                        row.append(([r for r in trimmed(text) if r] or [""], max(1, min(1000, _int(c.attrs.get("colspan"), 1))), None if down == 0 else max(1, min(65534, down))))
                    rows.append(row)
                    groups.append(group)
                elif child.tag in ("tbody", "thead", "tfoot"):
                    yield collect(child, len(rows) + 1)
                else:
                    head.extend(trimmed((yield self.lines(child if child.tag == "caption" else _wrap(child), False, level))))

        yield collect(node, 0)
        return head + laid_out(rows, groups)


def laid_out(rows: list[list[tuple[list[str], int, int | None]]], groups: list[int]) -> list[str]:
    """The lines of a table: cells take the first free columns, which cells from above may hold."""
    placed: list[list[tuple[int, int, list[str]]]] = []  # column, span, lines
    held: dict[int, int | None] = {}  # column -> rows for which a cell from above still holds it
    for r, row in enumerate(rows):
        if r and groups[r] != groups[r - 1]:
            held = {}
        own, col, new = [], 0, {}
        for text, span, down in row:
            while col in held:
                col += 1
            own.append((col, span, text))
            for c in range(col, col + span):
                new[c] = None if down is None else down
            col += span
        placed.append(own)
        held = {c: None if k is None else k - 1 for c, k in (held | new).items() if k is None or k > 1}
    width: dict[int, int] = {}
    for own in placed:
        for col, span, text in own:
            if span == 1:
                width[col] = min(PAD_WIDTH, max([width.get(col, 0), *map(len, text)]))
    out = []
    for own in placed:
        cells = []
        for k, (col, span, text) in enumerate(own):
            room = sum(width.get(c, 0) for c in range(col, col + span)) + 2 * (span - 1)
            cells.append((col, text if k + 1 == len(own) else [x for t in text for x in broken(t, max(room, 1))]))
        for k in range(max((len(t) for _, t in cells), default=0)):
            line = ""
            for col, text in cells:
                if k < len(text) and text[k]:
                    start = sum(width.get(c, 0) + 2 for c in range(col))
                    line = line.ljust(start) + text[k]
            out.append(line.rstrip())
    return out


def broken(text: str, room: int) -> list[str]:
    """``text`` in lines of at most ``room`` characters, between words where it can be."""
    out = []
    while len(text) > room:
        at = text.rfind(" ", 1, room + 1)
        out.append(text[: at if at > 0 else room])
        text = text[at + 1 :] if at > 0 else text[room:]
    return [*out, text]


def _wrap(node: Node) -> Node:
    outer = Node("div", {})
    outer.children = [node]
    return outer


def _int(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch(r"-?\d{1,9}", value.strip()) else default


def _listed(rows: list[str], i: int) -> bool:
    """Whether the blank line i stands before a list's first marker."""
    return i + 1 < len(rows) and bool(re.match(r"(?:- |\d+\. )", rows[i + 1]))


def trimmed(rows: list[str]) -> list[str]:
    a, b = 0, len(rows)
    while a < b and not rows[a]:
        a += 1
    while b > a and not rows[b - 1]:
        b -= 1
    return rows[a:b]


def render(source: str | None) -> str | None:
    if source is None:
        return None
    tree = parse(source)
    shown = Renderer(tree.styles)
    if shown.hidden(tree.root) or shown.hidden(tree.body):
        return ""
    return "\n".join(trimmed(finish(shown.lines(tree.body))))


def render_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text (rendered), n_lines and n_chars for every row."""

    def step(part: pa.RecordBatch, sources: list) -> pa.RecordBatch:
        texts = [render(None if s is None else s.decode("utf-8", "replace")) for s in sources]
        lines = [None if t is None else t.count("\n") + 1 if t else 0 for t in texts]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64())], names=["page_id", "text", "n_lines"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").cast("binary").alias("html"))
    return map_arrow(rows, step, "page_id long, text string, n_lines long").withColumn("n_chars", F.length("text").cast("long"))
