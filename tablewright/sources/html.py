"""HTML pass: one walk over each document gives its raw tables, links and text.

A tree is needed for headings before an element, siblings and descendants. It extracts
structure alone; what a table or a link is gets decided by column expressions
afterwards. Documents are parsed once, in Arrow batches, independent of each other.

An element's text is a slice of the page's: the text is written down as it is parsed,
and every element is given where its own begins and ends. Whether a slice holds a gate word,
a gap or enough letters is answered from sorted places, so deep nesting costs no more
than its depth; text is only built where it goes into the result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from functools import cached_property, lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablewright.sources.shared import dealt

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style", "noscript", "template"))
#: Tags that end an open element of the same group.
CLOSES = {
    "p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"),
    "option": ("option",), "thead": ("thead", "tbody"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
#: Elements that an implied end never crosses.
WALLS = frozenset(("table", "ul", "ol", "dl", "select", "body", "html", "div", "section", "article"))
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

# fixed values: caps of the grid scan and words that gate it
GRIDS, CHILDREN, CELLS = 18, 20, 12
GRID_WORDS = "size|fit|guide|chart|chest|waist|hips|inseam|xxs|xs|xl"
ADVICE = re.compile(r"(?i)size|taille|fit|measure|guide")

SCHEMA = (
    "url string, renderer string, n_tables int, body string, "
    "tables array<struct<ord:int,kind:string,matrix:array<array<string>>,heading_path:array<string>,title:string,subheading:string,nearby:string>>, "
    "links array<struct<ord:int,href:string,label:string,heading_path:array<string>,nearby:string>>, error string"
)
_PATH = pa.list_(pa.string())
_ROWS = pa.schema(
    {
        "url": pa.string(), "renderer": pa.string(), "n_tables": pa.int32(), "body": pa.string(),
        "tables": pa.list_(pa.struct({"ord": pa.int32(), "kind": pa.string(), "matrix": pa.list_(_PATH), "heading_path": _PATH, "title": pa.string(), "subheading": pa.string(), "nearby": pa.string()})),
        "links": pa.list_(pa.struct({"ord": pa.int32(), "href": pa.string(), "label": pa.string(), "heading_path": _PATH, "nearby": pa.string()})),
        "error": pa.string(),
    }
)
#: Slices of so many characters are read as they are; of longer ones sorted places tell.
SHORT = 256


def clean(text: str) -> str:
    return " ".join(text.split())


_GAP = re.compile(r"\t|\s\s")
_WHITE = np.array([chr(c).isspace() for c in range(0x3002)])
_GATE = re.compile(f"(?<![a-z0-9])(?:{GRID_WORDS})(?![a-z0-9])")
_GATE_HERE = re.compile(f"(?:{GRID_WORDS})(?![a-z0-9])")
_GATE_END = re.compile(f"(?:^|[^a-z0-9])(?:{GRID_WORDS})$")
#: Letters that a gate word and the one before it take.
_GATE_MOST = max(map(len, GRID_WORDS.split("|"))) + 1


class Text:
    """A page's text, and answers about its slices."""

    def __init__(self, text: str):
        self.text, self.gates = text, None

    @cached_property
    def solid(self) -> np.ndarray:
        """Places of all characters but white space."""
        codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.flatnonzero(~_WHITE[np.minimum(codes, len(_WHITE) - 1)])

    @cached_property
    def gaps(self) -> np.ndarray:
        """Which of solid a tab or more than one white space follows."""
        wide = np.flatnonzero(np.diff(self.solid) > 1)
        own = [k for k in wide.tolist() if self.solid[k + 1] - self.solid[k] > 2 or self.text[self.solid[k] + 1] == "\t"]
        return np.array(own, int)

    def letters(self, a: int, b: int) -> int:
        """How many characters of a slice aren't white space."""
        if b - a <= SHORT:
            return sum(map(len, self.text[a:b].split()))
        return int(np.searchsorted(self.solid, b) - np.searchsorted(self.solid, a))

    def clean(self, a: int, b: int, most: int = 0) -> str:
        """A slice's clean text; with most, at least so much of its begin."""
        n = most + 200 if most else b - a
        while True:
            found = clean(self.text[a : min(a + n, b)])
            if a + n >= b or len(found) > most + 1:
                return found
            n *= 2

    def has_gap(self, a: int, b: int) -> bool:
        """Whether a tab or two white spaces stand between the letters of a slice."""
        if b - a <= SHORT:
            return _GAP.search(self.text[a:b].strip()) is not None
        i, j = np.searchsorted(self.solid, (a, b))
        if j - i < 2:
            return False
        return bool(np.searchsorted(self.gaps, j - 1) > np.searchsorted(self.gaps, i))

    def has_gate(self, a: int, b: int) -> bool:
        """Whether a slice holds one of GRID_WORDS as a whole word, without regard to accents."""
        if self.gates is None:
            self._fold()
        if self.place is not None:
            a, b = int(self.place[a]), int(self.place[b])
        k = np.searchsorted(self.gates[0], a)
        if k < len(self.gates[0]) and self.gates[1][k] <= b:
            return True
        # words that the slice's ends set free from longer ones
        return bool(_GATE_HERE.match(self.low, a, b) or _GATE_END.search(self.low[max(a, b - _GATE_MOST) : b]))

    def _fold(self) -> None:
        """The folded text, with where each character of the text begins in it, and its gate words."""
        self.place, letters = None, {ord(c): _folded(c) for c in set(self.text)}
        self.low = self.text.translate(letters)
        if any(len(x) != 1 for x in letters.values()):
            self.place = np.concatenate([[0], np.cumsum([len(letters[ord(c)]) for c in self.text])])
        found = [m.span() for m in _GATE.finditer(self.low)]
        self.gates = np.array([f[0] for f in found], int), np.array([f[1] for f in found], int)


@lru_cache(1 << 14)
def _folded(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", c.lower()) if not "̀" <= x <= "ͯ")


class Node:
    """An element; once the tree is whole, at is its place among its siblings, kids its child
    elements, heading the last heading before it among its siblings, and tables says
    whether a table lies below it, and below all nodes below it in their order. whole and bare are the page's text, with and without RAW,
    and where the element's part of it begins and ends."""

    __slots__ = ("tag", "attrs", "parent", "children", "at", "kids", "heading", "tables", "whole", "bare", "short", "below", "raw", "begin", "end", "_clean")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children, self.at = tag, attrs, parent, [], 0
        self.raw = tag in RAW or (parent is not None and parent.raw)
        self.kids, self.heading, self.tables, self.short, self.below, self._clean = None, None, False, None, None, None

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)] if self.kids is None else self.kids

    def clean_text(self, most: int = 0) -> str:
        """The clean text; with most, at least so much of its begin."""
        text, a, b = self.whole
        if most:
            return text.clean(a, b, most)
        if self._clean is None:
            self._clean = text.clean(a, b)
        return self._clean

    def blank(self) -> bool:
        text, a, b = self.whole
        return not text.letters(a, b)

    def walk(self):
        if self.below is not None:
            yield self
            yield from self.below
            return
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.elements()))

    def text(self, without: frozenset = frozenset()) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in without:
                todo.extend(reversed(node.children))
        return "".join(out)

    def is_table(self) -> bool:
        return self.tag == "table" or self.attrs.get("role") == "table"


_NAMED, _QUOTED = "[a-zA-Z][a-zA-Z0-9]*+", '[ \n]++[a-zA-Z][a-zA-Z0-9-]*+="[^"&<>]*+"'
#: Pages of nothing but text and tags, their values in double quotes; references, comments and all else are left to the parser.
_PLAIN = re.compile(f"(?:</{_NAMED}>|<{_NAMED}(?:{_QUOTED})*+>|[^<&]++)*+")
_TOKEN = re.compile(f"<(/?)({_NAMED})((?:{_QUOTED})*+)>|([^<]++)")
_ATTRIBUTE = re.compile('([a-zA-Z][a-zA-Z0-9-]*)="([^"]*)"')
#: Elements whose text the parser may read by other rules.
_RAW_TEXT = re.compile("(?i)<(?:script|style|textarea|title|iframe|noembed|noframes|noscript|xmp|plaintext|template|svg|math)[ \n>]")


class Tree(HTMLParser):
    """The tree, its nodes in their order, and the texts with and without RAW; nodes know where theirs begin and end."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("", {}, None)
        self.nodes, self.whole, self.bare = [self.root], [], []
        self.reached = self.root.begin = self.root.end = (0, 0)

    def updatepos(self, i, j):
        return j  # nobody asks for lines

    def take(self, html: str) -> None:
        """Feed the whole page. Plain markup is cut by one pattern, which gives what the parser would, in a third of its time."""
        if not _PLAIN.fullmatch(html) or _RAW_TEXT.search(html):
            self.feed(html)
            self.close()
            return
        for closing, tag, attrs, data in _TOKEN.findall(html):
            if data:
                self.handle_data(data)
            elif closing:
                self.handle_endtag(tag.lower())
            else:
                self.handle_starttag(tag.lower(), [(k.lower(), v) for k, v in _ATTRIBUTE.findall(attrs)] if attrs else ())

    def handle_starttag(self, tag, attrs):
        closing = CLOSES.get(tag, ("p",) if tag in BLOCKS else ())
        at = self.open
        while closing and at.parent is not None and at.tag not in WALLS:
            if at.tag in closing:
                self.open = at.parent
            at = at.parent
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.open)
        node.begin = node.end = self.reached
        self.nodes.append(node)
        self.open.children.append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        at = self.open
        while at.parent is not None and at.tag != tag:
            at = at.parent
        if at.parent is not None:
            self.open = at.parent

    def handle_data(self, data):
        n, m = self.reached
        self.open.children.append(data)
        self.whole.append(data)
        if not self.open.raw:
            self.bare.append(data)
            m += len(data)
        self.open.end = self.reached = n + len(data), m


def parsed(html: str) -> Node:
    tree = Tree()
    tree.take(html)
    nodes, texts = tree.nodes, (Text("".join(tree.whole)), Text("".join(tree.bare)))
    for node in nodes:
        node.kids, last = node.elements(), None
        for i, child in enumerate(node.kids):
            child.at, child.heading = i, last
            if child.tag in HEADINGS:
                last = child
    for node in reversed(nodes):  # children come before their parents
        node.whole, node.bare = (texts[0], node.begin[0], node.end[0]), (texts[1], node.begin[1], node.end[1])
        if above := node.parent:
            above.end = max(above.end, node.end)
            above.tables = above.tables or node.tables or node.is_table()
    tree.root.below = nodes[1:]
    return tree.root


def heading_path(node: Node) -> list[str]:
    """The nearest heading before the node on each level above it, the last three."""
    found: list[str] = []
    while node.parent is not None and len(found) < 3:
        text = node.heading.clean_text() if node.heading else ""
        if text and text not in found:
            found.insert(0, text)
        node = node.parent
    return found


def nearby(node: Node, before: int, after: int, most: int, stop) -> str:
    """Text of the siblings around a node up to a heading, within a budget of characters."""
    siblings, chunks, size = node.parent.elements(), deque(), 0  # size: of the chunks with a space behind each
    enough = max(before, after, most) + 1
    for i in range(node.at - 1, -1, -1):
        s = siblings[i]
        if size - 1 >= before or stop(s):
            break
        if text := s.clean_text(enough):
            chunks.appendleft(text)
            size += len(text) + 1
    for i in range(node.at + 1, len(siblings)):
        s = siblings[i]
        if size - 1 >= after or stop(s):
            break
        if text := s.clean_text(enough):
            chunks.append(text)
            size += len(text) + 1
    return " ".join(chunks)[:most]


def subheading(node: Node) -> str:
    """The first short text among a node's siblings, kept with their parent."""
    parent = node.parent
    if parent.short is None:
        short = (s for s in parent.elements() if s.tag in ("p", "strong", "span", "div") and 0 < s.whole[0].letters(*s.whole[1:]) <= 140)
        parent.short = next((t for t in (s.clean_text() for s in short) if len(t) <= 140), "")
    return parent.short


def rows_of(node: Node, row, cell) -> list[list[str]]:
    """Texts of the cells in the rows below a node, nested rows included."""
    return [[c.clean_text() for c in r.walk() if c is not r and cell(c)] for r in node.walk() if r is not node and row(r)]


def loose_row(text: str) -> list[str]:
    """Cells of a line that tabs or wide gaps split; none without them."""
    raw = text.strip()
    parts = re.split(r"\t+", raw) if "\t" in raw else re.split(r"\s{2,}", raw)
    cells = [c for c in map(clean, parts) if c]
    return cells if "\t" in raw or len(cells) >= 2 else []


def grid(node: Node) -> list[list[str]]:
    """Rows of a container whose children look like rows; empty where they don't."""
    found = []
    for child in [c for c in node.elements() if c.tag not in RAW][:CHILDREN]:
        own = [c for c in child.elements() if c.tag not in RAW]
        if len(own) >= 2:
            cells = [c for c in own if not c.blank()][:CELLS]
            found.append((len(cells), cells))
        elif child.whole[0].has_gap(*child.whole[1:]):
            text, a, b = child.whole
            row = loose_row(text.text[a:b])
            found.append((len(row), row))
    found = [(n, row) for n, row in found if n >= 2]
    if len(found) < 2:
        return []
    return [[c if isinstance(c, str) else c.clean_text() for c in row] for _, row in found]


def _stop_at_table(node: Node) -> bool:
    return node.tag in HEADINGS or node.is_table()


def tables_of(root: Node) -> list[tuple]:
    found: list[tuple] = []

    def add(kind: str, node: Node, matrix: list[list[str]], name: str):
        path = heading_path(node)
        title = (path[-1] if path else "") or clean(node.attrs.get("aria-label", "")) or name
        found.append((len(found), kind, matrix, path, title, subheading(node), nearby(node, 260, 420, 420, _stop_at_table)))

    nodes = [n for n in root.walk() if n.parent is not None]
    for node in nodes:
        if node.tag == "table":
            add("html-table", node, rows_of(node, lambda r: r.tag == "tr", lambda c: c.tag in ("th", "td")), "HTML table")
    cell_roles = ("cell", "columnheader", "rowheader")
    for node in nodes:
        if node.attrs.get("role") == "table":
            rows = rows_of(node, lambda r: r.attrs.get("role") == "row", lambda c: c.attrs.get("role") in cell_roles)
            add("aria-grid", node, rows, "ARIA table")
    for node in nodes:
        if node.tag in ("section", "article", "div") and 2 <= len(node.elements()) <= CHILDREN:
            if not node.tables and node.whole[0].has_gate(*node.whole[1:]):
                if matrix := grid(node):
                    add("div-grid", node, matrix, "Grid section")
    for node in nodes:
        title = node.clean_text() if node.tag in ("h1", "h2", "h3", "h4") else ""
        if title and ADVICE.search(title):
            after = node.parent.elements()[node.at + 1 : node.at + 5]
            open_ = not any(s.tables or s.is_table() for s in after)
            text = clean("".join(s.whole[0].text[s.whole[1] : s.whole[2]] for s in after)) if open_ else ""
            if text:
                found.append((len(found), "advisory-text", [[title], [text]], [title], title, "", text))
    return found


_SCRIPT = re.compile(r"(?i)\b(?:function|const|let|window|document|fetch|queryselector)\b")


def links_of(root: Node) -> list[tuple]:
    found = []
    for node in root.walk():
        if node.tag == "a" and "href" in node.attrs:
            given = clean(node.attrs.get("aria-label", "")) or clean(node.attrs.get("title", ""))
            text, a, b = node.bare
            label = text.clean(a, b, 180) or given
            if len(label) > 180 or _SCRIPT.search(label):
                label = given
            if label and not label.startswith("!["):
                near = nearby(node, 180, 280, 320, lambda s: s.tag in HEADINGS)
                found.append((len(found), node.attrs["href"], label, heading_path(node), near))
    return found


def body_of(root: Node) -> str:
    """The clean text of a page without heads and RAW."""
    text, at, end = root.bare
    parts = []
    for node in root.walk():
        if node.tag == "head" and node.bare[1] >= at:
            parts.append(text.text[at : node.bare[1]])
            at = node.bare[2]
    parts.append(text.text[at:end])
    return clean("".join(parts))


def parse(documents: DataFrame, spread: bool = True) -> DataFrame:
    """url, renderer, n_tables, body, tables, links and error of documents (url, renderer, html).

    A page costs far more to parse than to ship, so documents are dealt to all tasks
    first: tables that html is made of may be one split. With spread false they are
    taken as they lie, which suits rows that a shuffle has just dealt. A null html gives empty lists. The whole html is parsed. A document that makes the
    parser raise has what it raised as its error and nothing else; the others don't suffer.
    """

    def read(html: str) -> tuple:
        root = parsed(html)
        return sum(n.is_table() for n in root.walk()), body_of(root), tables_of(root), links_of(root), None

    def run(batches):
        for part in batches:
            rows = []
            for url, renderer, html in zip(*(part[c].to_pylist() for c in ("url", "renderer", "html")), strict=True):
                try:
                    rows.append((url, renderer, *read(html or "")))
                except Exception as e:  # the page is at fault, and named
                    rows.append((url, renderer, 0, "", [], [], f"{type(e).__name__}: {e}"[:300]))
            columns = zip(*rows, strict=True) if rows else [()] * len(_ROWS)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _ROWS, strict=True)], schema=_ROWS)

    docs = documents.select("url", "renderer", "html")
    return (dealt(docs) if spread else docs).mapInArrow(run, SCHEMA)


def to_markdown(html: str) -> str:
    """Headings, then tables, then up to 12000 characters of text, blank lines between."""
    root = parsed(html or "")
    skip = frozenset((*RAW, "svg"))
    chunks = [f"{'#' * int(n.tag[1])} {t}" for n in root.walk() if n.tag in HEADINGS and (t := clean(n.text(skip)))]
    for node in root.walk():
        if node.tag == "table":
            rows = [r for r in rows_of(node, lambda r: r.tag == "tr", lambda c: c.tag in ("th", "td")) if any(r)]
            if len(rows) >= 2:
                width = max(map(len, rows))
                rows = [r + [""] * (width - len(r)) for r in rows]
                chunks += [" | ".join(r) for r in [rows[0], ["---"] * width, *rows[1:]]]
    if text := clean(root.text(frozenset(("head", *skip))))[:12000]:
        chunks.append(text)
    return "\n\n".join(chunks)


def with_markdown(documents: DataFrame) -> DataFrame:
    """documents with markdown filled in from the html where it is missing; empty where that can't be parsed.

    Documents are dealt to all tasks first, as in parse().
    """
    names = documents.columns

    def made(html: str) -> str:
        try:
            return to_markdown(html)
        except Exception:  # parse() names the error
            return ""

    def run(batches):
        for part in batches:
            blank = part["markdown"].isna() | (part["markdown"] == "")
            part.loc[blank, "markdown"] = part.loc[blank, "html"].map(made)
            yield part[names]

    return dealt(documents).mapInPandas(run, documents.schema)
