"""Main text of web pages by a minimum cut.

A page is read into blocks of text in page order. A linear classifier over a block's
own text and the elements around it gives the cost of calling it content or
boilerplate; these costs become capacities to the two terminals. Neighbouring blocks
and blocks near each other in the document tree are joined by smoothness edges. The
minimum cut, found by maximum flow, is the labelling of least total cost.

Pages are independent, so this is one pass without a shuffle.

Defined results: a NULL or empty page, or one without text, has the empty text. Broken
markup (unclosed or cut-off tags, references without a semicolon) is read as far as it
goes. Repeated pages are read one by one; other columns are not returned.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm.common import pieces, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s>/]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s>/]*)([^>]*)>|<[!?][^>]*>|</?[a-zA-Z!?][^>]*\Z|</[^>]*>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|type|itemprop|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# HTML element names by their role.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas textarea select title audio video".split())
#: of these, elements whose inside is not markup, so that the next closing tag ends them
RAW = frozenset("script style noscript iframe textarea title".split())
CLOSING = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for n in RAW}
NESTED = {n: re.compile(rf"<!--.*?-->|<(/?){n}(?=[\s/>]|\Z)([^>]*)(?:>|\Z)", re.I | re.S) for n in SKIPPED - RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section"
    " summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html"}

#: log odds that text inside an element is content, by element and by words in its
#: class, id and role
ELEMENT_ODDS = {"article": 3.0, "main": 1.5, "nav": -7.0, "footer": -6.0, "aside": -6.0, "form": -6.0,
                "header": -4.0, "menu": -6.0, "dialog": -6.0, "button": -5.0, "label": -3.0, "legend": -3.0,
                "address": -2.0, "figcaption": -0.5, "blockquote": 0.5, "fieldset": -4.0}
CLASS_ODDS = {
    **dict.fromkeys("article content story entry prose body main".split(), 1.5),
    **dict.fromkeys("nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toolbar".split(), -6.0),
    **dict.fromkeys("footer foot header masthead banner contentinfo topbar".split(), -5.0),
    **dict.fromkeys("sidebar aside widget related recommended recommendations promo complementary rail".split(), -6.0),
    **dict.fromkeys("ad ads advert adverts advertisement advertising sponsor sponsored sponsors".split(), -7.0),
    **dict.fromkeys("comment comments reply replies respond discussion disqus".split(), -9.0),
    **dict.fromkeys("cookie cookies consent gdpr notice alert newsletter subscribe signup subscription popup modal overlay".split(), -7.0),
    **dict.fromkeys("share sharing social login search copyright legal disclaimer skip hidden".split(), -6.0),
}
#: once inside the article these lose their weight: a page's own headline block
SOFT_IN_ARTICLE = frozenset(("header", "banner", "masthead"))


@dataclass
class Element:
    name: str
    odds: float
    key: int
    up: "Element | None"
    article: bool
    hidden: bool

    def __post_init__(self):
        #: the least and the largest odds of this element and those around it
        self.worst = min(self.odds, self.up.worst if self.up else 0.0)
        self.best = max(self.odds, self.up.best if self.up else 0.0)


class Stack(list):
    """The open elements, with the places of each name and of block elements, so that a
    tag costs the same however deep the page is nested."""

    def __init__(self, root: Element):
        super().__init__([root])
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = []

    def open(self, element: Element) -> None:
        self.places.setdefault(element.name, []).append(len(self))
        if element.name in BLOCK:
            self.block_places.append(len(self))
        self.append(element)

    def last(self, name: str) -> int:
        """Where the innermost open element of a name stands; 0 if there is none."""
        places = self.places.get(name)
        return places[-1] if places else 0

    def close(self, depth: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self) > depth:
            element = self.pop()
            self.places[element.name].pop()
            if element.name in BLOCK:
                self.block_places.pop()

    def holds(self, *names: str) -> bool:
        return any(self.places.get(name) for name in names)


@dataclass
class Block:
    """A run of text without block-level markup, and where it stands; ``opened`` counts
    the elements opened before it."""

    element: Element
    opened: int
    heading: bool = False
    item: bool = False
    linked: int = 0
    pieces: list[str] = field(default_factory=list)

    @property
    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


def _element(name: str, attributes: str, key: int, up: Element | None) -> Element:
    odds = ELEMENT_ODDS.get(name, 0.0)
    article = bool(up and up.article) or name == "article"
    hidden = bool(up and up.hidden)
    worst = best = 0.0
    for match in ATTRIBUTE.finditer(attributes) if attributes and not attributes.isspace() else ():
        kind, value = match[1].lower(), (match[2] or "").strip("\"'")
        if kind == "hidden" or kind == "aria-hidden" and value == "true":
            hidden = True
        elif kind == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif kind in ("class", "id", "role", "itemprop"):
            if name in ("html", "body"):
                continue
            for word in NAME.findall(value):
                o = CLASS_ODDS.get(word.lower(), 0.0)
                if up and up.article and word.lower() in SOFT_IN_ARTICLE:
                    o = 0.0
                worst, best = min(worst, o), max(best, o)
    if up and up.article and name in SOFT_IN_ARTICLE:
        odds = 0.0
    odds = min(odds, worst) if worst < 0 else odds + best
    return Element(name, odds, key, up, article, hidden)


def _ends(html: str, name: str) -> tuple[dict[int, int], list[int], list[int]]:
    """Where each element of a name ends, by where it starts; and all starts and ends of
    its closing tags."""
    pairs, opened, starts, ends = {}, [], [], []
    for match in NESTED[name].finditer(html):
        if match[1]:
            starts.append(match.start())
            ends.append(match.end())
            if opened:
                pairs[opened.pop()] = match.end()
        elif match[1] is not None and not match[2].rstrip().endswith("/"):
            opened.append(match.start())
    return pairs, starts, ends


def blocks(html: str) -> list[Block]:
    """The blocks of a page that hold text, in page order."""
    root = Element("html", 0.0, 0, None, False, False)
    stack, found, current = Stack(root), [], None
    keys, at = 0, 0
    closed: dict[str, tuple[dict[int, int], list[int], list[int]]] = {}

    def add(text: str) -> None:
        nonlocal current
        if current is None:
            if text.isspace():
                return
            current = Block(stack[-1], keys, stack.holds("h1", "h2", "h3", "h4", "h5", "h6"),
                            stack.holds("li", "dt"))
            found.append(current)
        current.pieces.append(text)
        if stack.holds("a"):
            current.linked += len(text.strip())

    def behind(name: str, start: int, inside: int) -> int:
        """Where a skipped element ends: the end of the page if nothing closes it."""
        if name in RAW:
            match = CLOSING[name].search(html, inside)
            return match.end() if match else len(html)
        pairs, starts, ends = closed.get(name) or closed.setdefault(name, _ends(html, name))
        if start in pairs:
            return pairs[start]
        k = bisect_left(starts, inside)
        return ends[k] if k < len(ends) else len(html)

    while match := TOKEN.search(html, at):
        if match.start() > at:
            add(unescape(html[at:match.start()]))
        at = match.end()
        slash, name = (match[1], match[2]) if match[2] else (match[4], match[5])
        if not name:
            continue
        name = name.lower()
        if slash:
            if name == "br":
                add(" ")
            if name in BLOCK:
                current = None
            depth = stack.last(name)
            if depth:
                stack.close(depth)
            continue
        if name == "br":
            if current is not None:
                add(" ")
            continue
        if name in BLOCK:
            current = None
            if name in CLOSES_P:
                depth = stack.last("p")
                if depth and stack.block_places[-1] == depth:
                    stack.close(depth)
            if name == "li" and stack[-1].name == "li":
                stack.close(len(stack) - 1)
        attributes = match[3] if match[2] else match[6]
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        if name in SKIPPED:
            at = behind(name, match.start(), at)
            continue
        keys += 1
        stack.open(_element(name, attributes, keys, stack[-1]))
    if at < len(html):
        add(unescape(html[at:]))
    return [b for b in found if not b.element.hidden and b.text]


def content_odds(block: Block, text: str) -> float:
    """Log odds that a block is content."""
    n_words = text.count(" ") + 1
    odds = -1.5 + 0.08 * min(n_words, 40)
    if text[-1] in ".!?:;\"'”»…":
        odds += 0.7
    odds -= 3.0 * min(1.0, block.linked / max(1, len(text)))
    if block.item:
        odds -= 0.3
    if "©" in text[:3] or text[:9].lower() == "copyright":
        odds -= 3.0
    element = block.element
    if block.heading:
        odds += 1.5 if element.article else 0.5
    return odds + element.worst + (element.best if element.worst > -2.0 else 0.0)


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the content side of a minimum cut (Dinic's maximum flow)."""
    n = len(odds)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    head: list[int] = []
    room: list[float] = []

    def link(a: int, b: int, forth: float, back: float) -> None:
        graph[a].append(len(head))
        head.append(b)
        room.append(forth)
        graph[b].append(len(head))
        head.append(a)
        room.append(back)

    for i, o in enumerate(odds):
        if o > 0:
            link(source, i, o, 0.0)
        elif o < 0:
            link(i, sink, -o, 0.0)
    for a, b, weight in edges:
        link(a, b, weight, weight)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] > 1e-9 and level[head[e]] < 0:
                    level[head[e]] = level[a] + 1
                    queue.append(head[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        nexts = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                a = head[path[cut] ^ 1]
                del path[cut:]
                continue
            while nexts[a] < len(graph[a]):
                e = graph[a][nexts[a]]
                if room[e] > 1e-9 and level[head[e]] == level[a] + 1:
                    break
                nexts[a] += 1
            if nexts[a] < len(graph[a]):
                path.append(graph[a][nexts[a]])
                a = head[path[-1]]
            elif path:
                level[a] = -1
                a = head[path.pop() ^ 1]
            else:
                break


def extract(html: str | None, adjacency: float = 0.4, proximity: float = 0.6) -> str:
    """The main text of a page."""
    found = blocks(html) if html else []
    if not found:
        return ""
    texts = [b.text for b in found]
    odds = [content_odds(b, t) for b, t in zip(found, texts)]
    edges = []
    for i in range(1, len(found)):
        edges.append((i - 1, i, adjacency))
        # the block before stands below the same parent, if that was open then
        parent = found[i].element.up
        if parent is not None and parent.up is not None and found[i - 1].opened >= parent.key:
            edges.append((i - 1, i, proximity))
    kept = min_cut(odds, edges)
    return "\n".join(t for t, k in zip(texts, kept) if k)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and its length in code points for every page."""
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        F.col(html_col).alias("html"))
    schema = f"page_id {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [extract(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return slim.mapInArrow(read, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
