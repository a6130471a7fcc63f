"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks, which hang below elements. A linear classifier gives every block a cost of calling it content or
boilerplate from its own text: length, share of links, how it ends, its tag. Elements get such costs from their tag, role and
names, for each block below them. These costs become the capacities of edges to source and sink. Smoothness edges join
neighbours in page order, blocks to their element, and elements to the one around them, all on the scale of the costs, that of
log-odds. The minimum cut, found by maximum flow, parts content from boilerplate: what an element tells reaches its blocks,
and what blocks tell reaches the elements around them, through these edges alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import OUT_ROWS

# Elements of HTML by how they part text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button title head".split())
RAW = frozenset("script style noscript iframe textarea title".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table tr article section div main body td th blockquote".split())

# Weights of the classifier, log-odds, positive for content: of elements for each block below them, and of blocks.
OUTSIDE = {"nav": -8.0, "header": -8.0, "footer": -8.0, "aside": -8.0, "form": -6.0, "dialog": -8.0, "menu": -8.0, "address": -1.5, "article": 3.0, "main": 2.0}
OWN = {"h1": 1.5, "h2": 1.0, "h3": 1.0, "h4": 0.5, "h5": 0.5, "h6": 0.5, "p": 1.5, "blockquote": 1.0, "pre": 1.0, "figcaption": 0.5, "td": 0.0, "li": 0.0}
BIAS, PER_CHARS, MOST_CHARS, LINKS, SENTENCE, RIGHTS = -2.0, 100.0, 2.5, -3.0, 1.0, -1.5
# Of names: those of boilerplate, of content, of both at once, and of readers' comments; of hidden elements; and of a block that lies outside
# the article elements of a page whose text mostly lies in these.
BAD_NAME, GOOD_NAME, MIXED_NAME, COMMENTS, HIDDEN, APART = -6.0, 2.0, 0.0, -8.0, -20.0, -6.0
# Smoothness: between neighbours in page order below one element and below two; of content in a boilerplate element; of
# boilerplate in one of content, for a block of its own and for each block of an element in it.
BESIDE, ACROSS, UNDER, KEPT, WITHIN = 0.6, 0.3, 8.0, 4.0, 1.0
_BAD = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|captcha|consent|cookies?|footer|foot|gdpr|header|login|masthead|menu\w*|modal|nav\w*|newsletter|notice|notification|overlay|pagination|pager|paywall|popup|promo\w*|related|search\w*|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|tags|toolbar|topbar|widget)(?:$|[\s_-])", re.I)
_WITH = re.compile(r"\b(?:has|no|with|without)[_-][\w-]+", re.I)
_READERS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|discussion|feedback|guestbook|opinions?|replies|respond|responses|reviews?)(?:$|[\s_-])", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|body|content|entry|main|post|story|text)(?:$|[\s_-])", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ROLE = re.compile(r"(?:^|\s)role\s*=\s*[\"']?\s*([a-z]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    tag: str
    parent: int  # its element, -1 for none


@dataclass
class Element:
    tag: str
    parent: int
    lean: float  # what its tag and attributes say


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)
    stack: list[tuple[str, int]] = field(default_factory=list)  # tag and, unless inline, number
    outer: list[int] = field(default_factory=lambda: [-1])  # numbers of the open elements that are not inline
    anchors: int = 0
    parts: list[str] = field(default_factory=list)
    links: int = 0
    held: Counter = field(default_factory=Counter)  # open elements by tag, so that no end tag looks for one that isn't there

    def open(self, tag: str, lean: float) -> None:
        if tag == "header" and lean == OUTSIDE[tag] and self.held["article"]:
            lean = 0.0  # an article's own head
        self.held[tag] += 1
        number = -1
        if tag not in INLINE:
            self.elements.append(Element(tag, self.outer[-1], lean))
            number = len(self.elements) - 1
            self.outer.append(number)
        self.stack.append((tag, number))
        self.anchors += tag == "a"

    def flush(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        if text:
            at = self.outer[-1]
            self.blocks.append(Block(text, self.links, self.elements[at].tag if at >= 0 else "", at))
        self.parts, self.links = [], 0

    def close(self, at: int) -> int:
        """Close the stack from `at` on; how many of its elements hide their text."""
        gone = self.stack[at:]
        inner = sum(number >= 0 for _, number in gone)
        if inner:
            self.flush()
            del self.outer[-inner:]
        self.anchors -= sum(tag == "a" for tag, _ in gone)
        for tag, _ in gone:
            self.held[tag] -= 1
        del self.stack[at:]
        return sum(tag in SKIPPED for tag, _ in gone)


def _element_lean(tag: str, attributes: str) -> float:
    lean = OUTSIDE.get(tag, 0.0)
    if attributes:
        if _HIDDEN.search(attributes):
            return HIDDEN
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes))
        role = _ROLE.search(attributes)
        if role and role[1].lower() in ROLES:
            lean = min(lean, BAD_NAME)
        if names and tag not in ("html", "body"):
            names = _WITH.sub("", names)  # a body "with-sidebar" is no sidebar
            bad, good = _BAD.search(names), _GOOD.search(names)
            if _READERS.search(names) and tag != "article":
                lean = min(lean, COMMENTS)
            elif bad or good:
                lean += MIXED_NAME if bad and good else BAD_NAME if bad else GOOD_NAME
    return lean


def parsed(html: str) -> _Page:
    """The text blocks and elements of a page in order. Tag soup is mended: elements left open end with those around them."""
    page, at, skipped = _Page(), 0, 0
    leans: dict[tuple[str, str], float] = {}
    while at < len(html):
        found = _TOKEN.match(html, at)
        at = found.end()
        tag = found[2]
        if tag is None:
            token = found[0]
            if not skipped and (token[0] != "<" or token == "<"):
                words = unescape(token)
                page.parts.append(words)
                if page.anchors:
                    page.links += len(words.strip())
            continue
        tag = tag.lower()
        if found[1]:
            if not page.held[tag]:
                continue
            for i in range(len(page.stack) - 1, -1, -1):
                if page.stack[i][0] == tag:
                    skipped -= page.close(i)
                    break
                if tag in INLINE and page.stack[i][0] in SCOPES:
                    break
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                page.parts.append(" ")
                if tag == "hr":
                    page.flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag not in INLINE:
            page.flush()
            ending = CLOSES.get(tag, ())
            for i in range(len(page.stack) - 1, -1, -1) if page.held["p"] or any(page.held[own] for own in ending) else ():
                own = page.stack[i][0]
                if own == "p" or own in ending:
                    skipped -= page.close(i)
                elif own in SCOPES:
                    break
            if tag == "body" and page.held["head"]:  # a head left open ends here
                page.close(next((i for i, (own, _) in enumerate(page.stack) if own == "head"), len(page.stack)))
                skipped = 0
        if found[3].endswith("/") and tag in ("svg", "path"):
            continue
        key = (tag, found[3])
        if key not in leans:
            leans[key] = _element_lean(*key)
        page.open(tag, leans[key])
        skipped += tag in SKIPPED
    page.flush()
    return page


def score(block: Block) -> float:
    """Log-odds of content by the block's own text and tag."""
    size = len(block.text)
    out = BIAS + OWN.get(block.tag, 0.0) + min(MOST_CHARS, size / PER_CHARS) + LINKS * min(1.0, block.links / max(1, size))
    if block.text[-1] in ".!?…\"”»":
        out += SENTENCE
    if block.text[0] == "©" or "all rights reserved" in block.text[-80:].lower():
        out += RIGHTS
    return out


def minimum_cut(leans: list[float], edges: list[tuple[int, int, float, float]]) -> list[bool]:
    """True for the nodes on the side of the source, in a cut of least cost.

    A node of positive lean hangs on the source, else on the sink, and costs its lean on the other side. An edge (a, b, there,
    back) costs `there` if a alone is on the source's side, and `back` if b alone is.
    """
    n = len(leans)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, lean in enumerate(leans):
        link(*((source, i, lean, 0.0) if lean > 0 else (i, sink, -lean, 0.0)))
    for edge in edges:
        link(*edge)
    tiny = 1e-9
    while True:
        level = {source: 0}
        wave = [source]
        while wave and sink not in level:
            following = []
            for a in wave:
                for e in out[a]:
                    if room[e] > tiny and to[e] not in level:
                        level[to[e]] = level[a] + 1
                        following.append(to[e])
            wave = following
        if sink not in level:
            return [i in level for i in range(n)]
        turn = [0] * (n + 2)
        while True:  # blocking flow along the levels
            path: list[int] = []
            a = source
            while a != sink:
                while turn[a] < len(out[a]):
                    e = out[a][turn[a]]
                    if room[e] > tiny and level.get(to[e], -1) == level[a] + 1:
                        break
                    turn[a] += 1
                if turn[a] < len(out[a]):
                    path.append(out[a][turn[a]])
                    a = to[path[-1]]
                elif not path:
                    break
                else:
                    a = to[path.pop() ^ 1]
                    turn[a] += 1
            if a != sink:
                break
            flow = min(room[e] for e in path)
            for e in path:
                room[e] -= flow
                room[e ^ 1] += flow


def _apart(page: _Page) -> list[bool]:
    """True for the blocks outside all article elements, if most of what looks like content lies in these."""
    inside = [False] * len(page.elements)
    for i, element in enumerate(page.elements):
        inside[i] = element.tag == "article" or (element.parent >= 0 and inside[element.parent])
    sizes = [0, 0]
    for block in page.blocks:
        if score(block) > 0:
            sizes[block.parent >= 0 and inside[block.parent]] += len(block.text)
    told = sizes[1] > sizes[0]
    return [told and not (block.parent >= 0 and inside[block.parent]) for block in page.blocks]


def graph(page: _Page) -> tuple[list[float], list[tuple[int, int, float, float]]]:
    """Leans and edges of a page's graph: its blocks, then its elements.

    A block is joined to the nearest element around it that tells something, and so is that element to the next one. Content is
    dear below an element that is labelled boilerplate, and so is a block of boilerplate in an element that tells for content; an element of boilerplate
    within content is cheap. A block is also joined to
    its own element where that tells nothing, so that blocks side by side lean on each other.
    """
    n = len(page.blocks)
    telling: list[int] = []  # of each element, itself or the nearest around it that tells something
    around: list[int] = []
    for i, element in enumerate(page.elements):  # an element comes after the one around it
        around.append(telling[element.parent] if element.parent >= 0 else -1)
        telling.append(i if element.lean else around[i])
    below = [0] * len(page.elements)
    for block in page.blocks:
        if block.parent >= 0 and telling[block.parent] >= 0:
            below[telling[block.parent]] += 1
    for i in range(len(page.elements) - 1, -1, -1):
        if telling[i] == i and around[i] >= 0:
            below[around[i]] += below[i]
    apart = _apart(page)
    leans = [score(block) + APART * out for block, out in zip(page.blocks, apart, strict=True)] + [e.lean * k for e, k in zip(page.elements, below, strict=True)]
    edges = []
    for i, block in enumerate(page.blocks):
        if block.parent >= 0:
            if (at := telling[block.parent]) >= 0:
                edges.append((i, n + at, UNDER, WITHIN if page.elements[at].lean < 0 else KEPT))
            if at != block.parent and block.tag not in ("html", "body"):
                edges.append((i, n + block.parent, BESIDE, BESIDE))
        if i:
            near = BESIDE if block.parent == page.blocks[i - 1].parent else ACROSS
            edges.append((i - 1, i, near, near))
    for i, at in enumerate(around):
        if at >= 0 and telling[i] == i and below[i]:
            edges.append((n + i, n + at, UNDER * below[i], WITHIN * below[i]))
    return leans, edges


def label(page: _Page) -> list[bool]:
    """True for the blocks that are content."""
    return minimum_cut(*graph(page))[: len(page.blocks)]


def main_text(html: str | None) -> str:
    page = parsed(html or "")
    return "\n".join(b.text for b, content in zip(page.blocks, label(page), strict=True) if content)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of `pages`.

    text is the content of the whole html, blocks joined by a newline; empty for a null or empty html or where nothing is
    content. Pages are labelled one by one, so rows may repeat, ids may repeat or be null, and other columns don't matter. An empty
    table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, weight, from_ = [], 0, 0
            for i in range(batch.num_rows):
                texts.append(main_text(batch.column(2)[i].as_py()))
                weight += len(texts[-1])
                if weight >= 4 << 20 or len(texts) >= OUT_ROWS or i + 1 == batch.num_rows:
                    part = batch.slice(from_, len(texts))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
                    texts, weight, from_ = [], 0, i + 1

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
