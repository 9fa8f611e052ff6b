"""Main text of web pages by composite text density.

A page is read into a light tree.  Parts that are never the article (scripts, menus, page
headers and footers, sidebars, notices, adverts, forms, reader comments) are set aside by
their element or by a whole word of their role, class or id.  They are read into the same tree,
so one without an end ends with its ancestor or where an end is implied, and one that holds a
``main``, the page's only ``article`` or, on a page of neither, most of its unlinked text in elements
of its own, is not set aside.  For every other node the density is its characters per tag,
adjusted by the share of linked characters and tags; a node's density sum is that of its
children.  The node of the largest density sum is the core; the least density on its path to
the body is the threshold, and every subtree that reaches it adds its own largest-sum node.
What stands beside the path to the core is recovered up to the outermost element below the body,
or to the ``article`` or ``main`` around the core: text of these elements themselves, and
headings, paragraphs, lists and tables that are not half links.  Of other elements there a dense
one is taken by the threshold; one that is not needs to be in an ``article`` or ``main``, or be a ``section``
with a heading, paragraphs or the like.  A heading right before all that is taken too.

Blocks (paragraphs, headings, list items and so on) have references decoded, white space made
one space and trimmed, and are joined by two line feeds.

Nulls: a null html counts as an empty page with empty text; null page_id and url stay null.
Ties: of nodes of one density sum the first is taken, an outer one before those in it.  Repeated rows each get their row, an empty table gives none, pages of any length are read
whole, and columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe svg math".split())
DROPPED = frozenset("head nav footer aside form button dialog menu label fieldset template select option object canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CLOSES_P = BLOCKS - {"body", "html"}
#: Starting one of these ends an open one of the same kind in the same list or table.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIST_ENDS = frozenset("ul ol dl table".split())
# Words in a class, id or role that mark a part beside the article.
ASIDE = frozenset(
    "ad ads advert advertisement adverts sponsor sponsored promo promotion comment comments disqus reply replies sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices banner alert popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login search widget pagination pager toolbar contentinfo complementary form skip".split()
)
#: Words after such a word that still name the same part, as in comments-list.
PLACES = frozenset("list lists item items box area section block wrapper wrap container inner outer holder body content row col column group panel slot unit zone region bar links link left right top bottom primary secondary main text title icon icons button buttons btn".split())
#: First words of names that tell of a node what it has, not what it is, as in no-sidebar.
STATES = frozenset("has have no with without is not non hide hides show shows".split())
#: Elements of running text, and containers that can be the article.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl li dt dd table tbody thead tfoot tr caption figure figcaption hr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset("article main".split())
#: Names of parts that an article has too, and words that name a part of it if another word says of what, as in price-alert.
IN_ARTICLES = frozenset("header masthead banner".split())
OF_WHAT = frozenset("alert notice notices form search overlay skip bar".split())
#: Elements that hold an article's text.
PROSE = frozenset("p ul ol dl pre blockquote table".split())
NEVER_ASIDE = frozenset("html body article main h1 h2 h3 h4 h5 h6 p".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^>]*(?:>|\Z))",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_NAME = re.compile(r"[A-Za-z]+")


SET_ASIDE, HIDDEN = 1, 2


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "first", "last", "density", "total", "best", "aside", "named_aside", "cut", "unlinked", "holds")

    def __init__(self, tag: str, parent: Node | None, first: int, aside: int = 0, named_aside: bool = False) -> None:
        self.tag, self.parent, self.first, self.last = tag, parent, first, first
        self.children: list[Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.aside, self.named_aside = aside, named_aside
        #: Whether it is left out at last, its characters outside links, and the articles or main elements in it.
        self.cut, self.unlinked, self.holds = False, 0, frozenset()
        #: The node of the largest density sum in it.
        self.best = self
        if parent is not None:
            parent.children.append(self)


@lru_cache(1 << 14)
def _names_aside(names: str, within_article: bool) -> bool:
    """Whether a word of a class, id or role names a part beside the article."""
    for name in names.split():
        words = [w.lower() for w in _NAME.findall(name)]
        if not words or words[0] in STATES:
            continue
        while len(words) > 1 and words[-1] in PLACES:
            words.pop()
        if words[-1] not in ASIDE or (within_article and words[-1] in IN_ARTICLES):
            continue
        if not (within_article and words[-1] in OF_WHAT and any(w not in ASIDE for w in words)):
            return True
    return False


def _marks(rest: str, within_article: bool) -> tuple[bool, bool]:
    """Whether an element is hidden by its attributes, and whether its class, id or role names a part beside the article."""
    hidden = named = False
    for name, double, single, bare in _ATTRIBUTE.findall(rest):
        name = name.lower()
        if name in ("class", "id", "role"):
            named = named or _names_aside(double or single or bare, within_article)
        elif name == "hidden":
            hidden = True
        elif name == "style" and _NO_DISPLAY.search(double or single or bare):
            hidden = True
    return hidden, named


def _aside(tag: str, rest: str, within_article: bool) -> tuple[int, bool]:
    """0, SET_ASIDE or HIDDEN; and whether a name sets it aside."""
    hidden, named = _marks(rest, within_article) if len(rest) > 2 and tag not in ("html", "body") else (False, False)
    if hidden:
        return HIDDEN, named
    if tag in DROPPED or (tag == "header" and not within_article):
        return SET_ASIDE, named
    return SET_ASIDE if named and tag not in NEVER_ASIDE and tag != "header" else 0, named


def parse(page: str) -> tuple[Node, list[str]]:
    """The tree of a page and its blocks; every node covers a range of blocks."""
    root = Node("html", None, 0)
    stack, blocks, parts, owners = [root], [], [], []
    asides: list[Node] = []  # open nodes that are set aside
    articles = 0  # article and main elements open
    links = 0
    opened: dict[str, int] = {}  # open nodes by tag
    outer: list[int] = []  # depths of open blocks and cells, and of what a list or table is made of
    listed: list[int] = []
    position, size = 0, len(page)
    endless: set[str] = set()  # elements of which no end follows any more

    def flush() -> None:
        if parts:
            if any(owners):  # what is left of it shows at the end
                if any(map(str.strip, parts)):
                    blocks.append(list(zip(parts, owners, strict=True)))
            elif text := _clean(parts):
                blocks.append(text)
            parts.clear()
            owners.clear()

    def close(depth: int) -> None:
        """Close the open nodes from ``depth`` on."""
        nonlocal articles, links
        while len(stack) > depth:
            node = stack.pop()
            if node.tag in BLOCKS:
                flush()
            node.last = len(blocks) + bool(parts)
            if node.aside:
                asides.pop()
            opened[node.tag] -= 1
            for open_depths in (outer, listed):
                if open_depths and open_depths[-1] == len(stack):
                    open_depths.pop()
            articles -= node.tag in WHOLE
            links -= node.tag == "a"

    def add(text: str) -> None:
        n = len(text) - text.count(" ") - text.count("\n")
        if n:
            stack[-1].chars += n
            if links:
                stack[-1].link_chars += n
        put(text)

    def put(text: str) -> None:
        parts.append(text)
        owners.append(asides[-1] if asides else None)

    while position < size:
        m = _TOKEN.search(page, position)
        if m is None:
            add(page[position:])
            break
        if m.start() > position:
            add(page[position : m.start()])
        position = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if opened.get(tag):
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                close(depth)
            continue
        if tag in BLOCKS:
            flush()
            if len(stack) > 1 and stack[1].tag == "head":
                close(1)
        rest = m["rest"]
        if tag in RAW:
            if not rest.endswith("/>") and tag not in endless:
                end = _end(page, position, tag)
                if end is None:
                    endless.add(tag)
                    end = position if tag in ("svg", "math") else size  # as browsers have it
                position = end
            continue
        aside, named = _aside(tag, rest, articles > 0)
        if aside and (tag in VOID or rest.endswith("/>")):
            continue
        if tag in ("br", "td", "th", "wbr"):
            put("" if tag == "wbr" else " ")
        if tag in CLOSES_P and outer and stack[outer[-1]].tag == "p":
            close(outer[-1])
        if tag in SIBLINGS:
            for depth in reversed(listed):
                if stack[depth].tag in SIBLINGS[tag]:
                    close(depth)
                    break
                if stack[depth].tag in LIST_ENDS:
                    break
        if tag in VOID:
            stack[-1].tags += 1
            continue
        if tag in ("html", "body"):
            continue
        node = Node(tag, stack[-1], len(blocks), aside, named)
        if tag in BLOCKS or tag in ("td", "th"):
            outer.append(len(stack))
        if tag in SIBLINGS or tag in LIST_ENDS:
            listed.append(len(stack))
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1
        if aside:
            asides.append(node)
        articles += tag in WHOLE
        links += tag == "a"
    close(1)
    flush()
    root.last = len(blocks)
    _settle(root)
    return root, [b if isinstance(b, str) else _clean([x for x, owner in b if owner is None or not owner.cut]) for b in blocks]


def _clean(parts: list[str]) -> str:
    """One block: each run of text has its references decoded by itself, as none reaches over a tag."""
    return " ".join("".join(map(html.unescape, parts)).split())


def _below(root: Node) -> list[Node]:
    """All nodes, parents before children."""
    nodes, k = [root], 0
    while k < len(nodes):
        nodes.extend(nodes[k].children)
        k += 1
    return nodes


def _settle(root: Node) -> None:
    """Cut what is set aside from the tree and sum characters and tags of what stays."""
    nodes = _below(root)
    outside = False  # an article or main element that nothing sets aside
    for n in nodes[1:]:
        n.cut = n.parent.cut or n.aside > 0
        outside |= n.tag in WHOLE and not n.named_aside and not n.cut
    for n in reversed(nodes):
        n.unlinked += n.chars - n.link_chars
        if n.tag in WHOLE and not n.named_aside:
            n.holds |= {n.tag}
        if n.parent is not None and n.aside != HIDDEN:
            n.parent.unlinked += n.unlinked
            n.parent.holds |= n.holds
    for n in nodes[1:]:
        whole = "main" in n.holds or (not outside and ("article" in n.holds or (not root.holds and 2 * (n.unlinked - n.chars + n.link_chars) > root.unlinked)))
        n.cut = n.parent.cut or n.aside == HIDDEN or (n.aside == SET_ASIDE and not whole)
    for n in reversed(nodes):
        n.children = [x for x in n.children if not x.cut]
        up = n.parent
        if up is not None and not n.cut:
            up.chars += n.chars
            up.tags += n.tags + 1
            up.link_chars += n.link_chars
            up.link_tags += n.link_tags + (n.tag == "a")


def _end(page: str, position: int, tag: str) -> int | None:
    """The place after the end of an element whose content is no markup; None without one."""
    m = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, position)
    return m.end() if m else None


def weigh(root: Node) -> list[Node]:
    """Densities and density sums of all nodes, parents before children."""
    nodes = _below(root)
    linked = root.link_chars / max(root.chars, 1)
    for n in nodes:
        if n.chars:
            c, t = n.chars, max(n.tags, 1)
            ratio = c / max(n.link_chars, 1) * t / max(n.link_tags, 1)
            base = math.log(c / max(c - n.link_chars, 1) * n.link_chars + linked * c + math.e)
            n.density = c / t * math.log(ratio) / math.log(base + math.e - 1)  # nothing but links: 0
    for n in reversed(nodes):
        n.total = sum(x.density for x in n.children)
        n.best = max([n, *(x.best for x in n.children)], key=lambda x: x.total)
    return nodes


def main_text(page: str | None) -> str:
    """The text of the page's main content; empty if it has none."""
    if not page:
        return ""
    root, blocks = parse(page)
    if not blocks:
        return ""
    edges = [0] * (len(blocks) + 1)
    for n, sign in chosen(root):
        edges[n.first] += sign
        edges[min(n.last, len(blocks))] -= sign
    return "\n\n".join(b for b, use in zip(blocks, accumulate(edges), strict=False) if use > 0 and b)


def _tells(section: Node) -> bool:
    """Whether a section has a heading or text of its own kind: then it is one of the document's, however short."""
    return any(x.tag in PROSE or x.tag in HEADINGS for x in section.children)


def chosen(root: Node) -> list[tuple[Node, int]]:
    """Nodes whose blocks are taken (1) and, within the element around the core, left out again (-1)."""
    nodes = weigh(root)
    path = [root.best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    dense = {id(n.best): n.best for n in nodes[1:] if n.density >= threshold}
    dense.pop(id(path[0]), None)
    taken = [(path[0], 1), *((n, 1) for n in dense.values())]
    if path[0] is root:
        return taken
    inside = next((k for k, n in enumerate(path) if n.tag in WHOLE), None)
    top = len(path) - 2 if inside is None else inside
    taken.append((path[top], 1))
    for above, below in zip(path[top:0:-1], path[top - 1 :: -1] if top else [], strict=False):
        for n in above.children:
            if n is not below and n.tag in BLOCKS and not (2 * n.link_chars <= n.chars and (n.tag in RUNNING or inside is not None or (n.tag == "section" and _tells(n)))):
                taken.append((n, -1))
    beside = path[top + 1].children
    at = next(k for k, n in enumerate(beside) if n is path[top])
    if at and beside[at - 1].tag in HEADINGS and 2 * beside[at - 1].link_chars <= beside[at - 1].chars:
        taken.append((beside[at - 1], 1))
    return taken


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kept = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return kept.mapInArrow(run, "page_id long, url string, text string, n_chars long")
