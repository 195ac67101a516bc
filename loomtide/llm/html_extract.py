"""HTML extraction by composite text density.

A page becomes a tree. What is never the article (menus, page headers, footers, side bars, forms, scripts, styles, hidden
parts) is cut first, by tag and role; one that is never closed ends at the next block. For every node left, the density is
its characters per tag, adjusted by how many of them are in links (against the page's own share); a node's sum is its
children's densities. Inline elements count as tags, but split no text: those that hold no block have no sum, and their
blocks are their parent's. The node with the largest sum marks the article (of equal sums the outer, then the first); the
least density on its path up to the body is the threshold. From the body down, of every element that reaches the
threshold the subtree with the largest sum is text.

Where the marked node is in an article or main element, all of that element is text, short sections too, but for lists of
three links and more that are little else; so is every other article of which less than half is links. An h1 beside the
path is added: it is too short to reach a threshold.

Classes and ids are hints, and of two kinds. A name is sure if all its words are words for adverts, comments, side bars and the like,
for what a thing is made of (box, list, links) or where it stands, and one of the first or two fitting ones are there: comment-list,
ad-slot-2, related-posts. It cuts an element that holds no article, main or h1, if all such elements together hold less than half
of the page's text (nine tenths, where an article or main element is elsewhere; where they hold more, only those less dense than
the body go), and one that holds an article, if it is not the marked one. A name that only begins so (related-work,
search-tips), or with a word that articles use too (legal, reply, header), cuts an element only outside the marked article, or
where half of its text is links. A form is cut unless it wraps the page: holds an article, main or h1, or paragraphs and half of all text.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one space. Null,
empty and text-free pages give the empty text. Pages are whole however long; unclosed and stray tags are tolerated; each
row is extracted by itself.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ANY_TAG = r"<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
_PLAIN = re.compile(rf"<!--.*?(?:-->|\Z)|{_ANY_TAG}", re.S)
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|{_ANY_TAG}", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that are never the article's text.
CUT = frozenset("script style noscript template head title iframe object embed svg canvas audio video nav footer aside button select option textarea input fieldset dialog menu".split())
#: A start of any of these ends an open p.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An open p outside any of these stays open.
P_STAYS_IN = ("table", "td", "th", "article", "section", "div", "body", "blockquote", "li")
#: A start of the key ends an open element of the value, up to one of the borders.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Words for what stands beside an article.
BESIDE = re.compile(
    r"ads?|advert\w*|adsense|banners?|sponsor\w*|promos?|promotions?|cookies?|consent|gdpr|popups?|modals?|overlays?|newsletters?|subscri\w*|sidebars?|widgets?|menus?|nav|navs|navbar|navigation"
    r"|breadcrumbs?|footers?|masthead|topbar|comments?|commentlist|disqus|pagination|pager|toolbar|login|signup"
)
#: Words that an article may use for its own parts.
EITHER = re.compile(r"notices?|alerts?|side|headers?|legal|disclaimers?|copyright|discussions?|responses?|share|sharing|social|respond|reply|replies|related|recommend\w*|search")
#: Words for what a thing is made of: with one of them a word of the second kind is one of the first.
MADE_OF = re.compile(r"bars?|box|boxes|buttons?|icons?|links?|posts?|articles?|stories|form|forms|widget")
#: Words and numbers that do not change what the others say.
BEFORE = re.compile(
    r"site|page|main|top|bottom|left|right|article|user|reader|global|primary|secondary|google|blog|entry|inline|mobile|desktop|slot|unit|wrap|wrapper|container|content|block|section|area|list|items?|panel"
    r"|inner|outer|row|col|column|group|thread|title|heading|body|text|img|image|label|\w?\d+\w*"
)
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())


class Node:
    __slots__ = ("name", "parent", "parts", "kids", "away", "hint", "chars", "links", "tags", "link_tags", "density", "blocks", "total", "top", "keep", "depth", "block", "open")

    def __init__(self, name: str, parent: Node | None, away: bool = False) -> None:
        self.name, self.parent, self.away = name, parent, away
        self.depth = parent.depth + 1 if parent else 0
        self.block = parent.block if parent and name in INLINE else self.depth  # of the nearest element that is not inline
        self.open, self.hint = True, 0
        self.parts: list[str | Node] = []
        self.kids: list[Node] = []
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.blocks = self.total = 0.0
        self.top: Node = self
        self.keep = False


def _away(name: str, raw: str, sectioned: bool) -> bool:
    if name in CUT:
        return True
    if name == "header":
        return not sectioned
    if not raw.strip() or name in ("html", "body", "article", "main"):
        return False
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)}
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    if a.get("role", "").lower() in _ROLES:
        return True
    return False


def _hint(name: str, raw: str) -> int:
    """What class or id say: 2, that the element stands beside the article; 1, that it may; 0, nothing."""
    if not raw.strip() or name in ("html", "body", "article", "main", "h1", "h2", "a"):
        return 0
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)}
    most = 0
    for token in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", f"{a.get('class', '')} {a.get('id', '')}").lower().split():
        words = [w for w in re.split(r"[_-]+", token) if w]
        sure, may, made = ([bool(x.fullmatch(w)) for w in words] for x in (BESIDE, EITHER, MADE_OF))
        known = all(s or m or k or BEFORE.fullmatch(w) for s, m, k, w in zip(sure, may, made, words, strict=True))
        if known and (any(sure) or any(may) and any(made)):
            return 2
        most = max(most, int(any(sure[:1] + may[:1]) or known and any(may)))
    return most


_CLOSED = sorted((CUT | {"form"}) - RAW - VOID)
_OPENED = re.compile(rf"<(/?)({'|'.join(_CLOSED)}|header)(?=[\s/>])", re.I)


def _unclosed(page: str) -> frozenset[int]:
    """Where elements start that are cut by their tag and never closed."""
    low = page.lower()
    if all(low.count(f"<{n}") <= low.count(f"</{n}") for n in (*_CLOSED, "header")):
        return frozenset()
    open_: dict[str, list[int]] = {}
    for m in _OPENED.finditer(page):
        at = open_.setdefault(m[2].lower(), [])
        if not m[1]:
            at.append(m.start())
        elif at:
            at.pop()
    return frozenset(k for at in open_.values() for k in at)


def _inside(node: Node | None, names: tuple[str, ...]) -> Node | None:
    while node is not None and node.name not in names:
        node = node.parent
    return node


def parse(page: str) -> list[Node]:
    """The nodes in page order; the first is the root. Text is decoded; what is cut away has no text. Open elements are kept by
    name, so no tag, stray or not, walks along all that is open."""
    root = Node("#root", None)
    nodes, at, k = [root], root, 0
    away = 0  # open elements that are cut
    n, unclosed = len(page), _unclosed(page)
    last_tag, last_cdata = page.rfind(">"), page.rfind("]]>")
    opened: dict[str, list[Node]] = {}
    short: list[Node] = []  # open elements that end at the next block

    def close(to: Node) -> None:
        nonlocal at, away
        while True:
            away -= at.away
            at.open = False
            opened[at.name].pop()
            at, done = at.parent, at is to
            if done:
                return

    def deepest(names) -> int:
        return max((opened[x][-1].depth for x in names if opened.get(x)), default=-1)

    while k < n:
        m = (_TAG if k <= last_cdata else _PLAIN).search(page, k) if k <= last_tag or page.find("<!--", k) >= 0 else None
        stop = m.start() if m else n
        if stop > k and not away:
            at.parts.append(html.unescape(page[k:stop]))
        if not m:
            break
        k = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, end, raw = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if end:
            if name == "br":
                at.parts.append(" ")
            elif opened.get(name) and (name not in INLINE or opened[name][-1].depth > at.block):  # no inline end tag ends a block
                close(opened[name][-1])
            continue
        if short and (name in ENDS_P or name == "body"):
            if short[0].open:
                close(short[0])
            short.clear()
        if name in ENDS_P:
            if opened.get("p") and opened["p"][-1].depth > deepest(P_STAYS_IN):
                close(opened["p"][-1])
        elif name in SIBLINGS:
            ends, borders = SIBLINGS[name]
            over, found = deepest(borders), None
            for x in ends:
                inside = opened.get(x, [])
                first = next((i for i in range(len(inside), 0, -1) if inside[i - 1].depth <= over), 0)
                if first < len(inside) and (found is None or inside[first].depth < found.depth):
                    found = inside[first]
            if found is not None:
                close(found)
        elif name == "body" and opened.get("head"):
            close(opened["head"][-1])
        if name in ("html", "body") and opened.get(name):
            continue
        node = Node(name, at, _away(name, raw, any(opened.get(x) for x in ("article", "main", "section"))))
        if not away and not node.away:
            node.hint = _hint(name, raw)
            at.parts.append(node)
            at.kids.append(node)
            nodes.append(node)
        if name in VOID or raw.rstrip().endswith("/") and name not in RAW and name in ("svg", "path"):
            continue
        if name in RAW:
            shut = re.compile(rf"</{name}[\s/>]", re.I).search(page, k)
            if shut is None:
                break
            k = page.find(">", shut.start()) + 1 or n
            continue
        at = node
        opened.setdefault(name, []).append(node)
        away += node.away
        if (node.away or name == "form") and m.start() in unclosed:
            short.append(node)
    return nodes


def _below(nodes: list[Node], top: Node) -> set[Node]:
    """``top`` and what is inside it."""
    out = {top}
    for node in nodes:  # parents come before their children
        if node.parent in out:
            out.add(node)
    return out


def _measure(nodes: list[Node]) -> None:
    for node in reversed(nodes):  # children come after their parents
        node.chars = node.links = node.tags = node.link_tags = 0
        node.density, node.top = 0.0, node
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len("".join(part.split()))
        for kid in node.kids:
            node.chars += kid.chars
            node.tags += kid.tags + 1
            node.links += kid.links
            node.link_tags += kid.link_tags + (kid.name == "a")
        if node.name == "a":
            node.links = node.chars
    body = nodes[0]
    share = body.links / max(1, body.chars)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(1, node.tags), node.links, max(1, node.link_tags)
        if c:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            node.density = c / t * max(0.0, math.log(max(1.0, c / max(1, lc) * t / lt))) / max(base, 1e-9)
            if not node.tags:  # a leaf: log(1) would be 0 for one tag and no links
                node.density = max(node.density, c / t * math.log(max(1.0, c / max(1, lc))) / max(base, 1e-9))
        node.blocks = sum(k.blocks if k.name in INLINE else k.density for k in node.kids)
        node.total = node.blocks or (0.0 if node.name in INLINE else node.density)
        # of equal sums the outer and then the first node
        node.top = max([node, *(k.top for k in node.kids)], key=lambda x: x.total)


def _without(nodes: list[Node], cut: set[Node]) -> list[Node]:
    """The nodes in page order, measured, without some of them and what is in them."""
    if not cut:
        return nodes
    for x in cut:
        x.away = True
    left: list[Node] = []
    for node in nodes:
        node.away = node.away or node.parent is not None and node.parent.away
        if not node.away:
            node.kids = [k for k in node.kids if k not in cut]
            node.parts = [p for p in node.parts if isinstance(p, str) or p not in cut]
            left.append(node)
    _measure(left)
    return left


def _holding(nodes: list[Node]) -> set[Node]:
    """What is, or holds, an article, main or h1 with text."""
    out: set[Node] = set()
    for node in reversed(nodes):
        if node.name in ("article", "main", "h1") and node.chars or node in out:
            out |= {node, node.parent} - {None}
    return out


def _forms(nodes: list[Node]) -> set[Node]:
    """Forms, but for those that are wrappers: with an article, main or h1, or with paragraphs and half of the page's text."""
    holds, wrapped = _holding(nodes), set()
    for node in nodes:
        if node.name == "p" and node.chars:
            x = node.parent
            while x is not None and x not in wrapped:
                wrapped.add(x)
                x = x.parent
    return {x for x in nodes if x.name == "form" and x not in holds and not (x in wrapped and 2 * x.chars >= nodes[0].chars)}


def _beside(nodes: list[Node]) -> set[Node]:
    """What goes by its name: elements without an article, main or h1."""
    root, holds = nodes[0], _holding(nodes)
    # the outer ones of what may be cut
    outer, stack = [], [root]
    while stack:
        x = stack.pop()
        if x.hint == 2 and x not in holds:
            outer.append(x)
        else:
            stack.extend(x.kids)
    named = any(x.name in ("article", "main") for x in nodes if x in holds)
    if sum(x.chars for x in outer) < root.chars * (0.9 if named else 0.5):
        return set(outer)
    body = next((x for x in nodes if x.name == "body"), root)
    cut, stack = set(), outer
    while stack:
        x = stack.pop()
        if x.hint == 2 and x.density < body.density:
            cut.add(x)
        else:
            stack.extend(x.kids)
    return cut


def _marked(nodes: list[Node]) -> Node:
    best = max(nodes[1:], key=lambda x: x.total, default=nodes[0])
    return best if best.total else nodes[0]


def article(page: str | None) -> str:
    """The main text of a page."""
    nodes = parse(page or "")
    _measure(nodes)
    nodes = _without(nodes, _forms(nodes))
    nodes = _without(nodes, _beside(nodes))
    best = _marked(nodes)
    named = _inside(best, ("article", "main"))
    path = set()
    x = best
    while x is not None:
        path.add(x)
        x = x.parent
    holds, region = _holding(nodes), _below(nodes, named or best)
    linked = lambda x: x.chars and 2 * x.links >= x.chars
    cut = {x for x in nodes if x not in path and (x.hint == 2 and x in holds or x.hint == 1 and (linked(x) or x not in region))}
    if named:  # menus inside it: of three links and more, and little else
        cut |= {x for x in region - path if x.link_tags > 2 and linked(x) and x.name not in INLINE}
    nodes = _without(nodes, cut)
    root, best = nodes[0], _marked(nodes)
    if not root.chars:
        return ""
    path = [best]
    while path[-1].name != "body" and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    stack = [path[-1]]
    while stack:
        x = stack.pop()
        if x.keep or x.density < threshold or not x.chars:
            continue
        x.top.keep = True
        stack.extend(x.kids)
    for x in path[1:]:
        for kid in x.kids:
            kid.keep = kid.keep or kid.name == "h1"
    named = _inside(best, ("article", "main"))
    if named:
        named.keep = True
        for x in nodes:
            x.keep = x.keep or x.name == "article" and 2 * x.links < x.chars
    out: list[str] = []
    _text(root, False, out)
    return " ".join("".join(out).split())


def _text(root: Node, keep: bool, out: list[str]) -> None:
    stack: list[tuple[object, bool]] = [(root, keep)]
    while stack:
        x, k = stack.pop()
        if isinstance(x, str):
            if k:
                out.append(x)
            continue
        k = k or x.keep
        gap = x.name not in INLINE
        if gap:
            out.append(" ")
            stack.append((" ", True))
        stack.extend((p, k) for p in reversed(x.parts))


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text and n_chars."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [article(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(made, "page_id long, url string, text string, n_chars long")
