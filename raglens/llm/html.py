"""Main text of HTML pages by composite text density.

A page is parsed into a tree. For every node the density of characters per tag is adjusted by
its share of link text; a node's density sum is that of its children, a run of text counting
as a child of one tag. The node of the largest sum is taken, or the article or main element
that it lies in, and with it all siblings on the way up to the body, of any tag and whole, that reach the least density of that way; a heading
goes with the node that follows it. Their blocks, in page order, are the text.

Before that, scripts, styles and the like are cut, and subtrees whose element or whole class,
id or role names a part of a page that isn't its article (menus, headers, footers, sidebars,
notices, adverts, forms, reader comments). A name alone never decides over the page's main
part: a subtree stays that holds the page's article, main element or first heading, or, where
no such element is outside of it, half of the page's characters that aren't links.

Defined results: a null, empty or tag-only page has the empty text. Markup is never dropped
for size. Unclosed and cut-off tags end with the page. An attribute's quote that nothing closes
is an ordinary character, and its tag ends at the next >; once a page has had eight times its
length read for such quotes, all further tags end there. End tags that close nothing are left
out. Time is linear in the page. Of equal sums the outer node is taken."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=(?!\s*[\"']))*+)(?:>|\Z)", re.S)
#: A tag whose quotes don't count: it ends at the first >.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
#: Characters read in vain for a closing quote, in page lengths, before tags are plain.
IN_VAIN = 8
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
#: Fixed sets of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
CUT = frozenset("script style head title noscript template iframe object svg canvas button select textarea".split())
#: Elements that are cut unless they hold the page's main part.
ASIDE = frozenset("nav footer aside form menu dialog header".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Names of class, id and role that mark boilerplate, alone or with words that say which of it.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar rail menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup share sharing social related "
    "recommended recommendations comment comments disqus discussion replies respond search login widget pagination pager copyright contentinfo complementary".split()
)
WHICH = frozenset(
    "site page main global top bottom left right side primary secondary section area box list item items wrapper wrap container block bar inner outer link links button buttons "
    "posts articles form field row col column group unit slot label text message content panel footer header a b c 1 2 3 4 5".split()
)


class Node:
    __slots__ = ("kids", "parent", "tag", "block", "cut", "aside", "chars", "tags", "link_chars", "link_tags", "heads", "density", "sum")

    def __init__(self, tag: str, parent: Node | None, cut: bool, aside: bool = False) -> None:
        self.tag, self.parent, self.cut, self.aside, self.kids = tag, parent, cut, aside, []
        self.block = parent.block if parent is not None and tag in INLINE else self  # the nearest node that isn't inline


def _named(name: str) -> bool:
    parts = [x for x in re.split(r"[-_]+", name) if x]
    return name in BOILERPLATE or (not BOILERPLATE.isdisjoint(parts) and all(x in BOILERPLATE or x in WHICH for x in parts))


def _marked(tag: str, attributes: str, inside_main: bool) -> tuple[bool, bool]:
    """Whether a node is cut for certain, and whether its element or names mark it."""
    if tag in CUT:
        return True, True
    aside = tag in ASIDE and not (tag == "header" and inside_main)
    if not attributes or tag in ("body", "html", "article", "main"):
        return False, aside
    for m in ATTRIBUTE.finditer(attributes):
        name = (m[1] or m[5]).lower()
        if name == "hidden":
            return True, True
        if name in ("class", "id", "role") and any(map(_named, unescape(m[2] or m[3] or m[4] or "").lower().split())):
            aside = True
    return False, aside


def parse(html: str) -> Node:
    """The tree of a page. Text nodes are strings among the kids."""
    root = at = Node("html", None, False)
    pos, n = 0, len(html)
    in_main, vain = 0, 0
    open_: Counter[str] = Counter()  # tags from the root to `at`

    def up_to(x: Node) -> Node:
        """Closes all from `at` to x; the node that is open then."""
        nonlocal in_main
        here = at
        while True:
            in_main -= here.tag in MAIN
            open_[here.tag] -= 1
            if here is x:
                return here.parent
            here = here.parent

    while pos < n:
        lt = html.find("<", pos)
        if lt < 0:
            at.kids.append(html[pos:])
            break
        m = TOKEN.match(html, lt) if vain <= IN_VAIN * n or html.startswith(("<!", "<?"), lt) else None
        if m is None:
            m = PLAIN_TAG.match(html, lt)
            vain += n - lt if m is not None and vain <= IN_VAIN * n else 0
        if m is None:  # a lone < is text
            at.kids.append(html[pos : lt + 1])
            pos = lt + 1
            continue
        if lt > pos:
            at.kids.append(html[pos:lt])
        pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_[tag] > 0:
                x = at
                while x.tag != tag:
                    x = x.parent
                at = up_to(x)
            continue
        if tag in ("html", "body") and at is root:
            continue
        if (tag in CLOSES_P or tag == "li") and at.block is not root:
            if at.block.tag == "p" or at.block.tag == tag == "li":
                at = up_to(at.block)
        node = Node(tag, at, *_marked(tag, m[3], in_main > 0))
        at.kids.append(node)
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(html, pos)
            node.kids.append(html[pos : end.start()] if end else html[pos:])
            pos = end.end() if end else n
            continue
        in_main += tag in MAIN
        open_[tag] += 1
        at = node
    return root


def _order(root: Node) -> list[Node]:
    """All nodes that aren't cut, parents first."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack += [k for k in reversed(x.kids) if not isinstance(k, str) and not k.cut]
    return out


def _count(nodes: list[Node]) -> None:
    """Characters, tags and those of links of every node; nodes come parents first."""
    for x in reversed(nodes):
        x.chars = sum(len("".join(k.split())) for k in x.kids if isinstance(k, str))
        x.tags = x.link_chars = x.link_tags = 0
        x.heads = x.tag in MAIN or x.tag == "h1"
        for k in x.kids:
            if not isinstance(k, str) and not k.cut:
                x.chars += k.chars
                x.tags += k.tags + 1
                x.link_chars += k.link_chars
                x.link_tags += k.link_tags + (k.tag == "a")
                x.heads += k.heads
        if x.tag == "a":
            x.link_chars = x.chars


def cut_asides(root: Node) -> None:
    """Cuts the marked subtrees that don't hold the page's main part."""
    nodes = _order(root)
    _count(nodes)
    plain = root.chars - root.link_chars
    heads = root.heads
    for x in nodes:
        if x.aside and not x.heads:
            x.cut = heads > 0 or 2 * (x.chars - x.link_chars) < plain or 2 * x.link_chars > x.chars
        elif x.aside:
            # it holds a heading or article: the page's main part unless others hold more of it
            x.cut = x.heads < heads and 2 * (x.chars - x.link_chars) < plain


def _density(chars: int, tags: int, link_chars: int, link_tags: int, whole: float) -> float:
    c, t, lc, lt = chars, max(1, tags), max(1, link_chars), max(1, link_tags)
    if not c:
        return 0.0
    base = math.log(c / max(1, c - link_chars) * lc + whole * c + math.e)
    return c / t * math.log(max(1.0, c / lc * (t / lt)), max(1.0001, base))


def densities(root: Node) -> list[Node]:
    """Densities, and sums of the children's densities, of all nodes that aren't cut."""
    nodes = _order(root)
    _count(nodes)
    whole = root.link_chars / max(1, root.chars)
    for x in nodes:
        x.density = _density(x.chars, x.tags, x.link_chars, x.link_tags, whole)
    for x in nodes:
        x.sum = 0.0
        for k in x.kids:
            if isinstance(k, str):
                x.sum += _density(len("".join(k.split())), 1, 0, 0, whole)
            elif not k.cut:
                x.sum += k.density
    return nodes


def main_nodes(root: Node) -> list[Node]:
    """The chosen subtrees, in page order."""
    cut_asides(root)
    nodes = densities(root)
    best = max(nodes, key=lambda x: x.sum)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min((x.density for x in path[:-1]), default=0.0)
    for x in path:  # what the sum chose inside of an article or main element stands for all of it
        if x.tag in MAIN:
            best = x
    kept = [best]
    x = best
    while x.parent is not None:
        kids = [k for k in x.parent.kids if not isinstance(k, str) and not k.cut]
        at = kids.index(x)
        take = [k is x or (k.density >= threshold and (k.tag in (x.tag, best.tag) or k.link_chars < k.chars)) for k in kids]
        for i in range(len(kids) - 2, -1, -1):  # a heading goes with what it heads
            take[i] = take[i] or (take[i + 1] and kids[i].tag in HEADINGS)
        kept = [k for k, t in zip(kids[:at], take) if t] + kept + [k for k, t in zip(kids[at + 1 :], take[at + 1 :]) if t]
        x = x.parent
    return kept


def _blocks(node: Node, out: list[str], held: list[str]) -> None:
    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                out.append(text)
        elif isinstance(x, str):
            held.append(x)
        elif x.cut and x is not node:
            if x.tag not in INLINE:
                stack.append(None)
        elif x.tag in INLINE:
            stack += reversed(x.kids)
        else:
            stack += [None, *reversed(x.kids), None]


def main_text(html: str | None) -> str:
    if not html or "<" not in html:
        return " ".join(unescape(html or "").split())
    out: list[str] = []
    held: list[str] = []
    for node in main_nodes(parse(html)):
        _blocks(node, out, held)
        if node.tag in INLINE:
            _blocks(Node("div", None, False), out, held)
    return "\n".join(out)


def extract(spark: SparkSession, html: str | Column = "html") -> Column:
    """A string column with the main text of an HTML column."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(main_text, na_action=None)

    return texts(F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit("")))
