"""Main text of web pages by composite text density."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is never text of the page.
DROPPED = frozenset("head script style noscript template iframe svg math button select textarea input title object embed canvas audio video".split())
#: Elements that mostly stand around a text: their characters count little, and so do those of all inside them.
AROUND = frozenset("nav header footer aside form menu dialog search".split())
#: What a character counts in a node whose name, class, id or role says that it stands around the text.
PRIOR = 0.02
#: Part of the chosen node's density sum at which a node beside or inside it counts as main text too.
SHARE = 0.25
#: Part of a node's characters in links at which it is a list of links.
LINKS = 0.8
#: Elements that may be main text without elements of their own.
TEXT = frozenset("blockquote dd dl dt h1 h2 h3 h4 h5 h6 li ol p pre table td th tr ul".split())
#: What the density of a lone box counts in its parent's sum: the only child of its name without blocks, and no element of TEXT.
LONE = 0.25
WHOLE = frozenset("html body main".split())
#: Open elements that a start tag ends, up to the element that holds them.
ENDED_BY = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
BOXES = "ad|ads|advert|advertisement|adverts|sponsor|sponsored|banner|breadcrumb|breadcrumbs|comment|comments|consent|cookie|cookies|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|pagination|popup|promo|related|share|sharing|sidebar|social|subscribe|toolbar|widget"
BOX = re.compile(rf"^(?:(?!(?:no|has|with|without)[-_])[a-z0-9]+[-_])?(?:{BOXES})(?:[-_](?:[0-9]+|area|bar|block|box|container|content|footer|header|inner|item|items|list|main|outer|row|section|thread|top|bottom|left|right|wrap|wrapper|banner|links|menu|media))*$")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Node:
    """An element: its parts are texts and nodes; chars, tags and those of links are sums over its subtree.

    around: it, or an element that holds it, stands around the text by its name; block:
    the nearest block element, itself included; inline: how many inline elements of each
    name are open in that block; bare: no block element is in it.
    """

    __slots__ = ("name", "parent", "parts", "dropped", "around", "block", "inline", "chars", "tags", "link_chars", "link_tags", "density", "sum", "bare", "blocks")

    def __init__(self, name: str, parent: Node | None, dropped: bool = False, around: bool = False):
        self.name, self.parent, self.parts, self.dropped = name, parent, [], dropped
        self.around = around or parent is not None and parent.around
        self.block = self if parent is None or name in BLOCK else parent.block
        self.inline: Counter[str] | None = Counter() if self.block is self else None
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.bare, self.blocks = True, 0

    def children(self) -> Iterator[Node]:
        return (p for p in self.parts if isinstance(p, Node) and not p.dropped)


def is_around(name: str, attributes: str) -> bool:
    """Whether an element's name, class, id or role says that it stands around the main text."""
    if name in AROUND:
        return True
    if name in WHOLE or not attributes:
        return False
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        values = (a or b or c).lower().split()
        if key.lower() == "role" and ROLES.intersection(values) or key.lower() != "role" and any(BOX.match(v) for v in values):
            return True
    return bool(re.search(r"\bhidden\b(?!\s*=)", re.sub(r"=\s*(?:\"[^\"]*\"|'[^']*')", "", attributes)))


def tag_end(html: str, start: int) -> int:
    """Place of the > that ends the tag at ``start``; -1 without one. A > inside a closed quote doesn't count."""
    end = html.find(">", start)
    quote = start
    while end >= 0:
        a, b = html.find('"', quote, end), html.find("'", quote, end)
        first = min((x for x in (a, b) if x >= 0), default=-1)
        if first < 0:
            return end
        if html[quote:first].rstrip()[-1:] != "=":
            quote = first + 1
            continue
        close = html.find(html[first], first + 1)
        if close < 0:
            return end
        quote = close + 1
        if close > end:
            end = html.find(">", close)
    return end


def parse(html: str) -> Node:
    """The tree of a page; wrong nesting is mended as browsers do for the common cases."""
    root = Node("#root", None)
    here, at, n = root, 0, len(html)
    text: list[str] = []
    open_blocks: Counter[str] = Counter()

    def leave(node: Node) -> None:
        """Closes all elements inside ``node``, which becomes the current one."""
        nonlocal here
        while here is not node:
            if here.block is here:
                open_blocks[here.name] -= 1
            else:
                here.block.inline[here.name] -= 1
            here = here.parent

    def flush() -> None:
        if text:
            here.parts.append("".join(text))
            text.clear()

    while at < n:
        lt = html.find("<", at)
        if lt < 0 or lt + 1 >= n:
            text.append(html[at:])
            break
        if lt > at:
            text.append(html[at:lt])
        nxt = html[lt + 1]
        if nxt == "!" or nxt == "?":
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        closing = nxt == "/"
        named = NAME.match(html, lt + 1 + closing)
        if not named:
            text.append("<")
            at = lt + 1
            continue
        end = tag_end(html, named.end())
        if end < 0:  # a tag cut off by the end of the page
            break
        name = named[0].lower()
        at = end + 1
        if closing:
            if (open_blocks if name in BLOCK else here.block.inline)[name] > 0:
                node = here
                while node.name != name or node.block is not node and name in BLOCK:
                    node = node.parent
                flush()
                leave(node.parent)
            continue
        flush()
        if name in BLOCK and here.block.name == "p":
            leave(here.block.parent)
        if name in ENDED_BY:
            ended, held = ENDED_BY[name]
            node = here.block
            while node is not root and node.name not in held:
                up = node.parent
                if node.name in ended:
                    leave(up)
                    if name != "tr":
                        break
                node = up.block
        if name in ("html", "body") and open_blocks[name] > 0:
            continue
        if name == "body":
            node = here.block
            while node is not root and node.name != "html":
                node = node.parent.block
            leave(node)
        attributes = html[named.end() : end]
        node = Node(name, here, name in DROPPED, is_around(name, attributes))
        here.parts.append(node)
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>]|$)", re.I).search(html, at)
            if close:
                at = html.find(">", close.end())
                at = n if at < 0 else at + 1
            else:
                at = n
        elif name not in VOID and not attributes.endswith("/"):
            here = node
            if node.block is node:
                open_blocks[name] += 1
            else:
                node.block.inline[name] += 1
    flush()
    return root


def in_order(root: Node) -> list[Node]:
    """The kept nodes, parents before children, in page order; no recursion, as pages may nest deeply."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += reversed(list(node.children()))
    return out


def measure(nodes: list[Node]) -> None:
    """Composite text density of each node and the sum of its children's: characters per tag, less where links hold many of them.

    A character of what stands around a text by its name counts PRIOR of one.
    """
    for node in reversed(nodes):
        node.chars += (PRIOR if node.around else 1) * sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        if node.name == "a":
            node.link_chars = node.chars
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags + (node.name == "a")
    whole = nodes[0]
    for node in reversed(nodes):
        c, t, lc, lt = max(node.chars, 1) if node.chars else 0, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if not c:
            continue
        plain = max(c - node.link_chars, 1)
        base = math.log(c * node.link_chars / plain + whole.link_chars * c / max(whole.chars, 1) + math.e)
        node.density = c / t * max(math.log(c / lc * t / lt), 0.0) / (max(math.log(base), 1e-3) if base > 1.0001 else 1.0)
        node.sum = node.sum or node.density
        if node.block is node and not node.bare:
            boxes = Counter(x.name for x in node.children() if x.block is x and x.bare)
            for x in node.children():
                if x.block is x and x.bare and x.name not in TEXT and boxes[x.name] == 1 and node.blocks > 1:
                    node.sum -= (1 - LONE) * x.density
        if node.parent is not None and node.block is node:
            up = node.parent.block
            up.sum += node.density
            up.blocks += 1
            up.bare = False


def is_main(node: Node, threshold: float, least: float) -> bool:
    """Whether a node beside the way to the chosen one is main text as well: as dense as the way, and not a box without blocks."""
    return node.density >= threshold > 0 and node.sum >= least and (node.name in TEXT or not node.bare)


def select(root: Node) -> list[Node]:
    """The nodes that hold the main text, in page order; what isn't text inside them is marked as dropped.

    The node whose children's densities have the greatest sum, and with it what stands
    beside it on the way up to the body, if it is at least as dense as the least dense node
    on that way and its sum is SHARE of the chosen one's. Where an article or main element
    with the same text differs in headings alone, that one is taken (a tie). Inside, what
    is named as standing around a text goes unless its sum is SHARE of the whole, and so
    do lists of links that are less dense than the threshold.
    """
    nodes = in_order(root)
    measure(nodes)
    inner = [x for x in nodes if x.block is x and x.name not in ("#root", "html")]
    best = max(inner or nodes[:1], key=lambda x: x.sum)
    if not any(x.name == "body" for x in inner) and nodes[0].sum > best.sum:  # a page without a body
        best = nodes[0]
    way = []
    node: Node | None = best
    while node is not None:
        way.append(node)
        node = node.parent
    body = [x for x in way if x.name not in ("#root", "html")] or way
    threshold = min(x.density for x in body)
    least = SHARE * best.sum
    holder = max((i for i, x in enumerate(way) if x.name in ("article", "main") and x.chars - best.chars < best.chars * SHARE), default=0)
    chosen = {id(way[holder])}
    for below, above in zip(way[holder:], way[holder + 1 :]):
        chosen |= {id(c) for c in above.children() if c is not below and is_main(c, threshold, least)}
    out = [x for x in nodes if id(x) in chosen]
    stack = list(out)
    while stack:
        for child in stack.pop().children():
            list_of_links = child.block is child and child.link_tags > 1 and child.link_chars >= LINKS * child.chars and child.density < threshold
            if child.around and not best.around and child.sum < least or list_of_links and child.sum < least:
                child.dropped = True
            else:
                stack.append(child)
    return out


def blocks(node: Node) -> Iterator[str]:
    """Texts of the blocks under a node, character references decoded, white space as one space."""
    held: list[str] = []
    stack: list = [iter([node])]
    ends: list[bool] = [False]

    def done() -> str:
        out = " ".join(unescape("".join(held)).split())
        held.clear()
        return out

    while stack:
        part = next(stack[-1], None)
        if part is None:
            stack.pop()
            if ends.pop() and (out := done()):
                yield out
        elif isinstance(part, str):
            held.append(part)
        elif not part.dropped:
            edge = part.name in BLOCK
            if edge and (out := done()):
                yield out
            if part.name == "br":
                held.append(" ")
            stack.append(iter(part.parts))
            ends.append(edge)
    if out := done():
        yield out


def main_text(html: str | None) -> str:
    return "\n".join(b for node in select(parse(html)) for b in blocks(node)) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html; others are ignored).

    Null or empty html, and pages without a main text, give an empty text. Whole pages are
    parsed; cut-off ones as far as they go. Repeated rows are parsed one by one; null ids
    and urls stay null. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
