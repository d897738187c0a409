"""Main text of web pages by scoring the element tree.

A page becomes a tree of elements and text blocks.  Each paragraph gives points for its length and
its commas to its ancestors, the full number to its parent, half to the next and less further up;
an element's points are discounted by the share of its text that is in links.  The best element
is the container; siblings that score well, or are paragraphs of prose, are kept with it.

Left out with all below them: scripts, styles, navigation, headers and footers of pages, asides,
forms, and elements whose class, id or role names such a part; outside articles also list-like blocks
made of links.

Defined results: a null page, or one without any text block, gives an empty text; unclosed and
stray tags close as in browsers (a block ends an open paragraph, an end tag closes up to its start
tag or is ignored); an unfinished page ends where it ends; repeated rows give equal rows.
The work on a page is linear in its length: each byte is looked at a fixed number of times.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from veilspan.llm.common import map_batches, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes template".split())
SKIPPED = RAW | frozenset("head nav header footer aside form button select option svg canvas object dialog menu figcaption label fieldset".split())
#: What may stand in a head; anything else ends it, also without an end tag.
IN_HEAD = frozenset("title base link meta script style noscript template".split())
BLOCKS = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "blockquote pre figure figcaption address details summary center hr nav header footer aside form fieldset dialog menu".split()
)
#: An opening tag ends these open elements first, up to the nearest element of the second set.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Parts of class and id names that say what is not the article.
UNLIKELY = frozenset(
    "ad ads adslot adunit banner breadcrumb breadcrumbs comment comments commenter commentlist consent cookie cookies copyright feedback "
    "footer gdpr header masthead menu menubar modal nav navbar navi navigation newsletter notice notices notification "
    "notifications overlay pager pagination paging popup promo promotion recommendation recommendations recommended related replies reply respond "
    "share sharing sidebar signup social subscribe subscription toolbar topbar widget widgets".split()
)
UNLIKELY_BEGINNINGS = ("advert", "sponsor")
LIKELY = frozenset("article body content entry main page post story text".split())
#: A name with one of these tells of the page's state ("has-sidebar", "comments-open"), not of the element's kind.
STATES = frozenset("has with no without is enabled disabled open closed free on off".split())
#: "entry-header" holds the heading of the article, "page-header" that of the site.
HEADED = frozenset("article entry post story".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>\x00]*")
#: One attribute after another: its whole name and its value.
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in RAW}
_SPACE = re.compile(r"\s+")
BONUS = {"article": 30.0, "main": 25.0, "section": 3.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "body": 0.0, "html": -5.0, "ul": -3.0, "ol": -3.0, "li": -3.0}


class Node:
    __slots__ = ("tag", "parent", "skip", "bonus", "kids", "points", "length", "linked", "order")

    def __init__(self, tag: str, parent: Node | None, skip: bool = False, bonus: float = 0.0) -> None:
        self.tag, self.parent, self.skip, self.bonus = tag, parent, skip, bonus
        self.kids: list[Node | Block] = []
        self.points = 0.0
        self.length = self.linked = 0


class Block:
    __slots__ = ("text", "linked")

    def __init__(self, text: str, linked: int) -> None:
        self.text, self.linked = text, linked


def _tag_end(page: str, at: int) -> int:
    """Index after the tag that starts at '<', minding quoted attribute values; the page's end if it is open."""
    end = page.find(">", at)
    if end < 0:
        return len(page)
    if "=" in page[at:end] and ('"' in page[at:end] or "'" in page[at:end]):
        i = at
        while True:
            equal = page.find("=", i, end)
            if equal < 0:
                break
            j = equal + 1
            while j < len(page) and page[j] in " \t\n\r\f":
                j += 1
            if j < len(page) and page[j] in "\"'":
                close = page.find(page[j], j + 1)
                if close < 0:
                    return end + 1
                if close > end:
                    end = page.find(">", close)
                    if end < 0:
                        return len(page)
                i = close + 1
            else:
                i = j
    return end + 1


@lru_cache(maxsize=4096)
def _kind(names: str) -> tuple[bool, bool]:
    """(names a part that is not the article, names the article) of the values of class and id.

    Inside one name the unlikely part wins ("comment-body", "main-nav").
    """
    unlikely = likely = False
    for name in names.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        known = set(parts)
        against = [p for p in parts if p in UNLIKELY or p.startswith(UNLIKELY_BEGINNINGS)]
        if against == ["header"] and known & HEADED:
            against = []
        if against and not known & STATES:
            unlikely = True
        elif not against and known & LIKELY:
            likely = True
    return unlikely, likely


class _Builder:
    """Open elements, and where in the stack those of each tag and the blocks are, so no step walks it."""

    def __init__(self) -> None:
        self.root = Node("html", None)
        self.open = [self.root]
        self.at: dict[str, list[int]] = {"html": [0]}
        self.blocks = [0]
        self.text: list[str] = []
        self.links: list[str] = []

    def holder(self) -> Node:
        """The innermost open block."""
        return self.open[self.blocks[-1]]

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            linked = len(_SPACE.sub(" ", "".join(self.links)).strip())
            self.holder().kids.append(Block(text, min(linked, len(text))))
        self.text.clear()
        self.links.clear()

    def close(self, index: int) -> None:
        """Close the open elements from index on."""
        if self.blocks[-1] >= index:
            self.flush()
        while len(self.open) > index:
            self.at[self.open.pop().tag].pop()
        while self.blocks[-1] >= index:
            self.blocks.pop()

    def last(self, tags) -> int:
        """Place of the innermost open element of some tags; 0 without any."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def find(self, tags, stop) -> int | None:
        """Place of the outermost open element of the tags inside the innermost of the stops."""
        inside = self.last(stop)
        found = [places[k] for t in tags if (places := self.at.get(t)) and (k := bisect_right(places, inside)) < len(places)]
        return min(found, default=None)

    def start(self, tag: str, attributes: str) -> None:
        if self.at.get("head") and tag not in IN_HEAD:
            self.close(self.at["head"][-1])
        if tag in BLOCKS:
            self.flush()
            at = self.find(("p",), _P_STOPS)
            if at is not None:
                self.close(at)
        if tag in IMPLIED:
            at = self.find(*IMPLIED[tag])
            if at is not None:
                self.close(at)
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        if tag == "a" and self.at.get("a"):
            at = self.find(("a",), BLOCKS)
            if at is not None:
                self.close(at)
        if tag in ("html", "body") and any(n.tag == tag for n in self.open[: 2 + (tag == "body")]):
            return
        labels: dict[str, str] = {}
        for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
            labels.setdefault(name.lower(), value[1:-1] if value[:1] in ('"', "'") else value)
        unlikely, likely = _kind(f"{labels.get('class', '')} {labels.get('id', '')}")
        skip = (
            tag in SKIPPED
            or labels.get("role", "").strip().lower() in ROLES
            or "hidden" in labels
            or labels.get("aria-hidden", "").strip().lower() == "true"
            or (unlikely and tag not in ("html", "body", "article", "main"))
        )
        if tag in ("header", "figcaption") and (self.at.get("article") or self.at.get("main")):
            skip = "hidden" in labels  # the heading of an article
        node = Node(tag, self.open[-1], skip or self.open[-1].skip, BONUS.get(tag, 0.0) + 25.0 * likely)
        if tag in BLOCKS:
            node.parent = self.holder()
            node.parent.kids.append(node)
            self.blocks.append(len(self.open))
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(node)

    def end(self, tag: str) -> None:
        if self.last((tag,)):
            self.close(self.at[tag][-1])

    def add(self, text: str) -> None:
        if self.open[-1].skip:
            return
        self.text.append(text)
        if self.at.get("a"):
            self.links.append(text)


_P_STOPS = ("td", "th", "table", "button", "article", "section", "div", "li", "body")


def parse(page: str) -> Node:
    """The tree of the blocks that may be main text."""
    tree, at = _Builder(), 0
    while at < len(page):
        next_tag = page.find("<", at)
        if next_tag < 0:
            next_tag = len(page)
        if next_tag > at:
            tree.add(entities.unescape(page[at:next_tag]))
        if next_tag == len(page):
            break
        two = page[next_tag + 1 : next_tag + 2]
        if two == "!" or two == "?":
            if page.startswith("<!--", next_tag):
                end = page.find("-->", next_tag + 4)
                if page.startswith(("<!-->", "<!--->"), next_tag):
                    end = page.find(">", next_tag) - 2
                at = len(page) if end < 0 else end + 3
            else:
                end = page.find(">", next_tag)
                at = len(page) if end < 0 else end + 1
            continue
        closing = two == "/"
        name = _NAME.match(page, next_tag + 1 + closing)
        if not name:
            if closing:
                end = page.find(">", next_tag)
                at = len(page) if end < 0 else end + 1
            else:
                tree.add("<")
                at = next_tag + 1
            continue
        tag, end = name[0].lower(), _tag_end(page, next_tag)
        if closing:
            if tag == "br":
                tree.start("br", "")
            tree.end(tag)
            at = end
            continue
        tree.start(tag, page[name.end() : end - 1])
        at = end
        if tag in RAW:
            stop = _RAW_END[tag].search(page, at)
            at = _tag_end(page, stop.start()) if stop else len(page)
            tree.end(tag)
    tree.flush()
    return tree.root


def _weigh(root: Node) -> list[Node]:
    """Fill in lengths and points of all elements; in page order."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.skip:
            continue
        nodes.append(node)
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    for node in nodes:
        own = [k for k in node.kids if isinstance(k, Block)]
        node.length += sum(len(b.text) for b in own)
        node.linked += sum(b.linked for b in own)
        for b in own:
            points = 1 + b.text.count(",") + b.text.count("、") + min(len(b.text) / 100, 3.0)
            points *= 1 - b.linked / len(b.text)
            if node.tag not in ("p", "pre", "blockquote", "td", "li", "dd") and not node.tag.startswith("h"):
                node.points += points  # text directly in a container
            holder, level = node.parent, 0
            while holder is not None and level < 5:
                holder.points += points if level == 0 else points / 2 if level == 1 else points / (level * 3)
                holder, level = holder.parent, level + 1
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.linked += node.linked
    return nodes


def _value(node: Node) -> float:
    return (node.points + node.bonus) * (1 - node.linked / node.length) if node.length else float("-inf")


def _blocks(node: Node, out: list[str], in_article: bool) -> None:
    """All kept blocks below a node, in page order; lists made of links only where they are part of an article."""
    stack: list[tuple[Node | Block, bool]] = [(node, in_article)]
    while stack:
        item, inside = stack.pop()
        if isinstance(item, Block):
            out.append(item.text)
        elif not item.skip:
            inside = inside or item.tag in ("article", "main")
            made_of_links = item.tag in ("ul", "ol", "div", "table", "section", "dl") and item.length and item.linked > 0.6 * item.length
            if item is node or inside or not made_of_links:
                stack.extend((k, inside) for k in reversed(item.kids))


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    nodes = _weigh(root)
    containers = [n for n in nodes if n.length and n.tag not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "tr")] or [
        n for n in nodes if n.length
    ]
    if not containers:
        return ""
    best = max(containers, key=_value)  # the first of equals
    holder = best.parent
    while holder is not None:  # part of an article: all of it
        if holder.tag in ("article", "main") and not holder.skip:
            best = holder
        holder = holder.parent
    blocks: list[str] = []
    article = best.tag in ("article", "main")
    if best.parent is None:
        _blocks(best, blocks, article)
    else:
        least = max(10.0, 0.2 * _value(best))
        for kid in best.parent.kids:
            if kid is best:
                _blocks(kid, blocks, article)
            elif isinstance(kid, Block):
                if not article and len(kid.text) > 80 and kid.linked < 0.25 * len(kid.text):
                    blocks.append(kid.text)
            elif kid.length and not kid.skip:
                density = kid.linked / kid.length
                prose = kid.tag == "p" and kid.length > 80 and density < 0.25
                if prose or (kid.tag not in ("p",) and _value(kid) - 0.5 * kid.bonus >= least and density < 0.5):
                    _blocks(kid, blocks, kid.tag in ("article", "main"))
    return "\n\n".join(blocks)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add text and n_chars (its code points) to every row; the html column is replaced by them."""
    others = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*others).schema)

    def run(batch):
        source = batch.column(html)
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            texts = [main_text(x.as_py()) for x in source.slice(first, 256)]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in others), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*others, "text", "n_chars"],
            )

    return map_batches(pages.select(*others, html), run, f"{kept}text string, n_chars bigint")


def op7_tree_scoring(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
