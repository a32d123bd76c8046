"""Main text of web pages by scoring the document tree.

A page becomes a tree of elements. Every paragraph gives points for its length
and its commas to its ancestors, less at each step up; a container's points are
discounted by the share of its text that is in links. The best container is
kept, with those siblings whose own score is near its score; from what is kept,
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are left out. An element that only its class or id names as one
of these stays if it holds most of the page's points outside of such tags and
few links, and an h1, or nearly all points of a page that has no article or h1
elsewhere, as an article's container of class "post-search" does. Pages are handled
one by one where they lie, in time proportional to their length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML and of common page markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup: it goes up to their closing tag, or to the end of the page as in browsers.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements whose content isn't main text. They are parsed, and left out if they are closed; what follows an unclosed one stays. FOREIGN ones and those inside them may close themselves.
HIDDEN = frozenset("noscript template svg canvas object audio video select datalist annotation annotation-xml".split())
FOREIGN = frozenset("svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover semantics q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split()) | HIDDEN
BOILER_TAGS = frozenset("nav header footer aside form fieldset button menu dialog head".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar side aside rail widget footer header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist reply replies disqus "
    "discussion responses pagination pager skip hidden form search legal copyright disclaimer".split()
)
#: A paragraph closes when one of these opens.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

#: A piece of markup: a comment, declaration or tag, quoted attribute values whole.
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")

#: Points of a paragraph: one, one a comma, and one for so many characters up to the most.
CHARS_A_POINT, MOST_POINTS, LEAST_CHARS = 100, 3, 25
#: A container stays, whatever its class, that has this share of all paragraphs' points and an h1, or this share of a page without h1 and article elsewhere, and at most this density of links.
MAIN_SHARE, ALONE_SHARE, MAIN_LINKS = 0.5, 0.9, 0.3
#: Words for readers' comments, whose containers need an h1 to stay.
COMMENT_WORDS = re.compile("comment|repl(?:y|ies)|disqus|discussion|response", re.I)
#: Siblings stay that have this share of the best container's score.
SIBLING_SHARE = 0.2


class Node:
    __slots__ = ("tag", "boiler", "named", "parent", "kids", "score", "chars", "linked", "points", "heads", "inside", "foreign")

    def __init__(self, tag: str, parent: Node | None, boiler: bool, named: str = ""):
        self.tag, self.parent, self.boiler, self.named = tag, parent, boiler, named
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        self.foreign = tag in FOREIGN or (parent is not None and parent.foreign)
        self.kids: list[Node | str] = []
        self.score = self.points = 0.0
        self.chars = self.linked = self.heads = 0


def _is_boiler(tag: str, attributes: str, in_article: bool) -> tuple[bool, str]:
    """Whether an element isn't main text, and its class or id if only these say so."""
    if tag in BOILER_TAGS:
        return not (tag == "header" and in_article), ""
    if not attributes or attributes.isspace():
        return False, ""
    named = ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True, ""
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, ""
        if name == "role" and value.lower() in BOILER_ROLES:
            return True, ""
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            for word in value.split():
                parts = [p.lower() for p in _WORD.findall(word)]
                if parts and (parts[0] in BOILER_WORDS or parts[-1] in BOILER_WORDS):
                    named += f" {word}"
    return named != "", named


def parse(source: str) -> Node:
    """The page's tree; unclosed and misplaced tags are mended as browsers do, in the main."""
    root = Node("#root", None, False)
    top, at, n = root, 0, len(source)
    opened: list[Node] = []
    count: Counter[str] = Counter()  # of opened, by tag

    def close(k: int) -> None:
        count.subtract(x.tag for x in opened[k:])
        del opened[k:]

    while at < n:
        lt = source.find("<", at)
        m = _MARKUP.match(source, lt) if lt >= 0 else None
        while lt >= 0 and m is None:  # a bare "<" is text
            lt = source.find("<", lt + 1)
            m = _MARKUP.match(source, lt) if lt >= 0 else None
        if m is None:
            top.kids.append(source[at:])
            break
        if lt > at:
            top.kids.append(source[at:lt])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for k in range(len(opened) - 1, -1, -1) if count[tag] > 0 else ():
                if opened[k].tag == tag:
                    opened[k].boiler |= tag in HIDDEN
                    close(k)
                    break
                if opened[k].tag in ("article", "section", "div", "main", "body", "table") and tag in INLINE | {"p"}:
                    break
            top = opened[-1] if opened else root
            continue
        attributes = m[3] or m[6] or ""
        if attributes.endswith("/") and (tag in FOREIGN or (opened[-1] if opened else root).foreign):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            if tag == "xmp":  # shown as it stands
                top.kids.append(html.escape(f" {source[at : end.start() if end else n]} "))
            at = end.end() if end else n
            continue
        if tag in ("br", "hr", "wbr"):
            top.kids.append(" " if tag != "wbr" else "")
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            for k in range(len(opened) - 1, -1, -1):
                if opened[k].tag == "p":
                    close(k)
                    break
                if opened[k].tag not in INLINE or opened[k].tag in HIDDEN:
                    break
        if tag in CLOSES_SAME and any(count[t] > 0 for t in CLOSES_SAME[tag]):
            for k in range(len(opened) - 1, -1, -1):
                if opened[k].tag in CLOSES_SAME[tag]:
                    close(k)
                    break
                if opened[k].tag in SCOPES[tag]:
                    break
        top = opened[-1] if opened else root
        if tag in INLINE and tag not in ("a", *HIDDEN, *FOREIGN) and not attributes:
            continue  # such elements change neither blocks nor links
        node = Node(tag, top, *_is_boiler(tag, attributes, top.inside))
        top.kids.append(node)
        opened.append(node)
        count[tag] += 1
        top = node
    return root


def _walk(root: Node) -> list[Node]:
    """All elements, parents first."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        found.append(node)
        todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    return found


def _blocks(node: Node) -> list[str]:
    """The texts of the blocks below, in page order, without what isn't main text."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    todo: list = [(node, False)]
    while todo:
        item, ends = todo.pop()
        if ends:
            close()
        elif isinstance(item, str):
            run.append(item)
        elif item.boiler and item is not node:
            if item.tag not in INLINE:
                close()
        else:
            block = item.tag not in INLINE
            if block:
                close()
                todo.append((item, True))
            todo.extend((k, False) for k in reversed(item.kids))
    close()
    return out


def _points(node: Node, own: str) -> float:
    """A paragraph's points, and 0.1 of headings and short ones."""
    n = len(own.strip())
    if node.tag not in ("p", "pre", "td", "blockquote", "li", "dd", "h1", "h2", "h3") and (node.tag in INLINE or n < LEAST_CHARS):
        return 0.0
    if node.chars < LEAST_CHARS or node.tag in ("h1", "h2", "h3"):
        return 0.1
    return 1 + own.count(",") + min(node.chars / CHARS_A_POINT, MOST_POINTS)


def _measure(nodes: list[Node], outside: set[int]) -> float:
    """Characters, linked characters and points of all elements but those ``outside``; the points of the page.

    ``nodes`` has parents first. A parent gets the whole of a paragraph's
    points, its parent the half, and each one above two thirds of the last, so
    all that goes up can be summed on the way: ``whole`` is new to the next
    container, ``fading`` was counted before.
    """
    whole: dict[int, float] = {}
    fading: dict[int, float] = {}
    total = 0.0
    for node in reversed(nodes):
        if id(node) in outside:
            continue
        own = "".join(k for k in node.kids if isinstance(k, str))
        node.chars += len(own.strip())
        if node.tag == "a":
            node.linked = node.chars
        node.heads += node.tag in ("h1", "main")
        points = _points(node, own)
        total += points
        node.points += points
        new, old = whole.pop(id(node), 0.0), fading.pop(id(node), 0.0)
        if node.tag not in INLINE:
            node.score += new + old
            new, old = 0.0, new * 0.5 + old * 2 / 3
        if points and node.tag not in ("p", "h1", "h2", "h3", "li", "dd"):
            node.score += points
        new += points
        if node.parent is not None:
            up = id(node.parent)
            whole[up], fading[up] = whole.get(up, 0.0) + new, fading.get(up, 0.0) + old
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            node.parent.points += node.points
            node.parent.heads += node.heads
    return total


def _outside(nodes: list[Node], at: str) -> set[int]:
    """Elements that are no main text or lie in such; with ``at`` "fixed" only those that not just a class or id says so of, with "boiler" all."""
    found: set[int] = set()
    for node in nodes:
        if (node.boiler and not (at == "fixed" and node.named)) or (node.parent is not None and id(node.parent) in found):
            found.add(id(node))
    return found


def _clear_main(nodes: list[Node]) -> None:
    """Elements that only a class or id names as no main text stay if they have most of the points and few links."""
    if not any(n.named for n in nodes):
        return
    outside = _outside(nodes, "fixed")
    total = _measure(nodes, outside)
    named = _outside(nodes, "boiler")
    other = any(n.tag in ("article", "main", "h1") and id(n) not in named for n in nodes)
    for node in nodes:
        least = MAIN_SHARE if node.heads else 2.0 if other or COMMENT_WORDS.search(node.named) else ALONE_SHARE
        if node.named and node.points >= least * total > 0 and node.linked <= MAIN_LINKS * node.chars:
            node.boiler = False
    for node in nodes:
        node.score = node.points = 0.0
        node.chars = node.linked = node.heads = 0


def _value(node: Node) -> float:
    """Points, discounted by the density of links."""
    return node.score * (1 - node.linked / node.chars) if node.chars else 0.0


def main_text(source: str | None) -> str:
    """The page's main text; empty if there is none."""
    if not source:
        return ""
    root = parse(source)
    nodes = _walk(root)
    _clear_main(nodes)
    dropped = _outside(nodes, "boiler")
    _measure(nodes, dropped)
    best, most = None, 0.0
    for node in nodes:
        if id(node) in dropped:
            continue
        if node.tag not in INLINE and node.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "#root", "html") and _value(node) > most:
            best, most = node, _value(node)
    if best is None:
        return " ".join(_blocks(root))
    while best.parent is not None and best.parent.tag in ("article", "main") and not best.parent.boiler:
        best = best.parent
    if best.tag in ("article", "main", "body", "html") or best.parent is None:
        return " ".join(_blocks(best))
    keep: list[str] = []
    loose: list[str | Node] = []
    for kid in best.parent.kids:
        stays = kid is best
        if isinstance(kid, Node) and not stays and not kid.boiler:
            density = kid.linked / kid.chars if kid.chars else 1.0
            heading = re.fullmatch("h[1-6]", kid.tag) is not None
            stays = _value(kid) >= SIBLING_SHARE * most or heading or (kid.tag in ("p", "blockquote", "pre") and density < 0.25 and kid.chars > 0)
        if stays:
            loose.append(kid)
    for kid in loose:
        keep += _blocks(kid)
    return " ".join(keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*batch.schema.names[1:], "text", "n_chars"])


def extract_pages(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep`` of ``pages`` with the main text and its count of code points.

    A null or empty page has an empty text; repeated rows are extracted each;
    an empty table gives no rows.
    """
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep), "text string, n_chars long"])
    return pages.select(F.col("html").alias("_html"), *keep).mapInArrow(_extract, schema)
