"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_pieces

#: Fixed values of HTML: elements without end tag, with raw text, and those that end a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are never part of an article.
DROPPED = frozenset("script style title noscript iframe template svg math canvas object embed head nav footer aside form button select textarea input label dialog menu audio video noembed noframes".split())
#: Words of class, id and role that mark what is not part of an article.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs footer header masthead topbar sidebar aside widget complementary contentinfo cookie cookies consent notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist disqus respond reply replies discussion pagination pager skip toolbar search form".split())
#: Words that turn a mark into a remark on the layout, and marks that don't count inside an article.
NOT, HEADS = frozenset(("has", "with", "no", "without")), frozenset(("header", "masthead"))
#: Words that only say what kind of part a mark is on; with them a class or id still is a mark as a whole.
PARTS = frozenset("area bar block box btn button buttons col column container content count global group holder icon icons inner item items left link links list main mobile module outer page panel pane post posts primary right secondary section site slot sticky text title top bottom unit wrap wrapper".split())
#: Marks that an article's own sections may have for a name; in an article what they are on must agree.
NAMES = frozenset("alert alerts discussion form notice notices related recommended search".split())
#: Characters of a line from which it is prose, and of the mean item of a list of links that isn't a menu.
PROSE, ITEM = 80, 40
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"""["'>]""")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "up", "children", "score", "chars", "linked", "gone", "doubtful", "inside", "prose")

    def __init__(self, tag: str, up: Node | None, gone: bool, doubtful: int = 0):
        self.tag, self.up, self.gone, self.doubtful = tag, up, gone, doubtful
        self.inside = tag in ("article", "main") or (up is not None and up.inside)
        self.children: list = []  # nodes and lines of text, in page order
        self.score, self.chars, self.linked = 0.0, 0, 0
        self.prose = False  # whether it has a heading of its own or a line of prose


def _unwanted(tag: str, attributes: str, inside_article: bool) -> tuple[bool, int]:
    """Whether an element goes, and whether it goes if it has mostly links (1), or that or no prose (2).

    A class, id or role that is a mark as a whole drops its element; one that has a mark among other words may be
    the slug of a heading, so links must agree. In an article that also holds for marks in NAMES, which are its sections' names as well.
    """
    if tag in DROPPED or (tag == "header" and not inside_article):
        return True, 0
    if not attributes or not attributes.strip():
        return False, 0
    doubtful = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        value = value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return True, 0
        if name in ("class", "id", "role") and tag not in ("html", "body", "article", "main") and not (name == "id" and tag in HEADINGS):
            for part in value.lower().split():
                words = _WORD.findall(part)
                if NOT.isdisjoint(words) and any(w in MARKS and not (inside_article and w in HEADS) for w in words):
                    whole = all(w in MARKS or w in PARTS or len(w) == 1 for w in words)
                    named = inside_article and all(w in NAMES or w not in MARKS for w in words)
                    if whole and not named:
                        return True, 0
                    doubtful = max(doubtful, 2 if whole else 1)
        elif name in ("class", "id") and tag == "article" and any(w.startswith("comment") for w in _WORD.findall(value.lower())):
            return True, 0
    return False, doubtful


class Tags:
    """Where tags end. A tag ends at the first ``>`` outside of quotes; one that has none, or an open quote, is text.

    Failed searches are remembered by the quotes they opened: a later search that opens one of these goes the same way and
    fails too. So a page costs a few passes at most, whatever its stray signs.
    """

    def __init__(self, page: str):
        self.page, self.failed = page, set()
        self.last = {q: page.rfind(q) for q in "\"'>"}
        self.seen, self.stop = -1, -1  # the first sign in ``_STOP`` at or after ``seen``

    def _next(self, at: int) -> int:
        if not self.seen <= at <= self.stop:
            found = _STOP.search(self.page, at)
            self.seen, self.stop = at, found.start() if found else len(self.page)
        return self.stop

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose attributes begin at ``at``, or -1."""
        opened = []
        while at <= self.last[">"]:
            at = self._next(at) if not opened else (found.start() if (found := _STOP.search(self.page, at)) else len(self.page))
            if at == len(self.page) or at in self.failed:
                break
            if self.page[at] == ">":
                return at
            opened.append(at)
            if at >= self.last[self.page[at]]:
                break
            at = self.page.find(self.page[at], at + 1) + 1
        self.failed.update(opened)
        return -1


def tokens(page: str):
    """("text", text), or ("<" or "</", lower-cased name, attributes, place behind) of each tag; the reader may send a place to go on from."""
    tags, at, size = Tags(page), 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            mark = size
        if mark > at:
            yield "text", page[at:mark]
        if mark == size:
            return
        at = mark
        found = _COMMENT.match(page, at)
        if found:
            at = found.end()
            continue
        found = _TAG.match(page, at)
        end = tags.end(found.end()) if found else -1
        if end < 0:
            yield "text", "<"
            at += 1
            continue
        sent = yield "<" + found[1], found[2].lower(), page[found.end() : end], end + 1
        at = end + 1 if sent is None else sent


def parsed(page: str) -> Node:
    """The tree of block elements, with lines of text; inline elements only tell what is a link.

    Open elements are counted by name, so that depth and stray tags cost no search.
    """
    root = Node("html", None, False)
    here, inline, text = root, [], []
    linked = 0
    blocks, inlines = Counter(), Counter()

    def close(node: Node):
        """End open elements up to and with ``node``."""
        nonlocal here
        while here is not node.up:
            blocks[here.tag] -= 1
            here = here.up

    def end_line():
        nonlocal text, linked
        if text:
            line = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if line and not here.gone:
                here.children.append((line, min(linked, len(line))))
            text, linked = [], 0

    stream, sent = tokens(page), None
    while True:
        try:
            token = stream.send(sent)
        except StopIteration:
            break
        sent = None
        if token[0] == "text":
            text.append(token[1])
            if inlines["a"]:
                linked += len(token[1].strip())
            continue
        kind, tag, attributes, at = token
        if kind == "</":
            if tag in BLOCK:
                if blocks[tag]:
                    node = here
                    while node.tag != tag:
                        node = node.up
                    end_line()
                    close(node)
                    inline.clear()
                    inlines.clear()
                elif tag == "p":
                    end_line()
            elif inlines[tag]:
                while (last := inline.pop()) != tag:
                    inlines[last] -= 1
                inlines[tag] -= 1
            elif here is not root and here.tag == tag:  # a dropped element that is not a block
                end_line()
                close(here)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            sent = end.end() if end else len(page)
            continue
        if tag in VOID:
            if tag == "hr":
                end_line()
            continue
        gone, doubtful = (True, 0) if here.gone else _unwanted(tag, attributes, here.inside)
        if tag in BLOCK or (gone and not here.gone and not attributes.rstrip().endswith("/")):
            end_line()
            if here.tag == "p" and tag in BLOCK:  # a block ends an open paragraph
                close(here)
            if tag in ("li", "dd", "dt", "tr", "td", "th"):
                same = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}[tag]
                while here.tag in same:
                    close(here)
            gone = here.gone or gone
            node = Node(tag, here, gone, doubtful)
            here.children.append(node)
            here = node
            blocks[tag] += 1
            if tag in BLOCK:
                inline.clear()
                inlines.clear()
        else:
            inline.append(tag)
            inlines[tag] += 1
    end_line()
    return root


def _scored(root: Node) -> list[Node]:
    """All nodes that stay, in page order; every line gives points to the element that holds it and its ancestors."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.gone:
            continue
        nodes.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
        for c in node.children:
            if isinstance(c, tuple):
                line, linked = c
                node.score += 1.0 + len(line) / 50 + line.count(",") + line.count("，") + line.count("、")
                node.chars += len(line)
                node.linked += linked
                node.prose = node.prose or len(line) >= PROSE or node.tag in HEADINGS
    for node in reversed(nodes):  # children before their parents
        if node.doubtful and (node.linked > 0.5 * node.chars or (node.doubtful == 2 and not node.prose)):
            node.gone = True
        elif node.up is not None:
            node.up.chars += node.chars
            node.up.linked += node.linked
            node.up.prose = node.up.prose or node.prose
            node.up.score += node.score if node.tag == "p" else node.score / 2
            if node.tag == "p":
                node.score = 0.0
    out = []
    for node in nodes:
        node.gone = node.gone or (node.up is not None and node.up.gone)
        if not node.gone:
            node.score *= 1 - node.linked / node.chars if node.chars else 0
            out.append(node)
    return out


def _menu(node: Node) -> bool:
    return node.tag in ("ul", "ol", "div", "table", "section") and node.linked > 0.8 * node.chars and node.linked > 0


def _text(node: Node) -> list[str]:
    """All lines below an element that stay."""
    out, todo = [], [node]
    while todo:
        c = todo.pop()
        if isinstance(c, tuple):
            out.append(c[0])
        elif not c.gone:
            todo += reversed(c.children)
    return out


def _prose(node: Node) -> bool:
    lines = _text(node)
    return sum(map(len, lines)) >= ITEM * len(lines)


def _plain(c) -> int:
    """Characters of an element or line that is text with few links, else 0."""
    chars, linked = (len(c[0]), c[1]) if isinstance(c, tuple) else (0, 0) if c.gone else (c.chars, c.linked)
    return chars if linked <= 0.25 * chars else 0


def _lifted(best: Node) -> Node:
    """The article or main around ``best``; without one, the highest ancestor whose other branches hold a fifth or
    more of the text below it, or no text at all on the way there."""
    above, node = [], best
    while node is not None:
        above.append(node)
        node = node.up
    for tag in ("article", "main"):
        around = [n for n in above if n.tag == tag]
        if around:
            top, last = around[-1], next((n for n in reversed(above) if n.tag == "main"), around[-1])
            break
    else:
        top, last = best, above[-1]
    here, wrapped = top, True
    while here is not last and here.up is not None:
        below, here = here, here.up
        wrapped = wrapped and here.chars == below.chars and here.tag not in ("body", "html")
        if wrapped or sum(_plain(c) for c in here.children if c is not below) >= 0.2 * top.chars:
            top, wrapped = here, True
    return top


def _lines(top: Node):
    """The lines below an element in page order, without those of menus; pages may nest deeper than calls can.

    In an article, links that stand under a heading, or whose items are as long as prose, are no menu, like its references. A heading with a mark in it is
    that of a menu and goes with it.
    """
    todo = [(top, False)]  # and whether a heading vouches for it
    while todo:
        c, vouched = todo.pop()
        if isinstance(c, tuple):
            yield c[0]
            continue
        kept, heading = [], None
        for x in c.children:
            if isinstance(x, tuple):
                kept.append((x, vouched))
                heading = None
            elif not x.gone and x.chars:
                own = vouched
                if not own and _menu(x):
                    words = set(_WORD.findall(" ".join(_text(heading)).lower())) if heading is not None else set()
                    named = heading is not None and MARKS.isdisjoint(words)
                    if not (x.inside and (named or (heading is None and _prose(x)))):
                        if heading is not None and not named:
                            kept.pop()
                        heading = None
                        continue
                    own = True
                kept.append((x, own))
                heading = x if x.tag in HEADINGS else None
        todo += reversed(kept)


def main_text(page: str | None) -> str:
    """The article of a page: the lines of the best container and of the siblings that belong to it, joined by line ends.

    Lines pass points for length and commas to the element around their paragraph and, halved at each step, to all its
    ancestors; links take points away. The element with most points is lifted to the article or main around it, or
    else to the ancestor whose other branches hold comparable text. Below an article, main or body all stays; else the next
    elements on its level stay if they have a fifth of its points, or are text with few links. Menus, headers,
    footers, sidebars, notices, adverts, forms, scripts, styles and comments are gone before. Null and empty
    pages give an empty text.
    """
    if not page:
        return ""
    root = parsed(page.replace("\0", "�"))
    nodes = [n for n in _scored(root) if n.chars]
    if not nodes:
        return ""
    best = max(nodes, key=lambda n: n.score)
    top = _lifted(best)
    kept = [top]
    if top.up is not None and top.tag not in ("article", "main", "body"):
        kept = [c for c in top.up.children if c is top or _plain(c) or (isinstance(c, Node) and not c.gone and c.chars and c.score >= 0.2 * best.score)]
    lines = []
    for c in kept:
        lines += [c[0]] if isinstance(c, tuple) else _lines(c)
    return "\n".join(lines)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html), by ``main_text`` of the whole html.

    A null html gives an empty text. Repeated rows give repeated rows; further columns are ignored, whatever their names. Of
    containers with equal points the first in page order counts. Pages are taken whole, one after the other, in time
    that is in proportion to their length.
    """
    schema = pages.select("page_id", "url").schema.add("text", "string", False).add("n_chars", "long", False)

    def run(batches):
        for batch in batches:
            for piece in text_pieces(batch, "html", 4 << 20):
                texts = [main_text(x) for x in piece.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, schema)
