"""Main text of web pages by tree scoring.

A paragraph is a block with text of its own. It passes points (one, one per comma, up to three for its length) to its ancestors, less
to farther ones; a container's points are discounted by the share of its text inside links. The best container is kept, or the article
or main element that holds it, and with it the siblings that hold paragraphs, or score well, and aren't mostly links; of an article's
siblings the articles that score well. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
are left out wherever they stand. Where only the words of a class or id say so, an element with most of the page's text outside links
stays, and if nothing would be left, these words don't count.

A null page is an empty one; broken markup never fails; nothing is cut or capped. Only the id, url and html columns are read, so
further columns can't clash; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of elements (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody
    td tfoot th thead title tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element that a new one of these kinds closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}}
#: Ends the search for an element to close.
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"},
         "option": {"select"}, "tbody": {"table"}}
DROPPED = frozenset("""script style noscript template head title nav footer aside button select textarea input label iframe object
    embed svg canvas audio video map dialog menu datalist""".split())
#: What may stand in a head; anything else ends one that is not closed.
IN_HEAD = frozenset("base link meta title noscript style script template".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
DROPPED_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted
    banner sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager masthead topbar header footer cookie cookies consent
    gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related
    recommended recommendations comment comments commentlist disqus respond reply replies toolbar copyright disclaimer widget""".split())
#: An element named by such words is left out if it holds at most this share of the page's text outside links: reader comments may be
#: longer than what they are about.
LITTLE, LITTLE_TALK = 0.5, 0.9
TALK = frozenset("comment comments commentlist disqus respond reply replies".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "points", "text_len", "link_len", "paragraphs", "dropped", "holds_article", "plain_len",
                 "linked")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.points, self.text_len, self.link_len, self.paragraphs = 0.0, 0, 0, 0
        self.dropped = self.holds_article = self.linked = False
        self.plain_len = 0


class Tree(HTMLParser):
    """A tree of elements; an end tag that matches nothing is ignored, open elements end with their parents."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", {}, None)
        self.order = [self.root]

    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a marked section of an unknown kind is a comment
            return self.parse_bogus_comment(i)

    def handle_starttag(self, tag, attrs):
        if self.at.tag == "head" and tag not in IN_HEAD:
            self.at = self.at.parent
        if tag in ("html", "body"):
            return
        if tag in BLOCKS and self._open("p", None):
            self._close("p", None)
        if tag in CLOSES:
            for kind in CLOSES[tag]:
                self._close(kind, SCOPE[tag])
        node = Node(tag, dict(attrs) if attrs else {}, self.at)
        self.at.children.append(node)
        self.order.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in ("html", "body"):
            self._close(tag, None if tag in BLOCKS else BLOCKS)

    def handle_data(self, data):
        if self.at.tag == "head" and data.strip():
            self.at = self.at.parent
        self.at.children.append(data)

    def _open(self, tag: str, stop) -> bool:
        node = self.at
        while node.parent is not None and node.tag != tag:
            if (stop and node.tag in stop) or (tag == "p" and node.tag in ("table", "td", "th", "button", "object")):
                return False
            node = node.parent
        return node.tag == tag and node.parent is not None

    def _close(self, tag: str, stop) -> None:
        if self._open(tag, stop):
            while self.at.tag != tag:
                self.at = self.at.parent
            self.at = self.at.parent


def _names(node: Node) -> set[str]:
    words = f"{node.attrs.get('class') or ''} {node.attrs.get('id') or ''}"
    return {w.lower() for w in WORD.findall(words)} if words != " " else set()


def _left_out(node: Node, in_article: bool) -> bool:
    tag, attrs = node.tag, node.attrs
    if tag in DROPPED:
        return True
    if tag == "header":
        return not in_article
    return bool(attrs) and bool("hidden" in attrs or HIDDEN.search(attrs.get("style") or "")
                                or (attrs.get("role") or "").lower() in DROPPED_ROLES)


def _named_out(node: Node, in_article: bool, page_len: int) -> bool:
    tag = node.tag
    if tag == "form":  # one around the whole page is no form to fill in
        return not node.holds_article and node.plain_len <= LITTLE * page_len
    if not node.attrs or tag == "header":
        return False
    if node.holds_article or tag in ("main", "article") and not _names(node) & {"comment", "comments", "ad", "related", "reply"}:
        return False
    named = _names(node) & DROPPED_NAMES
    if named <= {"header", "banner"} and in_article:
        return False  # an article's own head
    share = LITTLE_TALK if named & TALK else LITTLE
    return bool(named) and tag not in HEADINGS and node.plain_len <= share * page_len


def _read(tree: Tree, by_name: bool = True) -> list[tuple[Node, str]]:
    """Decide what is left out and list the paragraphs: (block, text), in page order, without what is left out."""
    for node in tree.order:
        if node.tag in ("article", "main"):
            up = node.parent
            while up is not None and not up.holds_article:
                up.holds_article, up = True, up.parent
    inside: set[int] = set()
    for node in tree.order[1:]:  # parents come first
        up = node.parent
        if up.tag in ("article", "main") or id(up) in inside:
            inside.add(id(node))
        node.linked = up.linked or node.tag == "a"
        node.dropped = up.dropped or _left_out(node, id(node) in inside)
    if by_name:
        for node in reversed(tree.order):
            if not node.dropped:
                if not node.linked:
                    node.plain_len += sum(len(c.strip()) for c in node.children if isinstance(c, str))
                if node.parent is not None:
                    node.parent.plain_len += node.plain_len
        for node in tree.order[1:]:
            node.dropped = node.dropped or node.parent.dropped or _named_out(node, id(node) in inside, tree.root.plain_len)
    found: list[tuple[Node, list[str], list[int]]] = []
    block, parts, linked = tree.root, [], [0]

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            found.append((block, parts, linked))
            parts, linked = [], [0]

    stack: list[tuple[Node, int]] = [(tree.root, 0)]
    links = 0
    while stack:
        node, k = stack.pop()
        if k == 0:
            if node.tag in BLOCKS:
                flush()
                block = node
            if node.tag == "a":
                links += 1
        if k < len(node.children):
            stack.append((node, k + 1))
            child = node.children[k]
            if isinstance(child, str):
                parts.append(child)
                if links:
                    linked[0] += len(child.strip())
            elif child.tag == "br":
                parts.append(" ")
            elif not child.dropped:
                stack.append((child, 0))
        else:
            if node.tag == "a":
                links -= 1
            if node.tag in BLOCKS:
                flush()
                up = node.parent
                while up is not None and up.tag not in BLOCKS:
                    up = up.parent
                block = up or tree.root
    out = []
    for node, own, link_len in found:
        text = " ".join("".join(own).split())
        if text:
            out.append((node, text))
            _score(node, text, min(link_len[0], len(text)))
    return out


def _score(block: Node, text: str, link_len: int) -> None:
    points = 0.0 if block.tag in HEADINGS else 1 + text.count(",") + min(len(text) / 100, 3.0)
    points *= 1 - link_len / len(text)
    plain = block.tag not in HEADINGS and link_len * 2 < len(text)
    node, depth = block, 0
    while node is not None:
        node.text_len += len(text)
        node.link_len += link_len
        node.paragraphs += plain
        if depth or block.parent is None or block.tag not in ("p", "pre", "blockquote", "li", "dd", "td"):
            node.points += points / max(1, depth)
        node, depth = node.parent, depth + 1


def _density(node: Node) -> float:
    return node.link_len / node.text_len if node.text_len else 0.0


def main_text(html: str) -> str:
    tree = Tree()
    tree.feed(html)
    tree.close()
    paragraphs = _read(tree)
    if not any(node.paragraphs for node, _ in paragraphs):
        for node in tree.order:
            node.points, node.text_len, node.link_len, node.paragraphs = 0.0, 0, 0, 0
        paragraphs = _read(tree, by_name=False)
    if not paragraphs:
        return ""

    def rank(node: Node) -> float:
        bonus = 25.0 if node.tag in ("article", "main") or (node.attrs.get("role") or "") == "main" else 0.0
        return (node.points + bonus) * (1 - _density(node)) if node.paragraphs else 0.0

    containers = [n for n in tree.order if n.tag in BLOCKS and n.paragraphs and not n.dropped]
    if not containers:
        return ""
    best = max(containers, key=rank)
    for kind in ("article", "main"):
        node = best
        while node is not None and node.tag != kind:
            node = node.parent
        if node is not None:
            best = node
            break
    kept = {id(best)}
    if best.parent is not None:
        least = max(1.0, 0.2 * rank(best))
        own = 0.2 * best.points * (1 - _density(best))
        for sibling in best.parent.children:
            if isinstance(sibling, Node) and not sibling.dropped and sibling.text_len:
                if best.tag in ("article", "main"):
                    good = sibling.tag == best.tag and sibling.paragraphs and sibling.points * (1 - _density(sibling)) >= own
                else:
                    good = rank(sibling) >= least or sibling.paragraphs or sibling.tag in HEADINGS
                if good and _density(sibling) < 0.33:
                    kept.add(id(sibling))
    out = []
    for node, text in paragraphs:
        up: Node | None = node
        while up is not None and id(up) not in kept:
            up = up.parent
        if up is not None:
            out.append(text)
    return "\n\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text): the main text of every page, empty if it has none."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = [main_text(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return read.mapInArrow(batches, f"id {kinds[0]}, url {kinds[1]}, text string").toDF(id_col, url_col, "text")
