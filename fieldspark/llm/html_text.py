"""Main text of web pages by composite text density (operator 9).

Every DOM node gets its link-adjusted characters per tag; the node whose children's densities sum highest is the article, and
the least density on its path to body is the threshold below which link-heavy parts inside it are left out. Other nodes that
reach the least of the path up to body, by density or by unlinked characters per tag (which do not grow with a node's size), are
the article's too, with what lies between them below their lowest common parent. Tags and names that can only be menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles or readers' comments are never text. Where a name says both (class "story share"),
density decides: such a node goes when it is below the threshold or mostly links. Any tag that no head may hold ends the head.

Null, empty or text-free html gives ''; deep and long pages are read whole, without recursion; repeated rows repeat; an empty table gives an
empty result; other columns are ignored.
"""
from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
OUT = frozenset("head script style noscript template nav header footer aside form button select textarea iframe svg".split())
HEAD = frozenset("head title base link meta style script noscript template".split())
# words of names, between marks or capitals; a place or a kind may be joined to them
OUT_NAMES = re.compile(
    r"(?:^|[_-])(?:(?:google|display|text|side|top|page)?ads?(?:by\w+|sense|box|slot|unit|wrapper|banner)?|advert\w*|(?:site|page|main|top|global|sub)?(?:banner|sidebar|masthead|menu|nav|navbar|navigation|header|footer)|breadcrumbs?"
    r"|(?:user|reader|post)?comments?(?:list|area|section|form|box)?|repl(?:y|ies)|respond|disqus\w*|cookie\w*|notices?|alerts?|popup|promos?|share|sharing|social|sponsor\w*|related|newsletter|subscribe)(?:$|[_-])", re.I)
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
HEADERS = re.compile(r"(?:^|[_-])(?:article|entry|post|story)[_-]header$", re.I)
CONTENT = re.compile(r"(?:^|[_-])(?:article|content|entry|main|post|prose|story|text)$", re.I)
AROUND_NAMES = re.compile(r"(?:^|[_-])(?:has|is|no|not|with|without|hide|hides)[_-]", re.I)
BLOCK = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th tbody thead blockquote pre figure figcaption address center details summary dialog caption tfoot hgroup hr fieldset legend search menu dir optgroup option".split())


def named(names: str) -> tuple[bool, bool]:
    """Whether a class, id or role names boilerplate, and not a page that has or lacks some (has-sidebar, no-ads) or an article's own header; and whether it names content too."""
    names = CAMEL.sub("-", names).split()
    out = any(OUT_NAMES.search(x) and not AROUND_NAMES.search(x) and not HEADERS.search(x) for x in names)
    return out, out and any(CONTENT.search(x) and not OUT_NAMES.search(x) for x in names)


class Node:
    __slots__ = ("tag", "up", "parts", "out", "doubt", "chars", "link_chars", "tags", "link_tags", "density", "total")

    def __init__(self, tag: str, up: "Node | None", out: bool, doubt: bool = False):
        self.tag, self.up, self.parts, self.out, self.doubt = tag, up, [], out, doubt


class Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None, False)
        self.head = self.body = None
        self.order = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if self.head is not None and tag not in HEAD:
            self.at, self.head = self.head.up, None
        if tag in VOID:
            self.at.parts.append(Node(tag, self.at, self.at.out) if tag == "hr" else " ")
            self.order += self.at.parts[-1:] if tag == "hr" else []
            return
        if tag == "html" or tag == "body" and self.body is not None:
            return
        if tag in BLOCK:
            self._close_open("p", BLOCK - {"p"})
        if tag == "li":
            self._close_open("li", {"ul", "ol"})
        out, both = named(" ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))) if tag not in ("body", "article", "main") else (False, False)
        own = tag == "header" and self._within(("article", "main"))
        node = Node(tag, self.at, self.at.out or tag in OUT and not own or out and not both, both)
        self.at.parts.append(node)
        self.order.append(node)
        self.at = node
        if tag == "head":
            self.head = node
        elif tag == "body":
            self.body = node

    def _within(self, tags) -> bool:
        n = self.at
        while n is not None and n.tag not in tags:
            n = n.up
        return n is not None

    def _close_open(self, tag, stop):
        n = self.at
        while n.up is not None and n.tag not in stop:
            if n.tag == tag:
                self.at = n.up
                return
            n = n.up

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.up
        if n is not None and n.up is not None:
            self.at = n.up
            if n is self.head:
                self.head = None

    def handle_data(self, data):
        self.at.parts.append(data)


def measure(tree: Tree) -> Node:
    for n in reversed(tree.order):
        kids = [p for p in n.parts if isinstance(p, Node) and not p.out]
        n.chars = sum(len(p.strip()) for p in n.parts if isinstance(p, str)) + sum(k.chars for k in kids)
        n.tags = len(kids) + sum(k.tags for k in kids)
        n.link_chars = n.chars if n.tag == "a" else sum(k.link_chars for k in kids)
        n.link_tags = sum(k.link_tags + (k.tag == "a") for k in kids)
    body = next((n for n in tree.order if n.tag == "body"), tree.root)
    share = body.link_chars / max(body.chars, 1)
    for n in reversed(tree.order):
        c, lc, t, lt = n.chars, max(n.link_chars, 1), max(n.tags, 1), max(n.link_tags, 1)
        base = math.log(c / max(c - n.link_chars, 1) * n.link_chars + share * c + math.e)
        n.density = c / t * math.log(max(c / lc * t / lt, 1)) / math.log(max(base, 1.0001)) if c else 0.0
        n.total = sum(k.density for k in n.parts if isinstance(k, Node) and not k.out)
    inside = [n for n in tree.order if not n.out]
    best = max(inside, key=lambda n: n.total)
    n = best
    while n is not None:  # an enclosing article belongs together
        if n.tag in ("article", "main"):
            best = n
            break
        n = n.up
    return best


def plain(n: Node) -> float:
    return (n.chars - n.link_chars) / max(n.tags, 1)


def siblings(tree: Tree, top: Node) -> tuple[Node, list[Node]]:
    """The node to read and, where that is a common parent, its parts to read: what reaches the path's least, and what lies between."""
    path = [top]
    while path[-1].up is not None and path[-1].tag != "body":
        path.append(path[-1].up)
    dense, even = min(n.density for n in path), min(plain(n) for n in path)
    on_path = set(map(id, path))
    reach, todo = [top], [path[-1]]
    while todo:
        for k in todo.pop().parts:
            if not isinstance(k, Node) or k.out or k is top:
                continue
            if id(k) not in on_path and k.chars and k.link_chars * 2 <= k.chars and (k.density >= dense or plain(k) >= even):
                reach.append(k)
            else:
                todo.append(k)
    if len(reach) == 1:
        return top, []
    up = {}
    for n in reach:
        while n is not None:
            up.setdefault(id(n), [n, 0])[1] += 1
            n = n.up
    common = next(n for n in path if up[id(n)][1] == len(reach))
    holds = [i for i, k in enumerate(common.parts) if isinstance(k, Node) and id(k) in up]
    return common, common.parts[holds[0]:holds[-1] + 1]


def main_text(html: str | None) -> str:
    tree = Tree(html or "")
    top = measure(tree)
    path, n = [top.density], top
    while n is not None and n.tag != "body":
        path.append(n.density)
        n = n.up
    threshold = min(path)
    top, parts = siblings(tree, top)
    blocks, now = [], []

    def flush():
        text = " ".join("".join(now).split())
        if text:
            blocks.append(text)
        now.clear()

    stack = [(top, iter(parts or top.parts))]
    while stack:
        node, rest = stack[-1]
        part = next(rest, None)
        if part is None:
            stack.pop()
            if node.tag in BLOCK:
                flush()
        elif isinstance(part, str):
            now.append(part)
        elif part.out or part.doubt and (part.density < threshold or part.link_chars * 2 > part.chars):
            continue
        elif not (part.tag in BLOCK and part.density < threshold and part.link_chars * 2 > part.chars):
            if part.tag in BLOCK:
                flush()
            stack.append((part, iter(part.parts)))
    flush()
    return "\n\n".join(blocks)


def extract(html: Column) -> Column:
    return F.pandas_udf(lambda pages: pages.map(main_text), "string")(html)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", extract(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))
