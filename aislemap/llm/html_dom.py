"""A small tolerant reader of HTML: elements, text runs of blocks, and features of both."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[a-z]+")

# Element names by their role in HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title select option object canvas".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSED_BY_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

GROUPS = {
    "heading": "h1 h2 h3 h4 h5 h6".split(), "paragraph": ["p"], "item": "li dd dt".split(), "list": "ul ol dl menu".split(),
    "article": "article main".split(), "navigation": ["nav"], "aside": ["aside"], "header": ["header"], "footer": ["footer"],
    "form": "form fieldset button input legend dialog".split(), "quote": "blockquote pre figure figcaption table tbody tr td th".split(),
}
TOKENS = {
    "content": "article content entry post story main body text page single".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs pagination pager toc skip".split(),
    "edge": "header footer masthead topbar top bottom copyright colophon foot head".split(),
    "side": "sidebar side aside widget related recommended popular trending more rail teaser".split(),
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner affiliate".split(),
    "notice": "cookie cookies consent gdpr notice alert warning popup modal overlay disclaimer privacy message".split(),
    "form": "form login signup subscribe newsletter search register contact input".split(),
    "talk": "comment comments discussion reply replies respond disqus review reviews reader readers guestbook".split(),
    "share": "share sharing social follow tags tag meta byline author".split(),
}
_OF_TAG = {t: g for g, tags in GROUPS.items() for t in tags}
_OF_TOKEN = {t: k for k, tokens in TOKENS.items() for t in tokens}


@dataclass
class Node:
    """A block element, or (tag ``#text``) one run of text of its parent."""

    tag: str
    parent: int
    depth: int
    kinds: frozenset = frozenset()
    hidden: bool = False
    marked: bool = False
    text: str = ""
    linked: int = 0
    children: list[int] = field(default_factory=list)


def _attributes(source: str) -> tuple[frozenset, bool, bool]:
    """What the class, id and role say, whether the element is hidden, and whether it is marked as main text."""
    if not source or source.isspace():
        return frozenset(), False, False
    words, hidden, marked = [], False, False
    for name, a, b, c in _ATTRIBUTE.findall(source):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            words += _TOKEN.findall(value)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
        elif name == "data-main-text":
            marked = True
    return frozenset(_OF_TOKEN[w] for w in words if w in _OF_TOKEN), hidden, marked


def read(source: str) -> list[Node]:
    """The blocks and text runs of a page in page order; node 0 is the page. Heads, scripts, styles and comments have none."""
    nodes = [Node("#page", -1, 0)]
    open_: list[tuple[str, int]] = [("#page", 0)]  # names of open elements and the block each one is or lies in
    pieces: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            block = open_[-1][1]
            nodes[block].children.append(len(nodes))
            nodes.append(Node("#text", block, nodes[block].depth + 1, text=text, linked=min(linked, len(text))))
        linked = 0

    def close(at: int) -> None:
        nonlocal links
        while len(open_) > at:
            name = open_[-1][0]
            if name not in INLINE:
                flush()
            links -= name == "a"
            open_.pop()

    def innermost(names, stops=()) -> int:
        for at in range(len(open_) - 1, 0, -1):
            if open_[at][0] in names:
                return at
            if open_[at][0] in stops:
                return 0
        return 0

    at = 0
    while True:
        found = _TAG.search(source, at)
        if found is None or found.start() > at:
            text = html.unescape(source[at : found.start() if found else len(source)])
            pieces.append(text)
            if links:
                linked += len(text.strip())
        if found is None:
            break
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        if found[1] or found[4]:
            if here := innermost((name,)):
                close(here)
            continue
        if name == "body":
            flush()
            if here := innermost(("head",)):
                close(here)
        if name in CLOSES_P and (here := innermost(("p",), ("table", "td", "div", "article", "section", "li"))):
            close(here)
        if name in CLOSED_BY_SAME and (here := innermost((name,) if name not in ("dt", "dd", "td", "th") else (name, *{"dt": ("dd",), "dd": ("dt",), "td": ("th",), "th": ("td",)}[name]), CLOSED_BY_SAME[name])):
            close(here)
        if name in ("br", "wbr", "img"):
            pieces.append(" " if name != "wbr" else "")
            continue
        if name in RAW or name == "head":
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>" if name != "head" else r"</head\s*>|(?=<body[\s>])", re.I).search(source, at)
            if end is not None or name in ("script", "style"):
                at = end.end() if end else len(source)
            continue
        if name in INLINE:
            links += name == "a"
            open_.append((name, open_[-1][1]))
            continue
        flush()
        if name in VOID:
            continue
        block = open_[-1][1]
        kinds, hidden, marked = _attributes(found[3] or found[6] or "")
        nodes[block].children.append(len(nodes))
        open_.append((name, len(nodes)))
        nodes.append(Node(name, block, nodes[block].depth + 1, kinds, hidden, marked))
    close(1)
    flush()
    return nodes


FEATURES = [
    "depth", "run", *[f"tag_{g}" for g in GROUPS], "tag_other", "hidden", *[f"own_{k}" for k in TOKENS],
    "in_article", "in_furniture", "in_hidden", *[f"in_{k}" for k in TOKENS], "parent_other",
    "chars", "link_density", "per_node", "sentences", "mean_run", "page_share", "parent_share", "paragraphs", "items",
    "siblings", "place", "parent_links", "page_has_article", "page_has_content",
]
_FURNITURE = ("navigation", "aside", "header", "footer", "form")


def features(nodes: list[Node]) -> np.ndarray:
    """One row of FEATURES per node."""
    n = len(nodes)
    chars, links, count, runs, stops, paragraphs, items = (np.zeros(n) for _ in range(7))
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        count[i] += 1
        if node.tag == "#text":
            chars[i], links[i], runs[i] = len(node.text), node.linked, 1
            stops[i] = node.text.count(".") + node.text.count(",") + node.text.count("!") + node.text.count("?")
        p = node.parent
        if p >= 0:
            for sums in (chars, links, count, runs, stops):
                sums[p] += sums[i]
            paragraphs[p] += paragraphs[i] + (node.tag == "p")
            items[p] += items[i] + (node.tag == "li")
    groups, kinds, out = list(GROUPS), list(TOKENS), np.zeros((n, len(FEATURES)))
    above: list[tuple[bool, bool, bool, frozenset]] = []
    has_article = any(x.tag in ("article", "main") for x in nodes)
    has_content = any("content" in x.kinds for x in nodes)
    place = np.zeros(n)
    for node in nodes:
        for k, child in enumerate(node.children):
            place[child] = k / len(node.children)
    for i, node in enumerate(nodes):
        group = _OF_TAG.get(node.tag)
        before = above[node.parent] if node.parent >= 0 else (False, False, False, frozenset())
        here = (before[0] or group == "article", before[1] or group in _FURNITURE, before[2] or node.hidden, before[3] | node.kinds)
        above.append(here)
        p = max(node.parent, 0)
        row = [float(node.depth), float(node.tag == "#text")]
        row += [float(group == g) for g in groups] + [float(group is None), float(node.hidden)] + [float(k in node.kinds) for k in kinds]
        row += [float(here[0]), float(here[1]), float(here[2])] + [float(k in here[3]) for k in kinds] + [float(_OF_TAG.get(nodes[p].tag) is None)]
        c = chars[i]
        row += [
            np.log1p(c), links[i] / c if c else 0.0, c / count[i], stops[i] / c * 100 if c else 0.0, c / runs[i] if runs[i] else 0.0,
            c / chars[0] if chars[0] else 0.0, c / chars[p] if chars[p] else 0.0, paragraphs[i], items[i],
            float(len(nodes[p].children)), place[i], links[p] / chars[p] if chars[p] else 0.0, float(has_article), float(has_content),
        ]
        out[i] = row
    return out
