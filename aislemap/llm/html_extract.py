"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every block and text run gets the probability that it holds main text, and the most likely
labelling in which a kept node has kept ancestors only is decoded over the tree. Pages carry
no labels: the trees learn from pages of the table whose markup names the article, and from
the same pages laid out anew with other markup around and inside the article. Where no page
names its article, the trees are those of made-up pages, and score the same features.
"""

from __future__ import annotations

import html
import random
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aislemap.llm.html_dom import Node, features, read
from aislemap.llm.trees import Tree, boost

# Pages the fit may see, chosen by a hash of the id among those that can teach, and their greatest length.
PAGES, PAGE_CHARS = 240, 200_000
LAYOUTS = 3
# Pages without this have nothing to teach; of the others some have not, such as those with it in a script.
TEACHING = r"(?i)<(article|main)|data-main-text"
TREES, DEPTH = 40, 4

_OUTSIDE = {"nav", "aside", "header", "footer", "form", "fieldset", "dialog", "button"}
_BAD = {"menu", "edge", "side", "advert", "notice", "form", "talk", "share"}


def teacher(nodes: list[Node]) -> list[bool] | None:
    """Which runs are main text, where the markup says so: in an article or main element (or marked), outside furniture."""
    marked = any(n.marked for n in nodes)
    if not marked and not any(n.tag in ("article", "main") for n in nodes):
        return None
    inside: list[tuple[bool, bool]] = []
    for node in nodes:
        main, outside = inside[node.parent] if node.parent >= 0 else (False, False)
        main = main or (node.marked if marked else node.tag in ("article", "main"))
        outside = outside or (not marked and (node.tag in _OUTSIDE or node.hidden or bool(node.kinds & _BAD)))
        inside.append((main, outside))
    return [n.tag == "#text" and main and not outside for n, (main, outside) in zip(nodes, inside)]


def node_labels(nodes: list[Node], runs: list[bool]) -> np.ndarray:
    """A block is main if any run below it is."""
    out = np.array(runs, bool)
    for i in range(len(nodes) - 1, 0, -1):
        if out[i]:
            out[nodes[i].parent] = True
    return out


def laid_out(main: list[tuple[str, str]], other: list[str], rng: random.Random) -> str:
    """A page of given main blocks and other texts with made-up markup; main blocks are marked for the teacher."""
    esc = html.escape
    other = other or ["Menu", "More"]

    def some(a: int, b: int) -> list[str]:
        return [esc(rng.choice(other)) for _ in range(rng.randint(a, b))]

    def short() -> str:
        return esc(" ".join(rng.choice(other).split()[: rng.randint(1, 3)]))

    def tagged(tag: str, names: list[str], inner: str, plain: float = 0.0) -> str:
        if rng.random() < plain:
            return f"<{tag}>{inner}</{tag}>"
        name = rng.choice(names) + rng.choice(["", "", "-box", "-wrap", " clearfix", "-area", " block"])
        return f'<{tag} {rng.choice(["class", "id", "class"])}="{name}">{inner}</{tag}>'

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{short()}</a></li>' for i in range(n)) + "</ul>"

    def paragraphs(a: int, b: int) -> str:
        return "".join(f"<p>{t}</p>" for t in some(a, b))

    def remarks() -> str:
        each = "".join(tagged(rng.choice(["div", "li", "article", "section"]), ["comment", "reply", "comment-body", "review"], f"<b>{short()}</b>" + paragraphs(1, 2)) for _ in range(rng.randint(1, 4)))
        return tagged(rng.choice(["div", "section", "ol", "aside"]), ["comments", "discussion", "comment-list", "reader-comments", "respond"], rng.choice(["", f"<h3>{short()}</h3>"]) + each)

    def advert() -> str:
        tag, text = rng.choice(["div", "div", "aside", "p", "section"]), some(1, 1)[0]
        return tagged(tag, ["ad", "ads", "advert", "sponsored", "promo", "banner", "advertisement"], text if tag == "p" or rng.random() < 0.5 else f"<p>{text}</p>")

    def notice() -> str:
        tag, text = rng.choice(["div", "div", "section", "p"]), some(1, 1)[0]
        inner = text if tag == "p" or rng.random() < 0.5 else f"<p>{text}</p>" + rng.choice(["", f"<button>{short()}</button>"])
        return tagged(tag, ["cookie-notice", "consent", "notice", "alert", "popup", "disclaimer", "gdpr"], inner)

    def form() -> str:
        return f'<form action="/s">{rng.choice(["", paragraphs(1, 1)])}<label>{short()}</label><input name="q"><button>{short()}</button></form>'

    def side() -> str:
        inner = f"<h3>{short()}</h3>" + rng.choice([links(rng.randint(2, 6)), paragraphs(1, 3)])
        return rng.choice([f"<aside>{inner}</aside>", tagged(rng.choice(["div", "aside", "section"]), ["sidebar", "related", "widget", "recommended", "side"], inner)])

    def share() -> str:
        return tagged(rng.choice(["div", "ul"]), ["share", "social", "tags", "follow"], links(rng.randint(2, 4)))

    extras = [advert, notice, form, side, share, remarks]
    body = []
    for tag, text in main:
        shown = esc(text)
        kind = rng.random()
        if tag not in ("h1", "h2", "h3") and kind < 0.06:
            body.append(f"<blockquote data-main-text><p>{shown}</p></blockquote>")
        elif tag == "p" and kind < 0.12:
            words = text.split()
            cut = max(1, len(words) // 3)
            body.append("<ul data-main-text>" + "".join(f"<li>{esc(' '.join(words[i : i + cut]))}</li>" for i in range(0, len(words), cut)) + "</ul>")
        elif tag == "p" and kind < 0.2:
            body.append(f"<div data-main-text>{shown}</div>")
        elif tag == "p" and kind < 0.28 and " " in text:
            first, rest = shown.split(" ", 1)
            body.append(f'<p data-main-text><a href="/x">{first}</a> <em>{rest}</em></p>')
        elif tag == "p" and kind < 0.32:
            body.append(f"<figure data-main-text><img src=x><figcaption>{shown}</figcaption></figure>")
        elif tag == "p" and kind < 0.36:
            body.append(f"<h2 data-main-text>{esc(' '.join(text.split()[:6]))}</h2><p data-main-text>{shown}</p>")
        else:
            body.append(f"<{tag} data-main-text>{shown}</{tag}>")
        if rng.random() < 0.1:
            body.append(rng.choice(extras)())
    if rng.random() < 0.3:
        body.append(remarks())
    inner = "".join(body)
    if rng.random() < 0.3:
        inner = f"<div>{inner}</div>"
    page = rng.choice([
        f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f"<div>{inner}</div>", f"<section>{inner}</section>",
        tagged("div", ["content", "post", "entry", "article-body", "story", "main-text"], inner), tagged("section", ["post-content", "page", "entry-content"], inner), inner,
    ])
    before = [rng.choice([f"<nav>{links(rng.randint(2, 8))}</nav>", tagged("div", ["menu", "nav", "navbar", "breadcrumb"], links(rng.randint(2, 8)))])] if rng.random() < 0.9 else []
    if rng.random() < 0.5:
        before.insert(0, rng.choice([f"<header><h2>{short()}</h2>{rng.choice(['', paragraphs(1, 1)])}</header>", tagged("div", ["header", "masthead", "top"], f"<h2>{short()}</h2>")]))
    before += [f() for f in extras if rng.random() < 0.2]
    after = [f() for f in extras if rng.random() < 0.35]
    if rng.random() < 0.9:
        words = rng.choice([some(1, 1)[0], paragraphs(1, 2), links(4)])
        after.append(rng.choice([f"<footer>{words}</footer>", tagged("div", ["footer", "bottom", "copyright", "colophon"], words)]))
    return "<html><head><title>x</title></head><body>" + "".join(before) + page + "".join(after) + "</body></html>"


class Extractor:
    """The trees learnt from a table, else the ``default`` ones, and the decoding of the page they score."""

    def __init__(self, start: float, trees: list[Tree], default: list[Tree] | None = None):
        self.start, self.trees, self.default = start, trees, default or []

    def logits(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        for tree in self.trees or self.default:
            score += tree.predict(x)
        return np.clip(score, -12, 12)

    def texts(self, pages: list[list[Node]]) -> list[str]:
        """The main text of pages that are scored together."""
        if not pages:
            return []
        logits = self.logits(np.vstack([features(p) for p in pages]))
        out, at = [], 0
        for page in pages:
            kept = decode(page, logits[at : at + len(page)])
            at += len(page)
            out.append("\n".join(n.text for n, k in zip(page, kept) if k and n.tag == "#text"))
        return out


def decode(nodes: list[Node], logits: np.ndarray) -> list[bool]:
    """The most likely labels under which a kept node has a kept parent and a kept block keeps something."""
    # gain of keeping the subtree at its best over dropping it whole
    gain = np.array(logits, float)
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].tag != "#text":
            own = logits[i] + sum(max(gain[c], 0.0) for c in nodes[i].children)
            gain[i] = own if any(gain[c] > 0 for c in nodes[i].children) else -np.inf
    kept = [False] * len(nodes)
    kept[0] = True
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and bool(gain[i] > 0)
    return kept


def _fit(read_pages: list[list[Node]], layouts: int) -> tuple[float, list[Tree]] | None:
    """Start value and trees learnt from pages and their new layouts; nothing if no page names its article."""
    other = [n.text for nodes in read_pages for n in nodes if n.tag == "#text"]
    rng, xs, ys = random.Random(7), [], []
    for nodes in read_pages:
        runs = teacher(nodes)
        if runs is None or not any(runs):
            continue
        main = [(nodes[n.parent].tag if nodes[n.parent].tag in ("h1", "h2", "h3") else "p", n.text) for n, r in zip(nodes, runs) if r]
        made = [read(laid_out(main, other, rng)) for _ in range(layouts)]
        for page, labels in [(nodes, runs)] + [(p, teacher(p)) for p in made]:
            xs.append(features(page))
            ys.append(node_labels(page, labels))
    return boost(np.vstack(xs), np.concatenate(ys).astype(float), TREES, DEPTH, bins=32) if xs else None


@cache
def default_extractor() -> Extractor:
    """What pages of made-up words in all layouts teach; it depends on no table."""
    rng = random.Random(17)

    def words(n: int) -> str:
        return " ".join("".join(rng.choice("aeioubdlmnrst") for _ in range(rng.choice([2, 3, 4, 5, 6, 8, 10]))) for _ in range(n)).capitalize()

    def sentences(a: int, b: int) -> str:
        return " ".join(words(rng.randint(4, 10)) + rng.choice([". ", ", " + words(rng.randint(3, 10)).lower() + ". "]).rstrip() for _ in range(rng.randint(a, b)))

    made = []
    for _ in range(PAGES):
        main = [("h1", words(rng.randint(2, 12)))] if rng.random() < 0.9 else []
        for _ in range(rng.randint(1, 12)):
            if rng.random() < 0.15:
                main.append(("h2", words(rng.randint(1, 7))))
            main.append(("p", sentences(1, rng.choice([2, 6, 12]))))
        other = [words(rng.randint(1, 4)) for _ in range(6)] + [sentences(1, 3) for _ in range(6)]
        made.append(read(laid_out(main, other, rng)))
    start, trees = _fit(made, LAYOUTS)
    return Extractor(start, [], trees)


def fit_extractor(pages: DataFrame, most: int = PAGES, layouts: int = LAYOUTS, text: str = "html", page_id: str = "page_id") -> Extractor:
    """Trees fitted on at most ``most`` pages of the table whose markup names the article; the default ones if there are none.

    The first pages by key are read first. Only if some of them cannot teach are all pages asked.
    """
    known = pages.select(F.col(page_id).alias("id"), F.col(text).alias("html")).where(F.length("html").between(1, PAGE_CHARS))
    known = known.withColumn("key", F.struct(F.xxhash64(F.lit("pages"), "id").alias("order"), F.xxhash64("html").alias("tie")))

    def teaches(column: pa.Array) -> pa.Array:
        return pa.array([any(teacher(read(s)) or ()) for s in column.to_pylist()], pa.bool_())

    def first(some: DataFrame) -> list[list[Node]]:
        # only keys are ordered, so that no task sends pages that are not among the chosen
        keys = some.select("key").orderBy("key").limit(most)
        rows = sorted(known.join(F.broadcast(keys), "key", "left_semi").dropDuplicates(["key"]).collect(), key=lambda r: r["key"])
        return [read(r["html"]) for r in rows]

    read_pages = first(known)
    if not all(any(teacher(p) or ()) for p in read_pages):
        read_pages = first(known.where(F.col("html").rlike(TEACHING)).where(F.arrow_udf(teaches, "boolean")("html")))
    fitted = _fit(read_pages, layouts)
    return Extractor(*fitted) if fitted else default_extractor()


def extract_text(pages: DataFrame, extractor: Extractor, text: str = "html") -> DataFrame:
    """``pages`` with ``text``: the main text of the whole page, blocks joined by a line feed; a column of this name is replaced.

    Null and empty pages, and pages without main text, give the empty string. Character
    references are decoded and white space in a block is one space. No rows give no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(extractor)

    def extract(column: pa.Array) -> pa.Array:
        sources, out = column.to_pylist(), []
        for at in range(0, len(sources), 500):
            out += shared.value.texts([read(s or "") for s in sources[at : at + 500]])
        return pa.array(out, pa.string())

    found = F.arrow_udf(extract, "string").asNondeterministic()
    done = pages.select(F.struct("*").alias("row")).withColumn("text", found(F.col(f"row.`{text}`")))
    return done.select(*[F.col(f"row.`{c}`") for c in pages.columns if c.lower() != "text"], "text")

