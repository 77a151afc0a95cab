"""Main text against the markup of real pages and against hand-made pages."""

import random

import pytest
from pyspark.sql import functions as F

from aislemap.llm.html_dom import features, read
from aislemap.llm.html_extract import Extractor, decode, extract_text, fit_extractor, laid_out, teacher

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def extractor(spark):
    return fit_extractor(spark.read.parquet(f"{SF}/pages.parquet"))


def test_every_page_of_the_table(spark, extractor):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = extract_text(pages, extractor).select("html", "text").collect()
    assert len(rows) == 2500
    for r in rows:
        nodes = read(r["html"])
        assert r["text"] == "\n".join(n.text for n, main in zip(nodes, teacher(nodes)) if main)


def test_unseen_layouts(spark, extractor):
    rows = spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").limit(120).collect()
    rng, pages = random.Random(2024), [read(r["html"]) for r in rows]
    other = [n.text for p in pages for n in p if n.tag == "#text"]
    wrong = total = 0
    for page in pages:
        main = [(page[n.parent].tag, n.text) for n, m in zip(page, teacher(page)) if m]
        made = read(laid_out([(t if t in ("h1", "h2") else "p", x) for t, x in main], other, rng))
        kept = decode(made, extractor.logits(features(made)))
        wrong += sum(k != m for n, k, m in zip(made, kept, teacher(made)) if n.tag == "#text")
        total += sum(n.tag == "#text" for n in made)
    assert wrong / total < 0.01


def without_article(html):
    """The page in containers that do not name the article."""
    for tag in ("article", "main"):
        html = html.replace(f"<{tag}", "<div").replace(f"</{tag}>", "</div>")
    return html


def test_pages_that_cannot_teach(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").limit(100).collect()
    want = {r["page_id"]: [n.text for n, m in zip(read(r["html"]), teacher(read(r["html"]))) if m] for r in rows}
    plain = spark.createDataFrame([(r["page_id"], without_article(r["html"])) for r in rows], "page_id long, html string")
    out = extract_text(plain, fit_extractor(plain)).collect()
    wrong = total = 0
    for r in out:
        got, main = r["text"].split("\n"), want[r["page_id"]]
        wrong += len(set(got) ^ set(main))
        total += len(main)
    assert all(r["text"] for r in out) and wrong / total < 0.05


def test_pages_that_teach_are_rare(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").limit(300).collect()
    mixed = [(r["page_id"], r["html"] if i < 3 else without_article(r["html"])) for i, r in enumerate(rows)]
    mixed += [(1000 + i, "<script>'<article>'</script><p>x</p>") for i in range(50)]
    assert fit_extractor(spark.createDataFrame(mixed, "page_id long, html string"), most=3).trees


WORDS = "The harbour was rebuilt after the storm, and the council paid for most of it. "
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>
<header><h2>Site</h2></header><div class="menu"><a href=1>Home</a> <a href=2>News</a></div>
<div class="cookie-notice">We use cookies. <button>OK</button></div>
<div class="content"><h1>Title &amp; more</h1><p>{WORDS * 3}<p>{WORDS}x&nbsp;&#233;
  y<br>z {WORDS}</p><script>var a = "<p>no</p>";</script><!-- <p>no</p> -->
<div class="ad">Buy now, cheap and good.</div><p>{WORDS * 2}</p>
<div class="comments"><h3>2 comments</h3><div class="comment"><p>I was there when it happened, and it was loud.</p></div></div></div>
<div class="sidebar"><h3>Related</h3><ul><li><a href=3>One</a></li></ul></div><form><label>Mail</label><input></form>
<footer>&copy; 2020</footer></body></html>"""


def test_hand_made_page(spark, extractor):
    text = extract_text(spark.createDataFrame([(1, PAGE)], "page_id long, html string"), extractor).first()["text"]
    sentence = WORDS.strip()
    assert text.split("\n") == ["Title & more", " ".join([sentence] * 3), f"{sentence} x é y z {sentence}", " ".join([sentence] * 2)]


def test_reading_broken_markup():
    def runs(source):
        return [n.text for n in read(source) if n.tag == "#text"]

    assert runs("<p>a<b>b<p>c</b> d</div>e") == ["ab", "c d e"] or runs("<p>a<b>b<p>c</b> d</div>e") == ["ab", "c de"]
    assert runs('<p title="a>b">x</p><p title="unclosed>y</p>') == ["x", "y"]
    assert runs("a < b &lt; c &unknown; &#x41;") == ["a < b < c &unknown; A"]
    assert runs("<ul><li>1<li>2</ul><table><tr><td>3<td>4</table>") == ["1", "2", "3", "4"]
    assert runs("<script>if (a < b) '<p>'</script>t<textarea>u</textarea>") == ["t"]
    assert runs("<a href=x>  l  </a>\n\t m") == ["l m"]
    assert runs("") == []


def test_a_kept_node_has_kept_ancestors():
    nodes = read("<div><p>a</p><div><p>b</p></div></div><p>c</p>")
    by = {n.text: i for i, n in enumerate(nodes) if n.text}
    logits = [-1.0] * len(nodes)
    logits[by["b"]] = 9.0
    kept = decode(nodes, logits)
    assert kept[by["b"]] and not kept[by["a"]] and not kept[by["c"]]
    at = by["b"]
    while at >= 0:
        assert kept[at]
        at = nodes[at].parent
    logits[nodes[nodes[by["b"]].parent].parent] = -50.0
    assert not any(decode(nodes, logits)[1:])


def test_odd_rows(spark, extractor):
    rows = [(1, None), (2, ""), (3, "<p>"), (None, "<div>" * 3000 + "x"), (1, "<article><p>" + "word " * 200000 + "</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash")).withColumn("row", F.lit(1))
    out = extract_text(pages, extractor).collect()
    assert len(out) == 5 and [r["text"] for r in out if r["page_id"] in (2, 3)] == ["", ""]
    assert extract_text(pages.limit(0), extractor).count() == 0
    assert fit_extractor(spark.createDataFrame([(1, "<p>x</p>")], "page_id long, html string")).trees == []
    assert Extractor(-1.0, []).texts([read("<p>x</p>")]) == [""]
