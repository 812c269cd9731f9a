"""Main text of pages: the given pages, written cases, and minimum cuts against trying every labelling."""

from __future__ import annotations

import itertools
import re
from html import unescape

import numpy as np
import pytest

from pricewarden.llm import main_text
from pricewarden.llm.main_text import costs, extract_main_text, label, links
from pricewarden.llm.page_blocks import blocks
from pricewarden.llm.queries import QUERIES


def text_of(html, weights=None):
    found = blocks(html)
    return " ".join(b.text for b, own in zip(found, label(costs(found, weights or {}), links(found)), strict=True) if own)


def article(html):
    """What stands between the tags of the one article of a given page."""
    inside = re.search(r"<article>(.*)</article>", html, re.S)[1]
    parts = (" ".join(unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", inside))
    return " ".join(p for p in parts if p)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_pages(spark, given, sf):
    given = given.replace("sf0.001", sf)
    pages = {r.page_id: r for r in spark.read.parquet(f"{given}/pages.parquet").collect()}
    found = QUERIES["op12_main_text"](spark, given).collect()
    assert len(found) == len(pages)
    for r in found:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, article(pages[r.page_id].html), len(r.text))


PAGE = """<!doctype html><html><head><title>Not this</title><style>p{a:b}</style></head><body class="has-sidebar no-ads">
<header id=top><a href=/>Site name</a><p>Our motto is long enough to look like a sentence.</p></header>
<div class="cookie-notice"><p>We use cookies, and we say so in a whole sentence of many words.</p></div>
<nav><ul><li><a href="/a">One</a><li><a href='/b'>Two &gt; three</a></ul></nav>
<form action="?"><label>Search</label><input name=q><p>Type what you look for.</p></form>
%s
<aside><h2>Related</h2><p>Another article, which is about something else altogether, is here.</p></aside>
<section id="comments"><article><p>I have read it all, and I don't agree at all, said a reader.</p></article></section>
<footer>&copy; 2020 Somebody. All rights reserved.</footer><script>document.write("<p>written</p>")</script></body></html>"""
TEXT = "The title First paragraph, with a link and &c. Second one after an advert."
BODY = """<h1>The   title</h1><p>First <b>paragraph</b>,<br>with a <a href="x>y">link</a> and &amp;c.
<div class="adBox"><p>Buy this, it is the best of all things that you can buy today.</p></div><!-- <p>comment</p> -->
<p hidden>Hidden words.</p><p>Second one after an&nbsp;advert.<button>Press</button>"""


@pytest.mark.parametrize("around", [
    "<article>%s</article>", "<main>%s</main>", "<div role=main>%s</div>", '<main><article class="post">%s</article></main>',
    '<article itemscope><header class="entry-header"></header>%s<footer>Tags: one, two</footer></article>',
    '<form id="aspnetForm"><div class="page-with-sidebar"><article>%s</article></div></form>',
])
def test_written_page(around):
    assert text_of(PAGE % (around % BODY)) == TEXT


def test_page_without_names_of_content():
    """No element says that it is the article; what it is not, and what was learned from other pages, decides."""
    weights = {("kind", 1): 0.8, **{("words", k): w for k, w in enumerate((-1, -0.5, 0.5, 1, 1.5))}} | {("links", k): w for k, w in enumerate((0.5, 0, -1, -2))}
    body = "<div><h2>The title</h2><p>A first paragraph of some twenty words, so that nobody takes it for anything but text that was written to be read.</p><p>Short.</p><p>A last paragraph that is as long as the first was and has no link whatsoever, as one can see here.</p></div>"
    menu = "<div><div><a href=a>Home</a></div><div><a href=b>News</a></div><div><a href=c>About us</a></div></div>"
    found = text_of(PAGE % (menu + body), weights)
    assert found.startswith("The title A first") and found.endswith("see here.") and "Short." in found and "News" not in found


@pytest.mark.parametrize("html, text", [
    ("", ""), ("no markup at all", "no markup at all"), ("<p>a<p>b", "a b"), ("a < b and c > d", "a < b and c > d"), ("<p>x &lt;b&gt; y &#x41;&#66; &nosuch;</p>", "x <b> y AB &nosuch;"),
    ("<script>never closed <p>x", ""), ("<!-- never closed <p>x", ""), ("</p></div>lone", "lone"), ("<p title='a>b'>x</p", "x"), ("<p>x<a href='", "x"), ("<p>1 <", "1 <"), ("<div><span>a</span><span>b</span></div>c", "ab c"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<pre>a\n\n  b</pre>", "a b"), ("<p>a 　b\x0bc</p>", "a b c"), ("<![CDATA[x]]><?php y ?>z", "z"),
])
def test_blocks(html, text):
    assert " ".join(b.text for b in blocks(html)) == text


def test_very_long_and_deep_pages():
    long = "<article>" + "<p>word word, word.</p>" * 30_000 + "</article><footer>" + "<div>x</div>" * 30_000
    assert text_of(long) == " ".join(["word word, word."] * 30_000)
    deep = "<div>" * 30_000 + "<article><p>inside" + "<span>" * 30_000 + " still"
    assert text_of(deep) == "inside still"


def value(cost, edges, sides):
    return sum(abs(c) for c, s in zip(cost, sides, strict=True) if (c > 0) != s and c) + sum(w for a, b, w in edges if sides[a] != sides[b])


def test_cuts_are_least():
    rng = np.random.default_rng(4)
    for trial in range(300):
        n = int(rng.integers(1, 9))
        cost = rng.normal(0, 1, n).round(2).tolist()
        edges = [(i - 1, i, float(rng.random().__round__(2)) * 2) for i in range(1, n)] + [
            (int(a), int(b), float(rng.random().__round__(2))) for a, b in rng.integers(0, n, (trial % 4, 2)) if a != b
        ]
        best = min(value(cost, edges, sides) for sides in itertools.product((False, True), repeat=n))
        assert value(cost, edges, label(cost, edges)) == pytest.approx(best, abs=1e-6)
        assert value(cost, edges, main_text._cut(cost, edges)) == pytest.approx(best, abs=1e-6)


def test_smoothness_turns_an_odd_block():
    cost, near = [2.0, -0.3, 2.0], [(0, 1, 0.4), (1, 2, 0.4)]
    assert label(cost, near) == [True, True, True]
    assert label(cost, []) == [True, False, True]


def test_awkward_pages(spark):
    rows = [(1, "u", None, "clash"), (None, None, "<article>a", "clash"), (2, "u", "", "clash"), (2, "u", "<article>a", "clash"), (2, "u", "<article>a", "clash")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in extract_main_text(frame).collect())
    assert found == [(0, None, "a", 1), (1, "u", "", 0), (2, "u", "", 0), (2, "u", "a", 1), (2, "u", "a", 1)]
    assert extract_main_text(frame.where("false")).collect() == []
