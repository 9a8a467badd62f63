"""Main text of pages: messages against enumeration, the reader against cases, results against pages with known text."""

import html
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import extraction
from sessionloom.llm.dom import Page
from sessionloom.llm.extraction import CONTENT, Forest, default_model, main_texts, op13_main_text, states
from sessionloom.llm.layouts import labelled_pages

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("seed", range(6))
def test_marginals_equal_enumeration(seed):
    draw = np.random.Generator(np.random.PCG64(seed))
    parent = [-1] + [0] * 6
    for i in range(1, 7):
        parent[i] = int(draw.integers(0, i))
    n = len(parent)
    parent = [parent[i] for i in range(n)]
    single, pair, kind = draw.normal(size=(n, 3)) * 3, draw.normal(size=(3, 3, 3)) * 2, draw.integers(0, 3, n)
    want, expected, total = np.zeros((n, 3)), np.zeros((3, 3, 3)), 0.0
    for labels in itertools.product(range(3), repeat=n):
        score = sum(single[i, s] for i, s in enumerate(labels)) + sum(pair[kind[i], labels[parent[i]], labels[i]] for i in range(1, n))
        weight = np.exp(score)
        total += weight
        for i, s in enumerate(labels):
            want[i, s] += weight
            if i:
                expected[kind[i], labels[parent[i]], s] += weight
    # a second page beside it must not matter
    order = sorted(range(n), key=lambda i: path(parent, i))
    place = {old: new for new, old in enumerate(order)}
    own = [place[parent[i]] if parent[i] >= 0 else -1 for i in order]
    forest = Forest([own, [-1, 0]])
    both = np.concatenate([single[order], draw.normal(size=(2, 3))])
    found, counted = forest.marginals(both, pair, np.concatenate([kind[order], [0, 1]]), pairs=True)
    np.testing.assert_allclose(found[:n], want[order] / total, atol=1e-12)
    alone, _ = Forest([own]).marginals(single[order], pair, kind[order])
    np.testing.assert_allclose(alone, found[:n], atol=1e-12)
    _, counted = Forest([own]).marginals(single[order], pair, kind[order], pairs=True)
    np.testing.assert_allclose(counted, expected / total, atol=1e-12)


def path(parent, i):
    return [*path(parent, parent[i]), i] if i >= 0 else []


def runs(source):
    page = Page(source)
    return [(page.tag[page.parent[i]], t) for i, t in enumerate(page.text) if t]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", []),
        ("just  text", [("body", "just text")]),
        ("<p>a<p>b</p>c", [("p", "a"), ("p", "b"), ("body", "c")]),
        ("<p><b>x<br><p>y", [("p", "x"), ("p", "y")]),
        ("<p>a<br>b\n <i>c</i>d&nbsp;e", [("p", "a b cd e")]),
        ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>", [("li", "1"), ("li", "2"), ("li", "3"), ("li", "4")]),
        ("<table><tr><td>1<td>2<tr><th>3</table>", [("td", "1"), ("td", "2"), ("th", "3")]),
        ("<dl><dt>a<dd>b<dt>c</dl>", [("dt", "a"), ("dd", "b"), ("dt", "c")]),
        ("<div>a</span></p></div>b", [("div", "a"), ("body", "b")]),
        ('<script>var t="</p>";if(a<b)</script>x<style>p{}</style><!-- <p>no</p> -->y', [("body", "xy")]),
        ("<SCRIPT>a</SCRIPT ><P>b</P>", [("p", "b")]),
        ("<script>never closed <p>x</p>", []),
        ("<p>a</p><!-- never closed <p>x</p>", [("p", "a")]),
        ('<p title="a > b" class=x>1 &lt; 2 &amp; &copy; &#233;&#x41; &am</p>', [("p", "1 < 2 & © éA &am")]),
        ("1 < 2 <3 a<b", [("body", "1 < 2 <3 a")]),
        ("<p title=\"open>a</p><p>b</p>", [("p", "a"), ("p", "b")]),
        ("<h1>a<h2>b</h1>c", [("h1", "a"), ("h2", "b"), ("body", "c")]),
        ("<select><option>a<option>b</select><textarea><p>x</textarea>c", [("body", "c")]),
        ("<a><div>x</div></a>y<hr>z", [("div", "x"), ("body", "y"), ("body", "z")]),
        ("<my-card>x</my-card>y", [("my-card", "x"), ("body", "y")]),
    ],
)
def test_runs(source, want):
    assert runs(source) == want


def test_long_and_deep_pages_take_linear_time():
    deep = "<div>" * 20_000 + "x" + "</span>" * 20_000 + "</div>" * 20_000
    assert runs(deep) == [("div", "x")]
    assert len(runs("<p>word</p>" * 50_000)) == 50_000
    assert runs("<a title='" * 20_000 + "x") in ([], [("body", "x")])
    assert len(default_model().texts(["<article>" + "<p>one more line.</p>" * 20_000 + "</article>"])[0]) > 300_000


def expected(page):
    """Text of the article of a generated page, by its tags."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    pieces = [re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", p)) for p in re.split(r"</?(?:p|h1)>", article)]
    return "\n\n".join(t for p in pieces if (t := " ".join(html.unescape(p).split())))


def test_every_page_of_the_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    found = op13_main_text(spark, FOLDER).collect()
    assert len(found) == len(pages)
    for r in found:
        assert r.text == expected(pages[r.page_id].html)
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)


def test_layouts_it_has_not_seen():
    """Held-out pages of every kind, with and without telling names: share of characters right."""
    right = whole = 0
    for source in labelled_pages(280, seed=77):
        page = Page(source)
        known = [t for t, s in zip(page.text, states(page), strict=True) if t and s == CONTENT]
        text = default_model().texts([re.sub(r' label="\w+"', "", source)])[0].split("\n\n")
        same = sum(len(t) for t in known if t in text)
        right += 2 * same
        whole += sum(map(len, known)) + sum(map(len, text))
    assert right / whole > 0.93


PLAIN = """<html><body><div id="cookie-banner">This site uses cookies. <button>OK</button></div><header class="site-header"><a href="/">Daily</a></header>
<nav><a href="/a">News</a> <a href="/b">Sport</a></nav><main><article><h1>A title</h1><p>First paragraph of the story, with a comma.</p>
<div class="advert">Buy now!</div><ul><li>One point.</li><li>Another point.</li></ul><p>Last paragraph of the story.</p>
<section class="comments"><h3>Comments</h3><p>I liked this story, it was good.</p></section></article>
<aside class="sidebar"><h3>Related</h3><a href="/c">Other story</a></aside></main><form action="/subscribe"><p>Your address</p></form>
<footer>&copy; Daily. All rights reserved.</footer></body></html>"""


def test_parts_that_are_no_article():
    want = ["A title", "First paragraph of the story, with a comma.", "One point.", "Another point.", "Last paragraph of the story."]
    assert default_model().texts([PLAIN]) == ["\n\n".join(want)]
    assert default_model().texts([PLAIN.replace("<article>", '<div class="post-content">').replace("</article>", "</div>")]) == ["\n\n".join(want)]


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, label string"
    rows = [(1, "u", None, "a", "b", "c"), (2, None, "", "a", "b", "c"), (None, "u", PLAIN, "a", "b", "c"), (3, "u", PLAIN, "a", "b", "c"), (3, "u", PLAIN, "a", "b", "c"), (4, "u", "﻿<nav><a>x</a></nav>", "", "", "")]
    frame = spark.createDataFrame(rows, schema)
    found = main_texts(frame, F.col("page_id"), F.col("url"), F.col("html")).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r.page_id, []).append(r)
    assert by[1][0].text == "" == by[2][0].text and by[1][0].n_chars == 0
    assert by[3][0] == by[3][1] and by[3][0].text == by[None][0].text != ""
    assert main_texts(frame.limit(0), F.col("page_id"), F.col("url"), F.col("html")).count() == 0


def test_training_is_the_same_each_time():
    pages = list(labelled_pages(28))
    one, two = extraction.learn(pages, steps=5), extraction.learn(pages, steps=5)
    assert (one.weights == two.weights).all() and (one.pair == two.pair).all()
