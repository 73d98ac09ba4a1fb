"""Marginals against all labelings, parsing, and main texts of real and composed pages."""

import html
import itertools
import re

import numpy as np
import time

import pytest

from haptrace.llm import catalog, html_tree

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    return html_tree.fit([])


def test_marginals_match_all_labelings():
    rng = np.random.default_rng(3)
    trees = [html_tree.parse(p) for p in ("<p>a<div><b>x</b><p>y</div>", "<ul><li>a<li>b</ul>t", "")]
    names: dict[str, int] = {}
    forest = html_tree.Forest(trees, names, grow=True)
    weights, pairs = rng.normal(size=len(names)), rng.normal(size=(html_tree.GROUP_COUNT * 2, 2, 2))
    found, both = forest.marginals(weights, pairs)
    own = np.bincount(forest.nodes, weights[forest.features], minlength=forest.size)
    at = 0
    for tree in trees:
        n = len(tree.parent)
        total, hit, pair = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for y in itertools.product((0, 1), repeat=n):
            score = sum(own[at + i] for i in range(n) if y[i]) + sum(pairs[forest.kind[at + i], y[tree.parent[i]], y[i]] for i in range(1, n))
            total += np.exp(score)
            hit += np.exp(score) * np.array(y)
            for i in range(1, n):
                pair[i, y[tree.parent[i]], y[i]] += np.exp(score)
        assert np.allclose(found[at: at + n], hit / total)
        assert np.allclose(both[at + 1: at + n], pair[1:] / total)
        at += n


def test_broken_markup_and_references():
    def leaves(page):
        return [t for t in html_tree.parse(page).leaf_text if t is not None]

    assert leaves("<p>a <b>b\n c</b>d<p>e&amp;f&nbsp;&eacute; &#x41;&#66;<br>g") == ["a b cd", "e&f é AB g"]
    assert leaves("x < y <3 <!-- no <p>no</p> --> z<!doctype html>") == ["x < y <3 z"]
    assert leaves("<script>var a='<p>no</p>';</script >yes<style>p{}</style><title>no</title>") == ["yes"]
    assert leaves("<head><title>no</title><meta x></head>a</div></p>b<ul><li>1<li>2<ul><li>3</ul><li>4</ul>") == ["a", "b", "1", "2", "3", "4"]
    assert leaves('<a title="x > y" href=\'q"\'>t</a><div\nclass="k">u') == ["t", "u"]
    assert leaves("<script>never ends <p>no") == [] and leaves(None) == leaves("") == []
    assert leaves("<div>" * 3000 + "deep" + "</div>" * 2000) == ["deep"]


def test_pages_of_other_makes(model):
    pages = [
        '<body><header><h1>Site name</h1><nav><a href=/>Home</a></nav></header><main><article><h1>Title here</h1><p>First part &amp; more text, with stuff.</p>'
        '<div class="ad">Buy now!</div><p>Short.</p><aside>Related stuff</aside></article><section id="comments"><h2>Comments</h2><p>Great article, I loved '
        'reading this.</p></section></main><div class="cookie-banner"><p>We use cookies to improve things.</p></div><footer>Copyright</footer></body>',
        '<div id="wrap"><div id="menu"><ul><li><a href=a>A</a><li><a href=b>B</a></ul></div><div id="main"><h2>Head</h2><div class="text">Some long text lies '
        'here, and it goes on for a while. It does not end.</div><p>Another one</p></div><div class="sidebar"><p>About the author: long text lies here.</p></div></div>',
        '<article>just text<p>x</p></article><form><p>Sign up for our newsletter, please.</p><input></form>', "<p>hello", "",
    ]
    assert html_tree.contents([html_tree.parse(p) for p in pages], model) == [
        "Title here First part & more text, with stuff. Short.", "Head Some long text lies here, and it goes on for a while. It does not end. Another one",
        "just text x", "hello", ""]


def test_unseen_composed_pages(model):
    trees, labels = html_tree.composed_examples(html_tree.composed_pages(150, seed=77))
    chance, _ = html_tree.Forest(trees, model.names).marginals(model.weights, model.pairs)
    leaf = np.array([t is not None for tree in trees for t in tree.leaf_text])
    assert np.mean(((chance >= 0.5) == np.array([y for ys in labels for y in ys]))[leaf]) > 0.985


def test_query_matches_the_articles(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = catalog.QUERIES["op2_html"](spark, SF).collect()
    assert {r["page_id"] for r in found} == set(pages)
    for r in found:
        inside = re.search(r"<article>(.*)</article>", pages[r["page_id"]]["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert r["text"] == " ".join(b for b in blocks if b) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_odd_rows(spark, model):
    pages = spark.createDataFrame([(1, None, None, 4), (1, "u", "", 4), (None, "v", "<article><p>Some words stand here.</article>" * 2, 4)], "page_id long, url string, html string, text int")
    found = {r["url"]: r for r in html_tree.extract(pages, model).collect()}
    assert found[None]["text"] == found["u"]["text"] == "" and found["v"]["text"] == "Some words stand here. Some words stand here."
    assert html_tree.extract(pages.limit(0), model).collect() == []
    assert html_tree.sample(pages.limit(0), "page_id", "html") == []


def leaves(page):
    return [t for t in html_tree.parse(page).leaf_text if t]


def test_broken_markup_loses_no_text():
    assert leaves("<p>one</p><p title=it's>two</p><p>don't</p><p>three</p>") == ["one", "two", "don't", "three"]
    assert leaves('<p><a href="x"">link</a> and more</p>') == ["link and more"]
    assert leaves('<p title = "a > b" class=c=d/e>text</p>') == ["text"]
    assert leaves("<p>a</p><svg/><p>b</p><svg><text>no</text></svg><p>c</p>") == ["a", "b", "c"]
    for tag in ("noscript", "select", "iframe", "svg"):
        assert leaves(f"<p>a</p><{tag}><p>b</p>") == ["a", "b"]
    for tag in ("script", "style", "template"):
        assert leaves(f"<p>a</p><{tag}>x <p>b</p>") == ["a"]
    assert leaves("<p>a</p> 1 < 2 and <b") == ["a", "1 < 2 and <b"]
    for comment in ("<!-- never ends <b", "<!-- a > b", "<!doctype x", "<!-- a --> <!-- b"):
        assert leaves(f"<p>a</p> rest {comment}") == ["a", "rest"]


@pytest.mark.parametrize("page", [
    "<a " * 350_000, "<div>" * 100_000 + "x", "</span>" * 150_000 + "x", "<select>" * 100_000 + "x", '<p title="' * 100_000, "<p>word</p>" * 90_000,
    "<b>" * 100_000 + "x", "<li>item" * 100_000,
])
def test_long_pages_take_linear_time(page):
    start = time.process_time()
    html_tree.parse(page)
    assert time.process_time() - start < 6
