"""Hostile pages in linear time, marginals against enumeration, pages written by hand, and edge cases."""

import itertools
import math
import random
import time

import pytest

from codeloom.llm import htmltree


@pytest.fixture(scope="module")
def model():
    return htmltree.train(htmltree.labelled_pages())


HOSTILE = ["<a x=\"'" * 150_000, "<a " * 300_000, "<div>" * 20_000 + "</span>" * 150_000, "<div>" * 20_000 + "</p>" * 150_000, "<!x" * 300_000, "<script/>" * 100_000, "<script/></script" * 60_000, "<svg>" * 20_000 + "<g>" * 100_000, "<p><button>" + "<b>" * 50_000 + "<hr>" * 100_000, "<td><table>" + "<div>" * 20_000 + "<td></td>" * 80_000, "<" * 1_000_000, "&" * 1_000_000, "<a " + "= " * 400_000, "<!--" * 200_000, '<p title="x' * 80_000, "<xmp>" * 100_000]


def test_a_megabyte_of_broken_markup_takes_seconds(model):
    for page in HOSTILE:
        began = time.process_time()
        htmltree.extract(page, model)
        assert time.process_time() - began < 15, page[:30]


def texts(page):
    return [t for _, t in htmltree.parse(page)[1]]


def test_where_tags_end():
    assert texts("<p title=it's>Hello there.</p>") == ["Hello there."]
    assert texts("<p title='a > b' data-x=\"<p>\">one</p><p a=b>two") == ["one", "two"]
    assert texts("<p title=\"never closed>one</p><p>two</p>") == ["one", "two"]
    assert texts("a < b and c<3 &lt; d <!-- <p>no</p> --> e<!doctype x> f <p>g<p") == ["a < b and c<3 < d e f", "g"]
    assert texts("") == [] and texts("<") == ["<"] and texts("<p") == []


def test_marginals_equal_enumeration():
    r = random.Random(3)
    edge = [[[r.uniform(-2, 2) for _ in range(2)] for _ in range(2)] for _ in range(2)]
    for _ in range(30):
        nodes = [htmltree.Node("#root", -1, (), False, None, 0)]
        for i in range(1, r.randint(2, 8)):
            p = r.randrange(i)
            nodes.append(htmltree.Node(r.choice(["p", "div"]), p, (f"n{i}",), False, None, nodes[p].depth + 1))
        model = htmltree.Model({f"name=n{i}": r.uniform(-3, 3) for i in range(9)}, edge)
        total, on = 0.0, [0.0] * len(nodes)
        for labels in itertools.product((0, 1), repeat=len(nodes)):
            weight = math.exp(sum(model.unary(x) * y for x, y in zip(nodes, labels)) + sum(edge[htmltree.kind_of(x)][labels[x.parent]][labels[i]] for i, x in enumerate(nodes) if i))
            total += weight
            on = [a + weight * y for a, y in zip(on, labels)]
        assert model.marginals(nodes) == pytest.approx([a / total for a in on])


#: Pages in the manner of several publishing systems, by hand, with their main text.
BY_HAND = [
    (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><div id='site-header'><a href='/'>Home</a> <a href='/news'>News</a></div>"
        "<nav class='main-nav'><ul><li><a href='/a'>Alpha</a></li><li><a href='/b'>Beta</a></li></ul></nav>"
        "<article><h1>Rivers rise</h1><p>The river rose by two metres, officials said.</p><p>Roads are closed &amp; schools too.</p><blockquote>We were lucky, she said.</blockquote></article>"
        "<aside class='sidebar'><h3>Most read</h3><ul><li><a href='/1'>One</a></li><li><a href='/2'>Two</a></li></ul></aside><footer><p>Copyright 2020 The Paper</p></footer></body></html>",
        "Rivers rise\nThe river rose by two metres, officials said.\nRoads are closed & schools too.\nWe were lucky, she said.",
    ),
    (
        "<body><div class='cookie-banner'><p>We use cookies.</p><button>Accept</button></div><div class='entry-content'><h1>Bread</h1><p>Mix flour, water and salt.</p>"
        "<ul><li>500 g flour</li><li>350 g water</li></ul><p>Bake for an hour.</p></div><div id='comments'><h2>Comments</h2><div class='comment'><p>Great recipe!</p></div></div></body>",
        "Bread\nMix flour, water and salt.\n500 g flour\n350 g water\nBake for an hour.",
    ),
    (
        "<body><main><section class='article'><h2>Results</h2><p>The trial had 120 patients. Half of them got better.</p><div class='advert'><a href='x'>Buy now</a></div>"
        "<p>More work is needed, the authors write.</p><table><tr><th>Group</th><th>Better</th></tr><tr><td>A</td><td>61</td></tr></table></section></main>"
        "<div class='footer'><a href='/imprint'>Imprint</a></div></body>",
        "Results\nThe trial had 120 patients. Half of them got better.\nMore work is needed, the authors write.\nGroup\nBetter\nA\n61",
    ),
]


def test_pages_by_hand(model):
    for page, want in BY_HAND:
        assert htmltree.extract(page, model) == want


def test_edges(spark, model):
    schema = "page_id long, url string, html string, text string, n_chars long"
    assert htmltree.main_text(spark.createDataFrame([], schema), model).count() == 0
    long = "<article>" + "".join(f"<p>Sentence number {i}, of many.</p>" for i in range(60_000)) + "</article>"
    got = htmltree.main_text(spark.createDataFrame([(1, "u", long, "x", 1), (1, "u", long, "x", 1), (None, None, None, None, None)], schema), model).collect()
    assert [r["text"].count("\n") for r in got if r["page_id"]] == [59_999] * 2
    assert [(r["text"], r["n_chars"]) for r in got if r["page_id"] is None] == [("", 0)]


#: Pages without a name on any element, with what must stay and what must not.
NAMELESS = [
    ("<html><body><div><a href='/'>Home</a> <a href='/n'>News</a> <a href='/a'>About</a></div><div><p>The council met on Monday to discuss the new bridge. It will be built next year, the mayor said.</p></div><div><p>Great article, thanks!</p></div></body></html>", "The council met on Monday to discuss the new bridge. It will be built next year, the mayor said.", "News"),
    ("<div class='content'>" + "".join(f"<p>word{i} two.</p>" for i in range(200)) + "</div>", "\n".join(f"word{i} two." for i in range(200)), "nothing"),
    ("<div><div><a href=1>First</a><a href=2>Other</a></div><div><h1>Title here</h1>The article has one sentence only. And a second one, longer than that.</div></div>", "Title here\nThe article has one sentence only. And a second one, longer than that.", "Other"),
    ("<p>Only a line.</p>", "Only a line.", "nothing"),
    ("<body><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul><div><p>Short.</p><p>Words here.</p></div></body>", "Short.\nWords here.", "One"),
    ("<table><tr><td><a href=a>Index</a><br><a href=b>Back</a></td><td><p>A page laid out by a table, as they were once. It holds a paragraph.</p></td></tr></table>", "A page laid out by a table, as they were once. It holds a paragraph.", "Index"),
]


def test_pages_without_names(model):
    for page, want, gone in NAMELESS:
        found = htmltree.extract(page, model)
        assert want in found, page[:80]
        assert gone not in found, page[:80]


def test_query_columns(spark, model, monkeypatch, tmp_path):
    monkeypatch.setattr(htmltree, "train", lambda _: model)
    spark.createDataFrame([(1, "u", NAMELESS[0][0]), (2, None, None), (None, "v", "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = htmltree.op5_html_text(spark, str(tmp_path))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = {r["url"]: (r["page_id"], r["text"], r["n_chars"]) for r in found.collect()}
    assert got[None] == (2, "", 0) and got["v"] == (None, "", 0) and NAMELESS[0][1] in got["u"][1] and got["u"][2] == len(got["u"][1])
