"""Elements that may hold text of the article are parsed, not skipped."""

import pytest

pytest.importorskip("public_tokenizers")

from codeloom.llm import htmltree  # noqa: E402


def texts(page):
    return [t for _, t in htmltree.parse(page)[1]]


def test_holders_of_text_are_parsed():
    for tag in ("math", "object", "canvas", "noscript", "svg"):
        assert "kept" in " ".join(texts(f"<article><p>one</p><{tag}><p>kept</p></{tag}><p>two</p></article>"))
    assert texts("<div><p>one</p><xmp>a <b> & &amp; c</xmp><p>two</p></div>") == ["one", "a <b> & &amp; c", "two"]
    assert texts("<p>one</p><script>x</script><style>y</style><select><option>z</select><p>two</p>") == ["one", "two"]


def test_self_closed_and_unclosed_elements_swallow_nothing():
    assert texts("<p>one <svg class='i'/> two</p><p>three</p><svg><path d='M0'/></svg><p>four</p>") == ["one two", "three", "four"]
    assert texts("<p>one</p><math/><p>two</p>") == ["one", "two"]
    for tag in ("svg", "canvas", "object"):
        assert texts(f"<div><p>one</p><{tag}></div><p>two</p>") == ["one", "two"]


def test_formulas_and_icons_split_no_sentence():
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold. <svg><path d='M0'></path></svg>Then</p>") == ["Let x=1 hold. Then"]


def test_names_are_whole():
    page = "<div class='a b c d e f g h i j k l m' id='comments' role='navigation'>x</div>"
    assert {"m", "comments", "navigation"} <= set(htmltree.parse(page)[0][1].names)
