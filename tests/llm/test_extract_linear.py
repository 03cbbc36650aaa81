"""Broken markup costs time in proportion to the page; parts of an article stay."""

import time

import pytest

from demandgrid.llm.extract import main_text

LONG = "This paragraph of the article is long enough to be taken for prose, with commas, and with words. " * 4


@pytest.mark.parametrize("unit", ["<script", '<a "', "<a ", "<", "<!--", "<svg>", "<b>", "<li>", "<div>", "<a '>", "</p", "<p class='", "<td><div>",
                                  "<li><ul>", '<a b="', "<!", "&amp", "<![CDATA[", "<x<", "<div><li></li>"])
def test_time_is_linear(unit):
    for tail in ("", ">", '">', "'>"):
        page = "<p>first words</p>" + unit * (300_000 // len(unit)) + tail
        start = time.process_time()
        main_text(page)
        assert time.process_time() - start < 6, (unit, tail)


def page(body):
    return f"<html><body><nav><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></nav>{body}<footer>Imprint</footer></body></html>"


def test_parts_of_an_article_stay():
    refs = "<ul><li><a href=a>Some book on rivers</a></li><li><a href=b>Another long book on stones</a></li></ul>"
    out = main_text(page(f"<article><p>{LONG}</p><h2>References</h2>{refs}</article>"))
    assert "Some book on rivers" in out and "Another long book" in out and "Home" not in out and "Imprint" not in out
    out = main_text(page(f"<main><section><p>{LONG}</p></section><section><p>Short end.</p></section></main>"))
    assert out.endswith("Short end.")
    out = main_text(page(f"<div><p>{LONG}</p><h2>Middle</h2><p>Short.</p><p>{LONG}</p></div>"))
    assert "Middle Short." in out
    out = main_text(page(f"<section><p>{LONG}</p></section><h2>Between</h2><p>Brief.</p><section><p>{LONG}</p></section>"))
    assert "Between Brief." in out and "Home" not in out
    for name in ("social-science", "teaser", "header-note-free related"):
        out = main_text(page(f'<article><p class="{name}">The lead of it.</p><p>{LONG}</p></article>'))
        assert out.startswith("The lead of it."), name
    out = main_text(page(f'<article><p>{LONG}</p><div class="main-nav"><a href=x>Next</a></div><div class="ad-box">Buy now</div>'
                         f'<div id="comments"><p>Nice, said a reader.</p></div></article>'))
    assert out == " ".join(LONG.split())


def test_quotes_and_deep_nesting():
    assert main_text("<div><p title='a > b'>One</p></div>") == "One"
    assert "Two" in main_text("<p title=\"open>Two words</p>")
    deep = "<div>" * 3_000 + f"<p>{LONG}</p>" + "</div>" * 3_000
    assert main_text(deep) == " ".join(LONG.split())
    assert main_text("5 < 6 and 7 > 3") == "5 < 6 and 7 > 3"
