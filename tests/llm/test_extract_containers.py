"""Containers round the whole page, and elements left open, don't hide the article."""

import pytest

from demandgrid.llm.extract import main_text

TEXT = "The river, the stone and the green tree stood by the house for many years, as people of the town say today."
ARTICLE = "".join(f"<p>{i} {TEXT}</p>" for i in range(4))


@pytest.mark.parametrize("page", [
    "<form>{}</form>", '<div class="has-sidebar">{}</div>', '<div class="no-sidebar"><div>{}</div></div><div>Copyright</div>',
    '<div id="with-menu">{}</div>', '<div class="widget">{}</div>', '<div class="comments">{}</div>'])
def test_containers_round_the_page(page):
    assert main_text(f"<html><body>{page.format(ARTICLE)}</body></html>").count(TEXT) == 4


@pytest.mark.parametrize("tag", ["object", "video", "audio", "canvas", "math", "svg"])
@pytest.mark.parametrize("end", ["", "/"])
def test_elements_left_open(tag, end):
    assert main_text(f"<body><div><{tag} class='x'{end}>{ARTICLE}</div></body>").count(TEXT) == 4


def test_named_parts_still_go():
    page = f'<div class="sidebar"><p>aside {TEXT}</p></div><div>{ARTICLE}</div><form><p>join us</p></form><div class="comments"><p>{TEXT}</p></div>'
    assert main_text(page).count(TEXT) == 4 and "join us" not in main_text(page)
    assert "left out" not in main_text(f"<div hidden><p>left out {TEXT * 9}</p></div><div>{ARTICLE}</div>")
