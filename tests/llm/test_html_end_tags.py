"""Pages without an article and with end tags left out."""

import pytest

html_extract = pytest.importorskip("cellgauge.llm.html_extract")

TEXT = "whole text of the page in one long line, as it would be written"
MENU = "<ul><li><a href=/>Home</a><li><a href=/a>About</a></ul>"


@pytest.mark.parametrize(
    "html",
    [
        "<html><head><title>T</title><body><p>{}</p></body></html>",
        "<html><head><title>T</title><meta charset=utf-8><p>{}</p></html>",
        "<head><title>T</title><style>p{{}}</style>{}",
        "<head><title>T</title></head><body><nav>" + MENU + "<div><p>{}</p></div></body>",
        "<head><body><form><input><p>{}</p>",
        "<body><aside><p><a>x</a></p><div><p>{}</p></div></body>",
        "<html class='no-js menu'><body class='nav-open sidebar'><p>{}</p></body></html>",
        "<head><title>T</title></head><body><nav>" + MENU + "</nav><p>{}</p><footer><p>Mail</p></footer></body>",
    ],
)
def test_text_is_kept(html):
    assert html_extract.main_text(html_extract.Lines(), html.format(TEXT)) == TEXT


def test_closed_elements_still_hide():
    page = "<head><title>T</title><body><nav><p>" + TEXT + "</p></nav><p>body text that is long enough to stay</p></body>"
    assert html_extract.main_text(html_extract.Lines(), page) == "body text that is long enough to stay"
