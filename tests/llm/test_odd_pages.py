"""Pages with marked sections, open heads and a form around everything."""

import random

import pytest

from parcelscope.llm import html_extract

TEXT = "A long first paragraph, with commas, that says what the page is about.\n\nA second one, as long as the first, which says more about it."
BODY = "".join(f"<p>{p}</p>" for p in TEXT.split("\n\n"))
SEARCH = "<form action=/find><p>Search this site for a word</p><input name=q></form>"


@pytest.mark.parametrize("page", [
    f"<html><body><![foo bar]>{BODY}</body></html>",
    f"<html><body>{BODY}<![if IE]><![endif]></body></html>",
    f"<html><head><title>T</title><meta name=a>{BODY}",
    f"<html><head><title>T</title><div>{BODY}</div></html>",
    f"<html><body><form id=aspnetForm><div>{BODY}</div></form></body></html>",
    f"<html><body>{SEARCH}<div>{BODY}</div>{SEARCH}</body></html>",
])
def test_main_text(page):
    assert html_extract.main_text(page) == TEXT


def test_no_markup_fails():
    rng = random.Random(4)
    pieces = ["<![", "<!", "]>", "]]>", "<!--", "-->", "<?", "<![CDATA[", "<form>", "</form>", "<head>", "</p>", "<p>", "text, more", "&#x;", "&amp", "<", ">",
              "<table>", "<td", " a=b>", "</", "<!DOCTYPE", "<script>", "</script>", "<![temp[", "<![ x"]
    for _ in range(3000):
        assert isinstance(html_extract.main_text("".join(rng.choices(pieces, k=rng.randrange(1, 14)))), str)
