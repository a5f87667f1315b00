"""Odd pages take time in proportion to their length, and keep their text."""

import time

import pytest

from joinseek.llm.html_text import main_text

ODD = {
    "nested": ("<div>word " * 20_000, "word"),
    "open tags": ("<a " * 350_000, "<a <a"),
    "open quotes": ('<a href="x ' * 90_000, '<a href="x'),
    "quoted end": ("<p>text</p>" + "<a x " * 200_000 + '"> "', "text"),
    "unknown ends": ("<div>word</q>" * 20_000, "word"),
    "items": ("<div><li>word" * 20_000, "word"),
    "inline": ("<b>word" * 20_000 + "<div>more</div>word" * 2_000, "word"),
    "open comments": ("word<!-- x " * 100_000, "word"),
    "many blocks": ("<p>a, b</p>" * 50_000, "a, b"),
}


@pytest.mark.parametrize("name", ODD)
def test_time_grows_with_length(name):
    page, held = ODD[name]
    start = time.perf_counter()
    text = main_text(page)
    assert time.perf_counter() - start < 5
    assert held in text


def test_what_an_open_quote_leaves():
    assert main_text('<p>One <a href="x>two</a> three</p><p>four') == "One two three\nfour"
    assert main_text("<p>a < b and b > c</p>") == "a < b and b > c"
    assert main_text("<p>kept</p><!-- not kept") == "kept"
    assert main_text("<p>kept</p><!DOCTYPE") == "kept\n<!DOCTYPE"
