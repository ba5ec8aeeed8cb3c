"""The scanner of pages against patterns that say the same, and its time on broken pages."""

import random
import re
import time

import pytest

from lexivane.llm import html

ATTRIBUTES = r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*)"
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)" + ATTRIBUTES + r">|<[!?/][^>]*>")
RAW = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|title|svg)\b" + ATTRIBUTES.replace("((", "(?:(", 1) + r">.*?(?:</\1\s*>|\Z)", re.S | re.I
)
PIECES = ["<", ">", "</", "/", "'", '"', " ", "\n", "a", "b ", "p", "<p>", "</p>", "<script", "</script >", "<SCRIPT>", "<title>", "</title>", "<!--", "-->", "<!x", "=", "x", "<b c='1'>", "é", "<svg/>"]


def test_same_tags_and_raw_parts_as_the_patterns():
    random.seed(2)
    for _ in range(6000):
        text = "".join(random.choice(PIECES) for _ in range(random.randrange(1, 26)))
        assert html._without_raw(text) == RAW.sub(" ", text), text
        want = [(m.start(), m.end(), m[1] == "/" and m[2] is not None, m[2], m[3] or "") for m in TAG.finditer(text)]
        assert list(html._tags(text)) == want, text


@pytest.mark.parametrize(
    "page",
    [
        "<script " * 120_000,
        "<title " * 120_000 + "x",
        "<title>" * 120_000,
        "<div>" * 80_000 + "</p>" * 80_000,
        "<div>" * 80_000 + "<b>" * 80_000,
        "<a '" * 250_000 + ">",
        "<a" * 300_000 + " ' >",
        "<a \"'" * 150_000 + ">",
        "<" * 1_000_000 + ">",
        "<!--" * 250_000,
        "<p>" * 150_000 + "</p>" * 150_000,
    ],
    ids=range(11),
)
def test_a_megabyte_of_broken_page(page):
    started = time.process_time()
    html.blocks(page)
    assert time.process_time() - started < 8
