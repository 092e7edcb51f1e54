"""Pages that no well-behaved site would send."""

import random

import pytest

from doseweave.llm.page_blocks import leaf_blocks


def texts(html):
    return [b[0] for b in leaf_blocks(html)]


@pytest.mark.parametrize("mark", ["<![foo[x]]>", "<![ x>", "<![if IE]>", "<![CDATA[a > b]]>", "<!>", "<!doctype>", "<?php x ?>"])
def test_marked_sections_are_comments(mark):
    assert texts(f"<p>one {mark}two</p><p>three</p>") == ["one two", "three"]


def test_cut_and_random_pages_never_fail():
    draw = random.Random(2)
    parts = ["<p>", "</p>", "<div class='a", "<![", "<!--", "-->", "]]>", "<!DOCTYPE", "&amp", "&#x", "&#99999999;", "<script>", "</", "<", ">", "text ", "<svg>", "\x00", "é", "<a href=", '"', "<![CDATA["]
    for _ in range(3000):
        page = "".join(draw.choice(parts) for _ in range(draw.randint(1, 25)))
        assert all(t.strip() for t in texts(page))


def test_formulae_and_pictures_stay_in_their_paragraph():
    assert texts("<p>sum <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["sum x=2 holds"]
    assert texts("<p>an <svg><title>t</title><path/></svg>icon <input> here</p>") == ["an icon here"]
    assert texts("<p>a</p><video src=x><p>b</p><p>c</p>") == ["a", "b", "c"]
    assert texts("<p>a <svg><g><p>b</p><noscript>seen</noscript>") == ["a", "b", "seen"]
