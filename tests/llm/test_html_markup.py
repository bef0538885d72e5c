"""Pages made to be slow, and where tags end."""

import time

import pytest

from cueloom.llm.html_blocks import read_blocks


@pytest.mark.parametrize("tail", ["", "<p>" * 100_000, "</b>" * 100_000])
@pytest.mark.parametrize("unit", ['<a "', "<span>", "<b><div>", "<a <a", "</script ", "<p \"x' ", "<!", "</", "<svg><p>", "<a<", '<a"<a"', "<script>"])
def test_large_untidy_pages_end_in_time(unit, tail):
    page = unit * (500_000 // len(unit)) + tail
    began = time.process_time()
    read_blocks(page)
    assert time.process_time() - began < 8


@pytest.mark.parametrize(
    "page,texts",
    [
        ('<p class="a>b">one</p>', ["one"]),
        ("<p class='it\"s'>one <b title='>'>two</b></p>", ["one two"]),
        ('<p>one <a href="x>two</p><p>three', ["one two", "three"]),  # unclosed: left out up to the first >
        ('<p>one <a href="x', ["one"]),
        ("<p>one < two & 3 <4</p>", ["one < two & 3 <4"]),
        ("<p>one</ >two</p>", ["onetwo"]),
        ("one<!-- <p> -->two<!-- three", ["onetwo"]),
        ("one<script>if (a<b) '</p>'</script >two", ["onetwo"]),
        ('one<style media="</style>">x</style>two', ["onetwo"]),
        ("<b>one<div>two</b>three</div>", ["one", "twothree"]),
        ("<p>one<span>two<div>three", ["onetwo", "three"]),
        ('<p>one <f="/x">two', ["one", "two"]),
        ("", []),
        (None, []),
    ],
)
def test_where_tags_end(page, texts):
    assert [b.text for b in read_blocks(page)] == texts
