"""Whole blocks and deep pages."""

from marlstone.llm import html_extract


def test_every_word_of_a_block_is_read():
    one = html_extract.features([((("p", 1),), "word " * 500 + "last", 0)])[0][1]
    assert len(one) == 501 and one[-1] != one[0]


def test_nesting_costs_nothing_and_pages_of_any_depth_are_read():
    blocks = html_extract.leaf_blocks("<div>x" * 40_000)
    assert len(blocks) == 40_000 and blocks[-1][0] == (("div", 40_000),)
    found = html_extract.extract(["<article>" + "<div>some text here. " * 2000 + "</article>"], html_extract.trained_labeller())
    assert len(found) == 1


def test_paths_shrink_when_elements_close():
    got = html_extract.leaf_blocks("<div class='a b'><div class=a>x</div>y</div><p>z")
    assert [dict(b[0]) for b in got] == [{"div": 2, ".a": 2, ".b": 1}, {"div": 1, ".a": 1, ".b": 1}, {"p": 1}]
