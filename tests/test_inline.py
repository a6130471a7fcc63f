"""Inline marks: cases of the format by name, any text without failing, time in proportion."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.operators import chunking as C
from millrace.operators import links as L
from millrace.operators.inline import definitions, inline

KNOWN = {"r": "r.png", "two words": "t.png", "ss": "s.png"}


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("*a* **b** ***c*** ~~d~~ ~e~ ~~~f~~~", "a b c d e ~~~f~~~"),
        ("a * b * c _ d _", "a * b * c _ d _"),
        ("snake_case_name and _under_", "snake_case_name and under"),
        ("foo*bar*baz foo_bar_baz", "foobarbaz foo_bar_baz"),
        ("**a*", "*a"),
        ("*a**", "a*"),
        ("*a **b* c**", "a b c"),
        ("*foo**bar*", "foo**bar"),
        ("***a** b*", "a b"),
        ('*(**a**)* a*"b"*', '(a) a*"b"*'),
        ("`a*b*` ``c`d`` ` e ` `` ` ``", "a*b* c`d e `"),
        ("`` open ` shut", "`` open ` shut"),
        ("*a `b*` c", "*a b* c"),
        (r"\*a\* \[b\](c) \x", r"*a* [b](c) \x"),
        ("[a](b) [c](<d e> 'f') [g](h(i)j) [k](l m)", "a c g [k](l m)"),
        ("[a [b](c) d](e)", "[a b d](e)"),
        ("![a [b](c) d](e)", "a b d"),
        ("[![a](b)](c)", "a"),
        ("[r] [R][] [x][r] [x] [x][y] [two\nwords] [ß]", "r R x [x] [x][y] two words ß"),
        ("*[a*](b)", "*a*"),
        ("[a](b *c) d*", "[a](b c) d"),
        ("<b c='>'>d</b> <!-- e > --> <?f?> <g <h@i.j> <https://k>", "d   <g h@i.j https://k"),
        ("![", "!["),
        ("a  \nb\\\nc", "a   b c"),
        ("", ""),
    ],
)
def test_words(text, words):
    assert inline(text, KNOWN).words == words


def test_images_and_tags_in_order():
    read = inline("![*a* `b`](x.png \"t\") ![r] ![c][Two  Words] ![no][nowhere] `![d](e)` <img src='i.png'> \\![f](g) ![](<h i.png>) [![j](k_(l).png)](m)", KNOWN)
    assert [x[:2] for x in read.images] == [("x.png", "a b"), ("r.png", "r"), ("t.png", "c"), ("<h i.png>", ""), ("k_(l).png", "j")]
    assert [tag for tag, _ in read.tags] == ["<img src='i.png'>"]
    assert [x[:2] for x in inline("![a ![b](c) d](e)").images] == [("e", "a b d"), ("c", "b")]


def test_definitions():
    assert list(definitions("[a]: b\n[ C  d ]: <e f> 'g'\n[h]:\n  i\n  \"j\nk\"\n[l]: m \"n\" o\ntext")) == [("a", "b"), ("c d", "<e f>"), ("h", "i")]
    assert list(definitions("text\n[a]: b")) == [] == list(definitions("[ ]: b"))


def test_references_of_a_text():
    text = "# Of [A][r] and [b]\n\n![x][r] ![r] ![q] ![code] ![late]\n\n[r]: one.png\n[R]: two.png\n\n> [q]: quoted.png\n\n```\n[code]: no.png\n```\n\nwords\n[late]: no.png\n\n- an item ![l](l.png)\n  - # head ![deep](deep.png)\n\n        ![no](no.png)\n  1. ```\n     ![no](no.png)\n     ```\n     > <img alt='t' src='tag.png'> ![after](after.png)\n"
    assert L.images(text) == [(to, alt, "Of A and [b]", 0) for to, alt in [("one.png", "x"), ("one.png", "r"), ("quoted.png", "q"), ("l.png", "l"), ("deep.png", "deep"), ("tag.png", "t"), ("after.png", "after")]]
    assert C.markdown_sections(text)[0][0] == "Of A and [b]"


def test_images_side_by_side_with_front_matter():
    assert L.images("---\na: ![no](no.png)\n---\n![a](a.png)![b](b.png)\n") == [("a.png", "a", "", 0), ("b.png", "b", "", 0)]


@settings(max_examples=300, deadline=None)
@given(st.text("ab *_~`[]()!<>\\\n\"'r-&", max_size=60))
def test_any_text(text):
    read = inline(text, KNOWN)
    assert len(read.words) <= len(text)
    assert set(read.words) <= set(text) | {" "}
    assert all(0 <= at < len(text) for *_, at in read.images + read.tags)
    C.markdown_sections(text)
    L.images(text)


@pytest.mark.parametrize(
    "unit",
    ["[", "![", "[a](", "[a](b", "[a](<b", '[a](b "', "[a][", "[r]", "*a", "*a_b~~c", "a**b*", "*", "_a ", "`", "`` ` ", "<!--", "<?", "<a ", '<a b="', "<a b='\" ", "<![CDATA[", "![a](b)", "[ [a](b) ", "((", "[x](((", "\\", "]", "> ", "- ", "1. > ", "[a]: b\n"],
)
def test_time_in_proportion(unit):
    text = unit * (100_000 // len(unit))
    began = time.time()
    inline(text, KNOWN)
    inline(text + "]" * 50_000, KNOWN)
    L.images("![x](y) " + text)
    L.images("> [r]: s\n" + text)
    assert time.time() - began < 10
