"""Markdown as blocks and text, by examples in the manner of the public specification; hostile texts in linear time."""

import time

import pytest

from lakeseek.functions import commonmark as M

TEXTS = [
    ("\tfoo\tbaz", "foo baz"), ("- `one\n- two`", "`one\n\ntwo`"), ("***\n---\n___\ntext", "text"), ("# foo #", "foo"), ("#5 bolt\n\n#hashtag", "#5 bolt\n\n#hashtag"), ("\\## foo", "## foo"), ("# foo *bar* \\*baz\\*", "foo bar *baz*"),
    ("Foo *bar*\n=========", "Foo bar"), ("Foo\nbar\n---", "Foo\nbar"), ("`Foo\n----\n`", "`Foo\n\n`"), ("    a simple\n      code block", "a simple\n  code block"), ("Foo\n    bar", "Foo\nbar"), ("```\n<\n >\n```", "<\n >"), ("~~~~\naaa\n~~~\n~~~~", "aaa\n~~~"), ("```\naaa", "aaa"),
    ("<div>\n*foo*\n</div>\n\n*bar*", "bar"), ("<!-- a\n\nb -->\nok", "ok"), ('[foo]: /url "title"\n\n[foo]', "foo"), ("[FOO]: /url\n\n[Foo] and [bar]", "Foo and [bar]"), ("[foo]: /url\nbar\n===\n[foo]", "bar\n\nfoo"),
    ("> # Foo\n> bar\n> baz", "Foo\n\nbar\nbaz"), ("> bar\nbaz\n> foo", "bar\nbaz\nfoo"), ("> ```\naaa", "aaa"), (">>> foo", "foo"), ("1.  A paragraph\n    with two lines.\n\n        indented code\n\n    > A block quote.", "A paragraph\nwith two lines.\n\nindented code\n\nA block quote."),
    ("- one\n\n two", "one\n\ntwo"), ("- foo\n\n  bar", "foo\n\nbar"), ("- foo\n  - bar\n    - baz", "foo\n\nbar\n\nbaz"), ("-one\n\n2.two", "-one\n\n2.two"), ("The number is\n14.  doors", "The number is\n14.  doors"), ("- a\n- b\n\n- c", "a\n\nb\n\nc"), ("- foo\n+ bar", "foo\n\nbar"),
    ("&nbsp; &amp; &copy; &#35; &nosuch;", "& © # &nosuch;"), ("`foo`", "foo"), ("`` foo ` bar ``", "foo ` bar"), ("*foo bar*", "foo bar"), ("a * foo bar*", "a * foo bar*"), ("foo*bar*", "foobar"), ("_foo bar_", "foo bar"), ("foo_bar_", "foo_bar_"), ("snake_case_name", "snake_case_name"),
    ("**foo bar**", "foo bar"), ("*foo**bar**baz*", "foobarbaz"), ("***foo** bar*", "foo bar"), ("**foo*", "*foo"), ("*foo _bar* baz_", "foo _bar baz_"), ("2*3*4", "234"), ("5 * 6 * 7", "5 * 6 * 7"),
    ('[link](/uri "title")', "link"), ("[link](<foo bar>)", "link"), ("[link](/my uri)", "[link](/my uri)"), ("[a](b) and [c]", "a and [c]"), ("![foo](/url) x", "x"), ("[![moon](moon.jpg)](/uri) y", "y"), ("*[foo*](/uri)", "*foo*"),
    ("<http://foo.bar.baz>", "http://foo.bar.baz"), ("a <b>bold</b> c", "a bold c"), ("3 < 4 > 2", "3 < 4 > 2"), ("foo  \nbar\\\nbaz", "foo\nbar\nbaz"), ("", ""), (None, ""),
]


@pytest.mark.parametrize(("md", "want"), TEXTS)
def test_text(md, want):
    assert M.text(md).replace(" ", " ").strip() == want


def test_blocks_nest():
    found, _ = M.blocks("1. a\n   - b\n\n     > c\n2. d\n\n# e")
    assert [b.kind for b in found] == ["list", "heading"] and [b.kind for b in found[0].inner] == ["item", "item"]
    assert [b.kind for b in found[0].inner[0].inner] == ["paragraph", "list"] and [b.kind for b in found[0].inner[0].inner[1].inner[0].inner] == ["paragraph", "quote"]


def test_sections_by_any_heading():
    md = "before\n\nOne *two*\n===\nbody\n\n    # code\n\n> ## In a quote\n> said\n\n```\n# no heading\n```\n### Three ###"
    assert M.sections(md) == [(0, "", "before"), (1, "One two", "body\n\n# code"), (2, "In a quote", "said\n\n# no heading"), (3, "Three", "")]
    assert M.sections(None) == [] and M.sections("  \n") == []


@pytest.mark.parametrize("hostile", ["*a _b " * 20_000, "[" * 50_000, "![[](" * 20_000, "`" * 5 + "` a `` b ``` " * 8_000, "> " * 3_000 + "x", "- " * 2_000 + "x", "<" * 50_000, "a\n" * 50_000, "- a\n\n" * 20_000, "[a]: b\n" * 20_000, "> a\nb\n" * 20_000, "&" * 50_000, "**a" * 20_000, "(" * 50_000 + "[a](" * 5_000])
def test_hostile_texts_end(hostile):
    began = time.perf_counter()
    M.text(hostile)
    assert time.perf_counter() - began < 20
