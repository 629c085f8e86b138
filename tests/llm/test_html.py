from __future__ import annotations

import os
import re

import pytest

from quarry.llm.html import extract, texts

CASES = {
    "<p>One <b>two</b>\n three<p>Four": "One two three\n\nFour",
    "<div>a</div><div>b</div>": "a\nb",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<ul><li>x<li>y<ol><li>z<li>w</ol></ul>after": "- x\n- y\n  1. z\n  2. w\n\nafter",
    "<ol start=3><li>x<li>y</ol>": "3. x\n4. y",
    "<table><tr><td>a<td>bbb<tr><td>cc<td>d</table>": "a  | bbb\ncc | d",
    "<table><thead><tr><th>h</thead><tbody><tr><td>long cell</table>": "h\nlong cell",
    "<script>var a = '<p>no</p>';</script><style>p{}</style>yes<!-- no -->": "yes",
    "<p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p><p>yes</p>": "yes",
    "<head><title>no</title></head><body>yes</body>": "yes",
    "<pre>a  b\n  c</pre>": "a  b\n  c",
    "&lt;x&gt; &amp; &eacute; &nosuch; &#8364;": "<x> & é &nosuch; €",
    "<img alt='a picture'> <input type=hidden value=no><input type=submit value=Go>": "a picture Go",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\nd\nu\ne",
    "text <b>never closed": "text never closed",
    "</p></div>stray": "stray",
    "": "",
    "a < b and c > d": "a < b and c > d",
    "<a title=don't>hello it's me</a> after": "hello it's me after",
    "<p class=it's>seen text one</p><p>it's two</p><p>three</p>": "seen text one\n\nit's two\n\nthree",
    "<svg><title>no</title><text>label</text></svg> <math><mi>x</mi><mo>=</mo><mn>2</mn></math> <object>fallback</object>": "label x=2 fallback",
    "<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b></div>": "yes",
    "<div style='display:none'>no <b style='display:block; visibility: visible'>no</b></div>": "",
    "<dialog>no</dialog><dialog open>yes</dialog>": "yes",
    "<details>no<summary>yes</summary>no</details><details open>a<summary>b</summary></details>": "yes\na\nb",
    "<pre>a<br>b</pre>": "a\nb",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a | b\n  | c",
    "<table><tr><td>aa<td>bb<td>cc<tr><td colspan=2>x<td>y</table>": "aa | bb | cc\nx       | y",
    "<input value=shown><input type=password value=no><input type=hidden value=no>": "shown",
    "<head><title>no</title><p>yes": "yes",
    "<b><p>one</b> two</p>": "one two",
    '<a title="never closed>text</a> more': "text more",
    "<div/>a": "a",
}


@pytest.mark.parametrize("markup", CASES)
def test_layout(markup):
    assert extract(markup) == CASES[markup]


def test_all_visible_text_stays():
    words = [f"w{k}" for k in range(200)]
    tags = ["p", "div", "li", "td", "h1", "span", "b", "section"]
    markup = "".join(f"<{tags[k % 8]} class=x>{w}" + (f"</{tags[k % 8]}>" if k % 3 else "") + "\n" for k, w in enumerate(words))
    assert re.findall(r"w\d+", extract(markup)) == words


def test_deep_and_long():
    assert extract("<div>" * 5000 + "deep") == "deep"
    assert extract("<b>" * 20_000 + "x" + "</b>" * 20_000 + "y") == "xy"
    assert len(extract("<p>" + "word " * 200_000)) == 200_000 * 5 - 1
    assert extract("<" * 50_000).count("<") == 50_000
    assert extract("<a " + "x='" * 20_000 + "<p>z") is not None


def test_rows_nulls_and_empty(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    df = spark.createDataFrame([(1, None, None, "a", 1), (2, "u", "", "a", 1), (None, "u", "<p>x", None, None), (2, "u", "", "a", 1)], schema)
    rows = sorted((r.page_id or 0, r.text) for r in texts(df).collect())
    assert rows == [(0, "x"), (1, ""), (2, ""), (2, "")]
    assert texts(spark.createDataFrame([], schema)).collect() == []


def shown(markup):
    """Words that show, by the standard library's parser: another reading of the same pages, with no layout."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        CDATA_CONTENT_ELEMENTS = ("script", "style")

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.hidden, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("head", "script", "style", "template", "noscript")
            if tag in ("p", "li", "br", "div", "h1", "ul", "nav", "article", "footer", "td"):
                self.out.append(" ")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("head", "script", "style", "template", "noscript")
            if tag in ("p", "li", "div", "h1", "ul", "nav", "article", "footer", "td"):
                self.out.append(" ")

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data)

    w = Words()
    w.feed(markup)
    w.close()
    return "".join(w.out).split()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the supplied tables")
def test_words_of_all_pages_equal_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in texts(pages).collect()}
    for r in pages.collect():
        assert [w for w in got[r.page_id].split() if w != "-"] == [w for w in shown(r.html) if w != "-"]


def test_hidden_stays_hidden_at_any_depth():
    assert extract("<div>" * 1000 + "<div hidden>SECRET</div>shown") == "shown"
    assert extract("<table><tr><td>" * 2000 + "deep") == "deep"
    assert extract("<ul><li>" * 3000 + "deep").strip(" -") == "deep"
