"""HTML extraction: what a reader sees of each construct."""

import time

import pytest

from parley.llm.rendering import extract_text, rendered

CASES = {
    "inline": ("a <b>b</b><i>c</i>\n  d&nbsp;&amp;&lt;", "a bc d\xa0&<"),
    "implied paragraphs": ("<p>one<p>two<div>three</div>four", "one\n\ntwo\n\nthree\nfour"),
    "unclosed bold": ("<p><b>x<br><p>y", "x\n\ny"),
    "breaks": ("a<br>b<br/><br>c", "a\nb\n\nc"),
    "lists": ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "* a\n* b\n  * c\n* d"),
    "numbers": ("<ol start=9><li>a<li>b</ol><ol type=i reversed><li>x<li>y</ol>", "9. a\n10. b\n\nii. x\ni. y"),
    "definitions": ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n    d1\n    d2"),
    "table": ("<table><tr><th>Name<th>N<tr><td>pear<td align=right>3<tr><td>fig</table>", "Name  N\npear  3\nfig"),
    "implied rows": ("<table><td>a<td>b</table>", "a  b"),
    "row span": ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    "column span": ("<table><tr><td colspan=2>wide cell<tr><td>a<td>b</table>", "wide cell\na  b"),
    "lines in cells": ("<table><tr><td>a<br>bb<td>c</table>", "a   c\nbb"),
    "nested table": ("<table><tr><td><table><tr><td>x<td>y</table><td>z</table>", "x  y  z"),
    "caption": ("<table><caption>Cap</caption><tr><td>a</table>", "Cap\na"),
    "hidden": ("a<script>x</script><style>y</style><span hidden>h</span><i style='display : none'>n</i>b", "ab"),
    "visibility": ("<p style='visibility:hidden'>a<b style='visibility:visible'>b</b>c</p>", "b"),
    "head": ("<head><title>t</title><meta charset=utf-8></head><body>x", "x"),
    "head closed by text": ("<head><title>t</title>x<p>y", "x\n\ny"),
    "details": ("<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>", "s\ns\nyes"),
    "pre": ("<pre>\n a  b\n\n  c</pre>d", " a  b\n\n  c\n\nd"),
    "quote": ("<blockquote>a<p>b</blockquote>c", "    a\n\n    b\n\nc"),
    "comment": ("a<!-- <p>x -->b<!-->c", "ab"),
    "attributes": ("<a title='a>b' href=\"x>y\">l</a>", "l"),
    "stray": ("a < b </div></p> <3 c", "a < b\n\n<3 c"),
    "textarea": ("<textarea><b>&amp;</textarea>", "<b>&"),
    "broken ends": ("<p>x<a href='", "x<a href='"),
    "select": ("<select><option>a<option>b</select>", "a\nb"),
    "headings": ("<h1>A<h2>B</h1>c", "A\n\nB\n\nc"),
    "outer list end": ("<ul><li><p>a</li><li>b</ul>", "* a\n* b"),
}


@pytest.mark.parametrize("name", list(CASES))
def test_construct(name):
    page, want = CASES[name]
    assert rendered(page).strip("\n") == want.strip("\n") or rendered(page) == want


@pytest.mark.parametrize(
    "page",
    ["<div>" * 20_000 + "x", "<table><tr><td>" * 3000 + "x", "<a \"" * 3000, "<p '" * 3000, "<" * 50_000, "<b>" * 5000 + "x" + "</b>" * 5000,
     "&amp" * 20_000, "<!--" * 5000, "<ul><li>" * 3000 + "x", "<td colspan=99999999>x"],
)
def test_broken_or_deep_pages_end_soon(page):
    start = time.process_time()
    assert isinstance(rendered(page), str)
    assert time.process_time() - start < 8


def test_table(spark):
    rows = [(1, "<p>a"), (1, "<p>a"), (None, None), (2, ""), (3, "<p>" + "word " * 100_000)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, html string, text string")
    found = sorted((str(r.page_id), r.text[:10]) for r in extract_text(df).collect())
    assert found == [("1", "a"), ("1", "a"), ("2", ""), ("3", "word word "), ("None", "")]
    assert extract_text(df.limit(0)).count() == 0


def test_words_of_real_pages_are_kept(spark):
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect():
        body = re.sub(r"(?is)<(script|style|title)\b.*?</\1>|<!--.*?-->", "", r.html)
        want = html.unescape(re.sub(r"<[^>]+>", " ", body)).split()
        got = [w for w in rendered(r.html).split() if w != "*"]
        assert "".join(got) == "".join(w for w in want if w != "*")


STRAY = {
    "form around rows": ("<table><tbody><form><tr><td>a<td>b<tr><td>c</form></table>", "a  b\nc"),
    "div behind a row": ("<table><tr><td>a</td></tr><div>note</div></table>", "note\na"),
    "link in a section": ("<table><thead><a href=x>l</a><tr><td>a<td>b</table>", "l\na  b"),
    "text and rows in an element": ("<table><tbody><div>n <b>m</b><tr><td>a<td>b</tr>o</div></table>", "n\nm\no\na  b"),
    "list in a section": ("<table><tbody><ul><li>x</ul><tr><td>a</table>", "* x\na"),
    "table in a section": ("<table><tr><td>a</tr><table><tr><td>x<td>y</table></table>", "x  y\na"),
    "hidden in a section": ("<table><tbody><div hidden><tr><td>x</tr></div><script>y</script><tr><td>a</table>", "a"),
    "unseen in a section": ("<table><tbody><div style='visibility:hidden'>n<tr><td>x</tr></div><tr><td>a</table>", "a"),
}


@pytest.mark.parametrize("name", list(STRAY))
def test_what_stands_in_a_table_is_kept(name):
    page, want = STRAY[name]
    assert rendered(page) == want


@pytest.mark.parametrize("outer", ["<table><tr><td>", "<table>", "<div>", "<table><tbody><form>", "<ul><li>", "<table><tbody><tr><td><div>"])
@pytest.mark.parametrize("more", [0, 1, 2, 3, 4])
def test_text_of_deep_pages_is_whole(outer, more):
    inner = "w0<table> w1<tr><td> w2<td> w3<tr><th> w4</table> w5<p> w6<table><tbody><form><tr><td> w7</td></tr> w8</form></table> w9"
    for times in (30, 49, 50, 66, 67, 99, 100, 198, 199, 200, 1000):
        got = rendered("<div>" * more + outer * times + inner)
        assert sorted(w for w in got.split() if w != "*") == [f"w{i}" for i in range(10)], times


def test_text_of_random_tables_is_whole():
    import random

    rng = random.Random(5)
    tags = "table table tbody thead tr tr td td th form div a b p ul li caption span".split()
    for _ in range(3000):
        words, page = 0, "<div>" * rng.choice([0, 0, 180, 195])
        for _ in range(rng.randint(1, 25)):
            tag = rng.choice(tags)
            page += rng.choice([f"<{tag}>", f"<{tag}>", f"</{tag}>"])
            if rng.random() < 0.7:
                page += f" w{words} "
                words += 1
        got = [w for w in rendered(page).replace("*", " ").split()]
        assert sorted(got) == sorted(f"w{i}" for i in range(words)), page


QUOTED = {
    "blanks around =": ('<a title = "x > y">link</a>', "link"),
    "single quotes and blanks": ("<a title =\n'x > y' b= \"p>q\">link</a>", "link"),
    "a quote that never ends": ('<p title="x>one</p><p>two', "one\n\ntwo"),
    "a tag that never ends": ("a <b>c</b> <d e", "a c <d e"),
    "quotes without an end of the tag": ("<i>a</i> <b c=\"x <i>y</i>\" z", "a y\" z"),
    "a comment behind it": ("one <a two <!-- three", "one <a two"),
    "no tag": ("1 < 2 <3 <", "1 < 2 <3 <"),
    "a span beside a cell": ("<table><tr><td>a<td colspan=2>wide<tr><td>b<td colspan=2>c</table>", "a  wide\nb  c"),
    "rows spanned twice": ("<table><tr><td rowspan=3>a<td rowspan=2>b<td>c<tr><td>d<tr><td>e<td>f</table>", "a  b  c\n      d\n   e  f"),
}


@pytest.mark.parametrize("name", list(QUOTED))
def test_tags_and_spans(name):
    page, want = QUOTED[name]
    assert rendered(page) == want


@pytest.mark.parametrize(
    "page",
    ["<a " * 100_000, '<a b="c ' * 100_000, "<a b='c " * 100_001, "<a b = " * 100_000, "<a b=\" c=' " * 60_000, "</a " * 100_000, "<!" * 100_000,
     "<!-- " * 50_000, "<a" * 100_000, "<i>x</i> <a b=\"" * 20_000, "<textarea>" * 30_000, "<a" + " " * 200_000 + "b>x",
     "<table>" + ("<tr>" + "<td colspan=1000>x" * 20) * 100, "<table><tr>" + "<td rowspan=1000>x" * 2000 + "<tr><td>y" * 900,
     "<table><tr>" + "<td>x" * 20_000, "<table><tr><td>" + "<br>a" * 10_000 + "<td>b" * 5000],
)
def test_time_and_length_follow_the_page(page):
    start = time.perf_counter()
    got = rendered(page)
    assert time.perf_counter() - start < 4 and len(got) < 10 * len(page)


def test_blanks_are_bounded():
    long = "long words " * 9000
    page = f"<table><tr><td>{long}<td>b" + "<tr><td>short<td>c" * 500 + "</table>"
    got = rendered(page).split("\n")
    assert got[0] == long + " b" and got[1:] == ["short  c"] * 500
    wide = "<table><tr>" + "".join(f"<td>{'x' * 70}{i}" for i in range(50)) + ("<tr><td colspan=40>l<td>m" + "<tr><td align=right colspan=45>r") * 400
    assert len(rendered(wide)) < 10 * len(wide)
    deep = "<blockquote>" * 190 + "a<br>" * 20_000
    assert len(rendered(deep)) < 20 * len(deep) and rendered(deep).split() == ["a"] * 20_000


def test_table_against_a_plain_renderer():
    """Tables of words without spans: columns as wide as their widest word, two blanks between them."""
    import random

    rng = random.Random(3)
    for _ in range(300):
        rows = [["".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(1, 8))]
        width = [max((len(r[c]) for r in rows if c < len(r)), default=0) for c in range(6)]
        want = "\n".join("  ".join(w.ljust(width[c]) for c, w in enumerate(r)).rstrip() for r in rows)
        assert rendered("<table>" + "".join("<tr>" + "".join(f"<td>{w}" for w in r) for r in rows)) == want
