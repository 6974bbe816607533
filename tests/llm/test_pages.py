"""Main text of pages."""

from __future__ import annotations

import html
import random
import re
import time

import pytest

from evalspark.llm import wrappers
from evalspark.llm.common import table


def test_articles_of_the_given_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r for r in wrappers.extract(pages).collect()}
    assert len(got) == pages.count()
    for page in pages.collect():
        article = re.search(r"<article>(.*?)</article>", page.html, re.S).group(1)
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        lines = [" ".join(html.unescape(p).split()) for p in parts]
        text = "\n".join(x for x in lines if x)
        assert got[page.page_id].text == text and got[page.page_id].n_chars == len(text)


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("<p>a <b>b</b>&amp;<br>c\n d</p>", "a b& c d"),
        ("<p>one<p>two<ul><li>x<li>y</ul>", "one\ntwo\nx\ny"),
        ("<nav>n</nav><header>h</header><p>t</p><aside>s</aside><form>f</form><footer>f</footer>", "t"),
        ('<main><header><h1>T</h1></header><p>x</p><section id="comments"><p>c</p></section></main><p>out</p>', "T\nx"),
        ("<article><p>a < b</p><script>var x='</p>';</script><style>p{}</style><!-- no --></article>", "a < b"),
        ('<article>a<div class="cookie-notice">n</div><div class=sponsored>s</div>b</article>', "a\nb"),
        ("<article><p>cut of", "cut of"),
        ("</div></p>text", "text"),
        ("<div>" * 2000 + "deep" + "</div>" * 2000, "deep"),
        ("<p>" + "x " * 50_000, " ".join("x" * 50_000)),
        ("&lt;p&gt; &#233; &am", "<p> é &am"),
        ("<article><p>Let <math><mi>x</mi><mspace/><mo>=</mo><mn>2</mn></math> be.</p></article>", "Let x =2 be."),
        ("<p><math><semantics><mi>y</mi><annotation-xml>z</annotation-xml><annotation>\\y</annotation></semantics></math></p>", "y"),
        ("<div>" * 200 + "<p>a</p><nav>n</nav><p>b</p>" + "</div>" * 200 + "<p>c</p><footer>f</footer>", "a\nb\nc"),
        ("<div>" * 130 + "a" + "</div>" * 10 + "<aside>s</aside><p>b", "a\nb"),
    ],
)
def test_single_pages(page, text):
    assert wrappers.main_text(page, wrappers.page_expression(page)) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article class="post with-sidebar"><p>x</p><div class="ad">a</div></article><p>out</p>', "x"),
        ('<main class=has-header><p>x</p></main><p>out</p>', "x"),
        ('<div class="page no-sidebar"><article><p>x</p></article></div><p>out</p>', "x"),
        ('<form id=aspnet><main><p>x</p><form>f</form></main></form>', "x"),
        ('<div class="entry no-comments"><p>x</p></div><div class="comments">c</div>', "x"),
        ('<div id="content" class="related-work share"><p>x</p></div><nav>n</nav>', "x"),
        ('<div class="has-banner"><p>x</p></div><footer>f</footer>', "x"),
        ('<div class="comment-content">c</div><p>x</p>', "x"),
    ],
)
def test_marks_do_not_hide_the_article(page, text):
    assert wrappers.main_text(page, wrappers.page_expression(page)) == text


def test_wrapper_of_two_pages():
    a = wrappers.page_expression("<body><ul><li>1<li>2</ul><p>x</p></body>")
    b = wrappers.page_expression("<body><ul><li>1</ul><h2>t</h2><p>x</p><p>y</p></body>")
    assert wrappers.expression(wrappers.align(a, b)) == "body<ul<li<#>+> h2<#>? p<#>+>"
    c = wrappers.page_expression("<dl><dt>a<dd>b<dt>c<dd>d</dl>")
    assert wrappers.expression(c) == "dl<(dt<#> dd<#>)+>"


def test_lines_equal_on_all_pages_are_template(spark):
    def page(i, body):
        return f"<body><div class=x7>All rights reserved</div><div class=m><p>Home, <b>News</b></p></div>{body}<div>Printed</div></body>"

    rows = [(i, "http://a/x", page(i, f"<div><p>text {i}.<p>Join our list<p>more {i * i}</div>")) for i in range(6)]
    rows += [(i, "http://b/x", f"<article><p>own {i} <b>word</b>.</p><p><a href=x>Read more</a></p></article>") for i in range(6, 10)]
    rows += [(i, "http://c/x", page(0, f"<p>same</p><p>{i // 12}</p>")) for i in range(10, 14)]
    rows += [(i, "http://d/x", "<p>only</p>") for i in range(14, 18)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == f"text {i}.\nmore {i * i}"
    assert all(got[i] == f"own {i} word." for i in range(6, 10))
    # Two different pages are too few, and equal pages are one.
    assert all("same" in got[i] for i in range(10, 14))
    assert all(got[i] == "only" for i in range(14, 18))


def test_article_keeps_what_all_pages_share(spark):
    """Only lines of links go from inside articles; headings and text stay, linked headings too."""
    body = "<h1>Title {0}</h1><h2>Introduction</h2><p>own {0}</p><p>See the notes below.</p><h3><a href=y>Notes</a></h3><ul><li><a href=z>Next</a></ul>"
    rows = [(i, "http://a/x", f"<body><p>Imprint</p><article>{body.format(i)}</article></body>") for i in range(5)]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    for r in got:
        assert r.text == f"Title {r.page_id}\nIntroduction\nown {r.page_id}\nSee the notes below.\nNotes"


def test_wrapper_of_the_host_decides(spark):
    """An element that looks like furniture by itself is none where another page of the host has its article in it."""
    odd = "<body><div class=related><p>the text</p></div><p>Printed at noon</p></body>"
    rows = [(0, "http://a/x", odd), (1, "http://a/y", "<body><div class=related><article><p>one</p></article></div></body>")]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {0: "the text\nPrinted at noon", 1: "one"}
    assert wrappers.main_text(odd, wrappers.page_expression(odd)) == "Printed at noon"


def test_alignment_is_a_longest_one(monkeypatch):
    rng = random.Random(5)

    def longest(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for cells in (wrappers.CELLS, 6):
        monkeypatch.setattr(wrappers, "CELLS", cells)
        for _ in range(300):
            a, b = ("".join(rng.choices("abc", k=rng.randrange(12))) for _ in range(2))
            found = wrappers._common(list(a), list(b))
            assert all(a[i] == b[j] for i, j in found) and len(found) == longest(a, b)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))


def test_wide_pages_align_quickly():
    rng = random.Random(7)
    a, b = ([[rng.choice(("b", "i", "em", "q", "u", "s")), "1", []] for _ in range(2000)] for _ in range(2))
    started = time.perf_counter()
    wrappers._common([x[0] for x in a], [x[0] for x in b])
    assert time.perf_counter() - started < 2
    assert wrappers.align(a, b)


def test_odd_pages(spark):
    schema = "page_id bigint, url string, html string, text string, host string, salt int"
    rows = [(1, None, None, "t", "h", 1), (2, "x", "<p>a</p>", None, None, None), (2, "x", "<p>a</p>", None, None, None), (None, "http://h/1", "", "", "", 0)]
    got = wrappers.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == [("1", "", 0), ("2", "a", 1), ("2", "a", 1), ("None", "", 0)]
    assert wrappers.extract(spark.createDataFrame([], schema)).count() == 0
