"""Main text of pages: markup of many kinds, templates that names don't give away, and the given pages by a plain expression."""

import html
import re
import time

from ledgerlake.llm import html_text
from ledgerlake.llm.html_text import Page

COLUMNS = "page_id long, url string, html string, text string, d int, n int"


def text_of(source, template=()):
    return Page(source).main_text(set(template))[0]


def test_markup():
    assert text_of("<p>a <b>b</b>\n\tc<br>d &amp; e&nbsp;f &#x41;&eacute; &lt;p&gt;</p><p>g") == "a b c d & e f Aé <p>\ng"
    assert text_of("<ul><li>one<li>two</ul><table><tr><td>x<td>y<tr><th>z</table>") == "one\ntwo\nx y\nz"
    assert text_of("1 < 2 <3 and <> </b") == "1 < 2 <3 and <>"
    assert text_of("<a href='x>y'>link</a> <a title=\"don't\">z</a>") == "link z"
    assert text_of("<p><b>one.<br><p>two</b> three<div>four</div>") == "one.\ntwo three\nfour"
    assert text_of("<script>var t='</p>';if(a<b)x()</script><style>p{}</style>t<!-- c > d -->u<noscript>n</noscript>") == "tu"
    assert text_of("<p>kept<!-- never closed <p>x") == "kept" and text_of("<p>kept<a href=\"x") == "kept" and text_of("<p>kept<script>x<p>") == "kept"
    assert text_of("") == "" and text_of("plain  text") == "plain text" and text_of("</p></div>x</b>") == "x"


def test_names():
    page = """<html><head><title>t</title></head><body class="has-sidebar"><header><h1>Site</h1></header><nav>menu</nav><div class="cookieNotice">ok?</div><div id="main-wrap">
      <main><div role="search">find</div><article class="post no-ads"><header><h1>Title</h1></header><p>First.</p><aside>note</aside><div class="share-buttons">tweet</div>
      <form><input><label>mail</label></form><p>Second <button>b</button> part.</p><footer>tags</footer><section id="comments"><article class="comment"><p>Nice!</p></article></section></article>
      <section class="related"><article><p>Other story</p></article></section></main></div><aside><article>teaser</article></aside><footer>foot</footer></body></html>"""
    assert text_of(page) == "Title\nFirst.\nSecond part."
    assert text_of("<body><form><p>the whole page is in a form</p></form><div hidden>x</div><div class=ad>buy</div><div class='commentList'>" + "long comment " * 30 + "</div></body>") == "the whole page is in a form"
    assert text_of("<div role=main><h1>T</h1>a</div><div>b</div>") == "T\na"


def site(i, body, host="h.example"):
    return (i, f"https://user@{host.upper()}:8080/p/{i}", f"<html><body><div><span>Home</span><span>About {host}</span></div><div class='c'><h2>Story {i}</h2>{body}</div><div>All rights {host}</div></body></html>")


def test_template_without_names(spark):
    prose = "<p>The same paragraph stands in all of these stories, and it is a long one.</p>"
    rows = [site(i, f"<p>Only here {i}: {'word ' * (20 + i)}</p>{prose if i < 6 else ''}") for i in range(20)]
    rows += [site(50 + i, f"<p>text {i} of a small site</p>", "small.example") for i in range(3)]
    # one article on many pages: equal and nearly equal
    rows += [(100 + i, f"http://copies.example/{i}", f"<nav><a>n</a></nav><article><h1>T</h1>{prose}<div><p>in a div</p></div><p>x{i // 7}</p><div><a>more</a> <a>links</a></div></article>") for i in range(14)]
    rows += [(200, None, "<p>no url"), (201, "relative/x", None), (202, "http://h.example", ""), (None, "http://h.example/z", "<p>z</p>"), (0, rows[0][1], rows[0][2]), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], COLUMNS).repartition(3)
    got = {}
    for r in html_text.main_texts(df).collect():
        assert got.setdefault(r.page_id, (r.text, r.n_chars, r.n_template)) == (r.text, r.n_chars, r.n_template) and r.n_chars == len(r.text)
    plain = "The same paragraph stands in all of these stories, and it is a long one."
    for i in range(20):
        assert got[i][0] == "\n".join([f"Story {i}", " ".join(f"Only here {i}: {'word ' * (20 + i)}".split()), *([plain] if i < 6 else [])]) and got[i][2] == 2
    assert all(got[50 + i][0].startswith("HomeAbout small.example\nStory") and got[50 + i][2] == 0 for i in range(3))
    assert all(got[100 + i][0] == f"T\n{plain}\nin a div\nx{i // 7}\nmore links" for i in range(14))
    assert got[200][0] == "no url" and got[201] == got[202] == ("", 0, 0) and got[None][0] == "z"
    # the same by way of a join, as for templates that are too many to be sent
    joined = html_text.main_texts(df, most_sent=0).collect()
    assert sorted((str(r.page_id), r.text, r.n_template) for r in joined) == sorted((str(r.page_id), r.text, r.n_template) for r in html_text.main_texts(df).collect())
    assert html_text.main_texts(df.limit(0)).count() == 0


def test_links_inside_articles(spark):
    rows = [(i, f"http://l.example/{i}", f"<article><p>Story number {i} of many, told at length.</p><div><a>more</a> <a>links</a></div><ul><li>a list <li>of text</ul></article>") for i in range(8)]
    got = html_text.main_texts(spark.createDataFrame([(*r, "t", 1, 2) for r in rows], COLUMNS)).collect()
    assert {r.text for r in got} == {f"Story number {i} of many, told at length.\na list\nof text" for i in range(8)}


def test_long_and_broken_pages_take_linear_time():
    began = time.perf_counter()
    for source in ("<div>" * 50000, "<a b='c" * 50000, "<a b=\"" + "x='y' " * 50000, "<!-" * 50000, "<b><i>" * 20000 + "</b>" * 20000, "<" * 100000, "&" * 100000, "<p>" * 50000 + "</p>" * 50000, "<script>" * 50000):
        Page(source).main_text(set())
    assert time.perf_counter() - began < 60


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got, twice = ({r.page_id: r for r in html_text.main_texts(pages, **more).collect()} for more in ({}, {"many": 2}))
    for r in pages.collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id].text == twice[r.page_id].text == want and got[r.page_id].url == r.url
    assert sum(r.n_template for r in twice.values()) > 0
