from __future__ import annotations

import html
import re

import pytest

from clickward.llm.html_text import main_text, page_text

PAGE = """<!doctype html><html><head><title>No</title><style>p{}</style></head><body class="page has-sidebar">
<div id="cookie-notice">We use cookies.</div><header><h1>Site</h1></header><ul><li><a href="/">Home</a></li></ul>
<div id="content"><h2>Title &amp; more</h2><p>One&nbsp;two <b>th</b>ree
 four.<p>Short.<div class="ad">Buy now.</div><p>With a <a href="/x">link</a> &lt;b&gt; and &#233;.</p>
<script>var t = "</p>";</script><!-- <p>no</p> --></div>
<section id="comments"><p>Great post, I liked it very much.</p></section><form>Mail <input></form>
<aside>More</aside><footer>&copy; me</footer></body></html>"""


def test_page_without_article():
    assert main_text(PAGE) == "Title & more One two three four. Short. With a link <b> and é."


def test_article_wins_over_the_rest():
    page = "<div>Elsewhere there is a lot of other text.</div><nav><article><h1>T</h1><p>a</p>" + "<div></div>" * 9 + "<p>b</p></article> tail"
    assert main_text(page) == "T a b"


def test_broken_pages():
    assert main_text("") == ""
    assert main_text("plain text, no markup") == "plain text, no markup"
    assert main_text("<p>kept<script>lost</p>") == "kept"
    assert main_text("<article><p>a<p>b") == "a b"
    assert main_text("<p>a <b>c < d</b> & e") == "a c < d & e"
    assert main_text("<nav>only a menu</nav>") == ""
    assert len(main_text("<p>" + "x y " * 200_000)) == 799_999


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (1, "u", PAGE), (None, None, "<p>é</p>")], "page_id long, url string, html string")
    got = page_text(pages.selectExpr("*", "'x' AS text", "5 AS n_chars")).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got] == [(1, "u", 0), (1, "u", len(main_text(PAGE))), (None, None, 1)]
    assert page_text(pages.limit(0)).count() == 0


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in page_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(html.unescape(re.sub("<[^>]*>", " ", inner)).split())


TEXT = "One paragraph of the article. " * 16


@pytest.mark.parametrize(
    "page",
    [
        '<article class="post no-comments"><p>{}</p></article>',
        '<div class="content has-sidebar"><p>{}</p></div>',
        '<div id="page" class="with-header"><p>{}</p></div>',
        '<main class="widget-area"><p>{}</p></main>',
        '<article><section id="legal-history"><p>{}</p></section></article>',
        '<article><div id="side-effects-text"><p>{}</p></div></article>',
        '<article><p class="share-price">{}</p></article>',
        '<article><h2 class="notice">{}</h2></article>',
        '<article><ul><li><a href="/x">{}</a></li></ul></article>',
    ],
)
def test_names_that_only_sound_like_menus(page):
    assert main_text(page.format(TEXT)) == TEXT.strip()


@pytest.mark.parametrize("name", ["sidebar", "sidebar-left", "site-header", "post-comments", "ad_slot_3", "cookie-notice x", "main-nav", "reader-comments-list"])
def test_names_of_what_is_no_article(name):
    for page in ('<p>{0}</p><div class="{1}">no</div>', '<article><p>{0}</p><section id="{1}"><p>no</p></section></article>'):
        assert main_text(page.format(TEXT, name)) == TEXT.strip()


def test_short_ends_of_long_pages():
    page = f"<div><p>{TEXT * 9}</p></div><div></div><div><p>In the end it was fine.</p></div>" + "<div></div>" * 9 + "<div><h3>Coda</h3><p>Bye.</p></div>"
    assert main_text(page) == (TEXT * 9).strip() + " In the end it was fine. Coda Bye."


def test_few_links_between_paragraphs_are_text():
    def listed(n):
        return "<ul>" + "".join(f'<li><a href="/{i}">Source {i}</a></li>' for i in range(n)) + "</ul>"

    assert main_text(f"<p>{TEXT}</p><h3>See</h3>{listed(2)}<p>{TEXT}</p>") == f"{TEXT}See Source 0 Source 1 {TEXT}".strip()
    # A longer list ends the stretch, and its last lines do not belong to the next one.
    assert main_text(f"<p>{TEXT}</p>{listed(3)}<p>{TEXT}</p>") == (TEXT * 2).strip()
    # Nothing but a title before, or no text behind: a menu.
    assert main_text(f"<div>Title</div>{listed(2)}<p>{TEXT}</p>") == f"Title {TEXT}".strip()
    assert main_text(f"<p>{TEXT}</p>{listed(2)}") == TEXT.strip()
    assert main_text(f"<p>{TEXT}</p><nav>{listed(2)}</nav><p>{TEXT}</p>") == (TEXT * 2).strip()
    # The window decides where a stretch ends.
    assert main_text(f"<p>{TEXT}</p>{listed(1)}<p>{TEXT}</p>", window=1) == (TEXT * 2).strip()
    assert main_text(f"<p>{TEXT}</p>{listed(4)}<p>{TEXT}</p>", window=5).count("Source") == 4
