import html
import itertools
import random
import re

import numpy as np
import pytest

from stumpline.llm.html_extract import extracted, fitted, main_text, minimum_cut

SCHEMA = "page_id long, url string, html string, text string, n_chars long"


def test_cut_is_the_cheapest_labelling():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 8)
        content, boilerplate = (np.array([rng.choice([0.0, rng.random() * 3]) for _ in range(n)]) for _ in range(2))
        edges = [(a, b, rng.random() * 2) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.4]

        def cost(x):
            return sum(content[i] if x[i] else boilerplate[i] for i in range(n)) + sum(w for a, b, w in edges if x[a] != x[b])

        assert cost(minimum_cut(content, boilerplate, edges)) == pytest.approx(min(cost(x) for x in itertools.product([False, True], repeat=n)))


def article_of(page):
    """The test pages' own article, by its marks."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_whole_table(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    want = {r.page_id: (r.url, article_of(r.html)) for r in pages.collect()}
    got = {r.page_id: r for r in extracted(pages).collect()}
    assert got.keys() == want.keys()
    assert [i for i, r in got.items() if (r.url, r.text) != want[i]] == []
    assert all(r.n_chars == len(r.text) for r in got.values())


PAGE = """<!doctype html><html><head><title>T</title><style>a{}</style></head><body>
<header><h2>Site name</h2><p>Slogan of the site, which is a rather long one with many words in it.</p></header>
<div id="cookie-notice"><p>We use cookies to give you the best experience on this site. Accept them all.</p></div>
<nav><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></nav>
%s
<aside class="sidebar"><h3>Popular</h3><ul><li><a href=/x>Ten things that you did not know about things</a></li></ul></aside>
<form><label>Mail</label><input name=x><button>Send it</button><select><option>One<option>Two</select></form>
<section id="comments"><h3>2 comments</h3><p>A reader says that this is a very good article, with many good points in it.</p></section>
<footer><p>Copyright by the site. All rights reserved, and some more words on the matter.</p></footer></body></html>"""
BODY = """<h1>Title &amp; more</h1><p>First   paragraph with a <a href=/l>link</a> and\n<b>bold</b> words &lt;here&gt;.<p>Short.
<script>var x = "</p>not text";</script><ul><li>An item of the article</li><li>Another one</li></ul><blockquote>A quotation &eacute;&#33;</blockquote>"""
TEXT = "Title & more\nFirst paragraph with a link and bold words <here>.\nShort.\nAn item of the article\nAnother one\nA quotation é!"


@pytest.mark.parametrize("frame", ["<article>%s</article>", "<main>%s</main>", '<div class="content">%s</div>', '<main><article class="post">%s</article></main>'])
def test_parts_of_a_page(frame):
    assert main_text(PAGE % (frame % BODY)) == TEXT


def test_boilerplate_inside_an_article():
    inner = BODY + '<div class="share-buttons">Share this on</div><div class="related"><a href=/y>Read this too</a></div><div class="ad">Buy now, it is cheap.</div>'
    assert main_text(PAGE % f"<article>{inner}</article>") == TEXT


def test_page_without_marks():
    long = "This is a paragraph of a page without any marks, and it goes on for quite a number of words so that it is plainly text."
    assert main_text(f"<body><div><a href=/>Home</a> <a href=/b>Blog</a></div><div><p>{long}</p><p>{long}</p></div>") == f"{long}\n{long}"


def test_null_broken_long_and_empty(spark):
    long = "<article>" + "<p>Some words of a paragraph.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, "x", 1), (2, None, "", None, None), (3, "u", "<", "x", 1), (4, "u", "<article><p>open <b>and <i>never closed", "x", 1), (5, "u", long, "x", 1),
            (5, "u", long, "x", 1), (6, "u", "<!-- <article><p>not this</p></article> -->", "x", 1), (None, "u", "<article><p>a < b & c</article>", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id: r for r in extracted(df).collect()}
    assert [got[i].text for i in (1, 2, 4, 6, None)] == ["", "", "open and never closed", "", "a < b & c"]
    assert got[5].text == "\n".join(["Some words of a paragraph."] * 20_000) and got[5].n_chars == len(got[5].text)
    assert extracted(df).count() == 8 and extracted(df.limit(0)).count() == 0 and len(fitted(df.limit(0))) > 0


@pytest.mark.parametrize("head", ['<body class="has-sidebar">', '<body class="with-comments">', '<body class="single-post comments-open">',
                                  '<body class="page logged-in search">', '<html class="no-js cookies"><body>',
                                  '<body><div class="page-wrap with-sidebar">'])
def test_layout_names_of_the_page_keep_its_article(head):
    long = "A paragraph of the article that goes on for a good number of words, so that it reads plainly as the text of the page."
    page = f'{head}<div class="menu"><a href=/>Home</a> <a href=/b>Blog</a></div><article><p>{long}</p><p>{long}</p></article>'
    assert main_text(page) == f"{long}\n{long}"
