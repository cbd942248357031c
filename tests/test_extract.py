from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.config import Config
from quillstack.functions.dom import cleaned, markdown, parse
from quillstack.operators import extract

SITE = "https://s.example.com/"
RICH = """<!DOCTYPE html><html><head><title>Site | Post</title><meta name="description" content=" About it ">
<meta property="article:published_time" content="2019-05-05"><script type="application/ld+json">{"@type":"Person"}</script>
<script type="application/ld+json">{"@type":"BlogPosting","datePublished":"2020-01-02T03:04:05","dateModified":"2020-02-01"}</script></head>
<body><nav class="menu"><a href="/blog/">Blog</a><a href="/x">X</a></nav>
<article class="blog-item"><div class="entry-header"><h1>The &amp; Title</h1></div>
<div class="blog-meta"><span class="date">Jan 5, 2011</span></div><div class="entry-author">Ann</div>
<div class="entry-content"><script>var a = "</p>";</script><style>p{}</style><!-- note --><p>First <b>bold<p>Second &eacute; paragraph that is long enough for the content rule.
<ul><li>one<li>two<ul><li>deep</li></ul></ul><figure><img src="/i/a.png" width="100" height="80" alt="A"><figcaption>Cap</figcaption></figure>
<img src="b.png" width="40" height="100"><img src="c.png" width="auto" height="10"><a href="/blog/2020/1/2/other">other</a> <a href="#">top</a> <a href="mailto:a@b.c">mail</a>
<a href="/blog/2020/1/2/other">again</a></div><div class="categories"><a>News</a><a>News</a></div><div class="tags"><a>t1</a><a>t2</a></div></article></body></html>"""


def post(spark, html, url="https://s.example.com/blog/2020/1/2/the-title"):
    pages = spark.createDataFrame([(url, html)], "url string, html string")
    return extract.extract_posts(pages, Config(site_url=SITE, default_author="Nobody")).first()


def test_rich_page(spark):
    p = post(spark, RICH)
    assert (p.title, p.meta_description, p.author, p.id, p.slug) == ("The & Title", "About it", "Ann", "2020-1-2-the-title", "the-title")
    assert p.published_date == "2020-01-02T03:04:05" and p.modified_date == "2020-02-01T00:00:00"
    assert p.categories == ["News"] and p.tags == ["t1", "t2"]
    assert [(i.original_url, i.caption) for i in p.images] == [("https://s.example.com/i/a.png", "Cap"), ("https://s.example.com/blog/2020/1/2/c.png", "")] or p.images[0].caption == "Cap"
    assert [(x.url, x.type) for x in p.links] == [("https://s.example.com/blog/2020/1/2/other", "internal"), ("mailto:a@b.c", "email")]
    assert "var a" not in p.content_text and "note" not in p.content_text and "é paragraph" in p.content_text
    assert int(p.word_count) == len(p.content_text.split()) and p.error is None


def test_precedence_of_dates(spark):
    no_ld = RICH.replace('"BlogPosting"', '"Thing"')
    assert post(spark, no_ld).published_date == "2019-05-05T00:00:00"
    no_meta = no_ld.replace("article:published_time", "x")
    assert post(spark, no_meta).published_date == "2020-01-02T00:00:00"
    assert post(spark, no_meta, "https://s.example.com/p").published_date == "2011-01-05T00:00:00"


def test_bare_and_missing_pages(spark):
    p = post(spark, None)
    assert p.title == "Untitled" and p.content_text == "" and p.author == "Nobody" and p.links == []
    p = post(spark, "<p>only text")
    assert p.content_text == "only text"
    rows = spark.createDataFrame([(None, "<p>x")], "url string, html string")
    assert extract.extract_posts(rows).count() == 0


def test_icon_rule():
    def kept(w, h):
        size = (f' width="{w}"' if w is not None else "") + (f' height="{h}"' if h is not None else "")
        return bool(extract.dom_record("https://a/", f"<article><p>{'x' * 60}</p><img src=x{size}></article>")["images"])

    cases = [(40, 100, False), (100, 40, False), ("auto", 10, True), (100, "auto", True), (None, 10, True), (100, 100, True)]
    assert [kept(w, h) for w, h, _ in cases] == [k for _, _, k in cases]


def test_selectors():
    root = parse('<div class="a b"><p id=x data-k="v w">t</p></div><p class=c>u</p>')
    for selector, n in ((".a p", 1), ("p", 2), ("div.a.b", 1), ("#x", 1), ('[data-k="v w"]', 1), ('[data-k*="v"]', 1), ("p, div", 3), ("div .c", 0), ('p[data-k="v w"], .c', 2)):
        assert len(root.select(selector)) == n, selector


def test_markdown_writer():
    html = '<h1>T</h1><p>a <b>bold</b> <i>it</i> <a href="/x">l</a></p><ul><li>one</li><li>two</li></ul><ol><li>n</li></ol><blockquote><p>q</p></blockquote><pre>c\nd</pre><img src="/i.png" alt="A"><script>x</script>'
    out = markdown(cleaned(html, SITE))
    assert out == "# T\n\na **bold** _it_ [l](https://s.example.com/x)\n\n  * one\n  * two\n\n  1. n\n\n> q\n\n    c\n    d\n\n![A](https://s.example.com/i.png)"


def test_cleaning_drops_builder_data():
    out = cleaned('<div class="sqs-block" data-x="1" id="i"><link rel=a><p data-y="2">t</p></div>', SITE).html()
    assert 'data-x' not in out and 'data-y="2"' in out and "<link" not in out


def test_probes():
    d = extract.dom_record("https://s.example.com/", RICH)
    assert d["has_navigation"] and d["has_post_elements"] and d["article_count"] == 1
    assert {c["selector"]: c["count"] for c in d["builder_counts"]}[".blog-item"] == 1
    assert [x["href"] for x in d["nav_links"]] == ["/blog/"]  # the first of each target
    assert d["post_hrefs"] == ["/blog/", "/blog/2020/1/2/other"]
    assert len(d["candidate_links"]) == 3


def test_historical(spark):
    html = "<html><title>abc</title><h1>A long title</h1><div class=content>short</div><article><p>" + "word " * 40 + "</p><p>end</p></article>"
    pages = spark.createDataFrame([("https://a/blog/2006/2/my-post.html", html), ("https://a/x/y_z", "<p>t</p>")], "url string, html string")
    a, b = extract.extract_historical(pages, "Ann").orderBy("url").collect()
    assert (a.title, a.published_date, a.year, a.month, a.id) == ("A long title", "2006-02-01", 2006, 2, "2_my-post.html")
    assert a.content.endswith("\n\nend") and a.word_count == 41
    assert b.title == "Y Z" and b.published_date is None and b.content == ""


def test_native_links(spark):
    pages = spark.createDataFrame([("https://s.example.com/p/q", '<a class=k href="/a">1</a><a href="#">2</a><a href="b">3</a><a href="/a">4</a>')], "url string, html string")
    got = sorted((r.pos, r.target, r.type) for r in extract.page_links(pages, SITE).collect())
    assert got == [(0, "https://s.example.com/a", "internal"), (2, "https://s.example.com/p/b", "internal")]


def test_keep_first(spark):
    rows = spark.sql("select array(named_struct('k','a','v',1), named_struct('k','b','v',2), named_struct('k','a','v',3)) as x")
    assert [(r.k, r.v) for r in rows.select(extract.keep_first(F.col("x"), "k").alias("y")).first().y] == [("a", 1), ("b", 2)]
