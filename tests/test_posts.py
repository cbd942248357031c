"""Validation, archive, updates, discovery, state, assets."""

from __future__ import annotations

import datetime
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack.config import Config, UrlProfile, load_config, save_config
from quillstack.operators import archive, assets, discovery, incremental, markdown, state, validate
from quillstack.schemas import FLAT_POSTS, IMAGE_LEDGER, parsed
from quillstack.sources import readers, sinks

SITE = "https://s.example.com/"
CONFIG = Config(site_url=SITE, default_author="Nobody")


def flat(pos, **fields):
    base = dict.fromkeys([f.name for f in parsed(FLAT_POSTS)])
    return tuple((base | {"pos": pos, "url": f"http://s.example.com/blog/2020/1/{pos}/t", "id": f"i{pos}", "title": f"T{pos}", "content_text": "some words here", "published_date": "2020-01-01"} | fields).values())


def validated(spark, *rows):
    return validate.validate_posts(spark.createDataFrame(list(rows), parsed(FLAT_POSTS)), CONFIG)


def test_clean_post(spark):
    p = validated(spark, flat(1, categories=[" a ", "a", "", "b"], word_count="12")).first()
    assert p.url == "https://s.example.com/blog/2020/1/1/t" and p.author == "Nobody" and p.slug == "t"
    assert p.categories == ["a", "b"] and p.tags == [] and p.word_count == 12 and p.validation.issues == []
    assert p.published_date == "2020-01-01T00:00:00"


def test_flaws_and_their_order(spark):
    p = validated(
        spark,
        flat(
            7, id=None, title="<b>x</b>", published_date="garbage", url="https://s.example.com/x", content_text=" ", word_count="x",
            images=[(" ", "", "", "", None, None), (" u ", " a ", "", "", "100", "auto")],
            links=[("https://s.example.com/a", " t ", "", "foo"), ("", "", "", ""), ("https://s.example.com/a", "", "", "external")],
        ),
    ).first()
    assert p.validation.issues == [
        "Missing required field: id", "Title contains HTML tags", "Invalid date format in published_date: garbage", "No published date found",
        "Post has no content", "Invalid word count format", "Image 0 missing URL", "Link 1 missing URL",
    ]
    assert p.id == "post-7" and p.title == "x" and p.word_count == 0
    assert [(i.original_url, i.alt_text, i.width, i.height) for i in p.images] == [("u", "a", 100, None)]
    assert [(x.url, x.text, x.type) for x in p.links] == [("https://s.example.com/a", "t", "internal")]


def test_rejected_and_report(spark):
    rows = [flat(1), flat(2, url=None), flat(3, url="  "), flat(4, title=" "), flat(5, content_text="a\n \n\n b")]
    posts = spark.createDataFrame(rows, parsed(FLAT_POSTS))
    good = validate.validate_posts(posts, CONFIG)
    assert [p.title for p in good.orderBy("pos").collect()] == ["T1", "Untitled Post 4", "T5"]
    r = validate.validation_report(posts, good).first()
    assert (r.total_posts, r.errors, r.valid_posts, r.warnings, r.issues_found, r.fixes_applied, r.success_rate) == (5, 2, 3, 1, 1, 1, 60.0)
    empty = posts.where("false")
    assert validate.validation_report(empty, validate.validate_posts(empty, CONFIG)).first().success_rate == 0


def test_dates_fall_back_to_the_url(spark):
    p = validated(spark, flat(3, published_date=None)).first()
    assert p.published_date == "2020-01-03T00:00:00" and p.validation.issues == []


def test_archive_shapes(spark, tmp_path):
    rows = [
        flat(1, published_date="2020-01-05", tags=["x"], categories=["c"], author="A", links=[("mailto:a@b", "m", "", "email"), ("https://o/", "o", "", "odd")]),
        flat(2, published_date="2020-01-05", tags=["x", "y"]),
        flat(3, published_date=None, url="https://s.example.com/p", tags=["y"]),
        flat(4, published_date="2019-12-31"),
    ]
    posts = validated(spark, *rows)
    assert [p.id for p in archive.newest_first(posts).collect()] == ["i1", "i2", "i4", "i3"]
    months = {(m.year, m.month): [p.id for p in m.posts] for m in archive.timeline(posts).collect()}
    assert months == {("2020", "2020-01"): ["i1", "i2"], ("2019", "2019-12"): ["i4"]}
    tags = {t.tag: [p.id for p in t.posts] for t in archive.inverted_index(posts, "tags", "tag").collect()}
    assert tags == {"x": ["i1", "i2"], "y": ["i2", "i3"]}
    meta = archive.site_metadata(posts).first()
    assert (meta.total_posts, meta.tags, meta.authors, meta.total_links, meta.average_words) == (4, ["x", "y"], ["A", "Nobody"], 2, 3)
    assert archive.site_metadata(posts.where("false")).first().average_words == 0
    summary = archive.extraction_summary(posts).first()
    assert (summary.posts_with_tags, summary.posts_with_links, summary.issues_found) == (3, 1, 1)
    nested = archive.archived_posts(posts).where("id = 'i1'").first()
    assert [x.url for x in nested.assets.links.external] == ["https://o/"] and nested.assets.links.email[0].url == "mailto:a@b"
    sinks.write_archive(posts, str(tmp_path / "archive"))
    back = readers.archive(spark, str(tmp_path / "archive"))
    assert back.count() == 4 and archive.completeness(back).first().completeness == 100.0
    sinks.write_indexes(posts, str(tmp_path / "index"))
    entries = [json.loads(line) for p in sorted((tmp_path / "index/timeline_index").glob("part-*")) for line in p.read_text().splitlines()]
    assert {e["year"] for e in entries} == {"2019", "2020"}  # a row an entry, by month and newest first
    assert entries == sorted(sorted(entries, key=lambda e: (e["date"], -e["pos"]), reverse=True), key=lambda e: e["month"])
    n = sinks.write_named_files(markdown.markdown_files(posts, SITE, "2024-01-01"), str(tmp_path / "md"))
    body = (tmp_path / "md/2020-01-05-t.md").read_text()
    assert n == len(list((tmp_path / "md").glob("*.md"))) and body.startswith("---\ntitle: T") and "archived_date" in body


def test_front_matter_and_readme(spark):
    posts = validated(spark, flat(1, tags=["x"], images=[("https://i/a.png", "", "", "", None, None)]))
    front = posts.select(markdown.front_matter("2024-01-01")).first()[0]
    assert front.index("title:") < front.index("date:") < front.index("layout: post") < front.index("tags:") < front.index("image_count: 1") < front.index("featured_image:")
    assert "excerpt" not in front
    stats = markdown.readme_stats(posts).first().asDict()
    assert "1 posts, 3 words" in markdown.readme(stats, "A") and "Posts from 2020-01-01" in markdown.readme(stats, "A")


def table(spark, rows):
    return spark.createDataFrame([(u, p, t, None, None, None, tags) for p, (u, t, tags) in enumerate(rows)], "url string, pos int, title string, content_html string, excerpt string, categories array<string>, tags array<string>")


def test_diff_and_merge(spark):
    old = incremental.with_hash(table(spark, [("a", "1", ["x", "y"]), ("b", "2", []), ("c", "3", [])]))
    new = incremental.with_hash(table(spark, [("d", "9", []), ("a", "1", ["y", "x"]), ("b", "changed", [])]))
    assert {r.url: r.status for r in incremental.diff(old, new).collect()} == {"a": "unchanged", "b": "changed", "c": "removed", "d": "new"}
    merged = incremental.merge(old, new).orderBy("added", "pos").collect()
    assert [(m.url, m.title) for m in merged] == [("a", "1"), ("b", "changed"), ("c", "3"), ("d", "9")]
    assert [r.url for r in incremental.missing_keys(old, new).collect()] == ["c"]
    assert sorted(r.url for r in incremental.common_keys(old, new).collect()) == ["a", "b"]


def test_since_spares_the_comparison(spark):
    day = datetime.datetime(2020, 1, 1)
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "url string, content_hash string")
    new = spark.createDataFrame([("a", "2", day - datetime.timedelta(1)), ("b", "2", day), ("c", "2", None)], "url string, content_hash string, m timestamp")
    assert {r.url: r.status for r in incremental.diff(old, new, modified="m", since=day).collect()} == {"a": "unchanged", "b": "changed", "c": "changed"}


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.sampled_from("xy")), st.dictionaries(st.sampled_from("abcdef"), st.sampled_from("xy")))
def test_diff_partitions_and_merge_is_idempotent(spark, a, b):
    frame = lambda d: spark.createDataFrame([(k, i, v, v) for i, (k, v) in enumerate(sorted(d.items()))], "url string, pos int, title string, content_hash string")
    old, new = frame(a), frame(b)
    status = {r.url: r.status for r in incremental.diff(old, new).collect()}
    assert set(status) == set(a) | set(b)
    once = incremental.merge(old, new)
    twice = incremental.merge(once.drop("added"), new)
    assert {(r.url, r.title) for r in once.collect()} == {(r.url, r.title) for r in twice.collect()} == set((a | b).items())


def test_pages_until_empty(spark):
    def kept(hits, n, late=None):
        rows = spark.createDataFrame([("b", k + 1, h) for k, h in enumerate(hits)], "base string, page int, hit int")
        return [r.page for r in discovery.pages_until_empty(rows, ["base"], empties=n, late_page=late).orderBy("page").collect()]

    assert kept([1, 0, 0, 0, 0, 0, 1], 5) == [1, 2, 3, 4, 5, 6]
    assert kept([0, 1], 5) == [1, 2]
    assert kept([1] * 13 + [0, 0, 0, 0, 1], 5, 15) == [*range(1, 17)]


def test_discovery(spark):
    profile = UrlProfile(required=("/notes/",), min_parts=2)
    found = discovery.union_methods({"a": spark.createDataFrame([("https://h/notes/x-yz?q=1",), ("https://h/notes/x-yz",), ("https://h/notes/x-yz",)], "url string"), "b": spark.createDataFrame([("https://h/notes/zzzz",), ("ftp://h/notes/zzzz",)], "url string")})
    assert {r.method: r.urls for r in discovery.method_counts(found).collect()} == {"a": 2, "b": 2}
    assert [r.url for r in discovery.filtered_urls(found, profile).collect()] == ["https://h/notes/x-yz", "https://h/notes/zzzz"]
    years = spark.createDataFrame([("/2006/1/",), ("/2006/2007/",), ("/1999/",)], "url string")
    assert [tuple(r) for r in discovery.year_breakdown(years, 2005, 2014).collect()] == [(2006, 2)]


def test_parsers(spark):
    xml = "<urlset><url><loc> https://h/a?x=1&amp;y=2 </loc></url></urlset><sitemap><loc>https://h/s.xml</loc></sitemap>"
    bad = "<loc>https://h/b</LOC> & <broken"
    rows = spark.createDataFrame([(0, xml), (1, bad)], "k int, x string").orderBy("k")
    assert [r[0] for r in rows.select(readers.sitemap_locations(F.col("x"))).collect()] == [["https://h/a?x=1&y=2"], ["https://h/b"]]
    assert rows.select(readers.child_sitemaps(F.col("x"))).first()[0] == ["https://h/s.xml"]


def test_state(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [("a", "failed", 0), ("a", "completed", 1), ("b", "completed", 0), ("b", "completed", 2), ("c", "failed", 5)]
    events = spark.createDataFrame([(u, s, t + datetime.timedelta(seconds=k)) for u, s, k in rows], "url string, status string, ts timestamp")
    latest = state.latest_status(events, ["url"], "status", "ts")
    assert {r.url: r.status for r in latest.collect()} == {"a": "completed", "b": "completed", "c": "failed"}
    p = state.progress(latest, 4).first()
    assert (p.completed, p.failed, p.total, p.completion_rate) == (2, 1, 4, 50.0)
    assert state.progress(latest.where("false"), 0).first().completion_rate == 0
    assert [r.url for r in state.to_retry(latest, "url").collect()] == ["c"]
    none = spark.createDataFrame([], "s double, done boolean")
    assert state.remaining_seconds(none, "s", F.col("done"), 10).first().remaining_seconds == 0
    assert state.next_phase(None) == "initialization" and state.next_phase("completed") is None


def test_remaining_seconds_beyond_the_total(spark):
    timings = spark.createDataFrame([(2.0, True), (4.0, True), (9.0, False)], "s double, done boolean")
    left = lambda total: state.remaining_seconds(timings, "s", F.col("done"), total).first().remaining_seconds
    assert (left(5), left(1), left(0)) == (9.0, -3.0, 0.0)


def test_images(spark):
    pad = b"x" * 100
    cases = [(b"\xff\xd8\xff" + pad, True), (b"\x89PNG" + pad, True), (b"GIF8" + pad, True), (b"RIFF0000WEBP" + pad, True), (b" <svg" + pad, True), (b"\xff\xd8\xff", False), (b"text" + pad, False), (None, False)]
    rows = spark.createDataFrame([(k, bytearray(c) if c else None) for k, (c, _) in enumerate(cases)], "k int, c binary")
    assert [r[0] for r in rows.orderBy("k").select(assets.is_image(F.col("c"))).collect()] == [v for _, v in cases]
    w, h = assets.fitted_size(F.lit(4000), F.lit(1000), 1920)
    assert tuple(spark.range(1).select(w, h).first()) == (1920, 480)
    ledger = spark.createDataFrame([("u1", "p1", "success", 1536), ("u2", "", "failed", None)], IMAGE_LEDGER)
    r = assets.download_report(ledger).first()
    assert (r.total_images, r.successful, r.failed, r.success_rate, r.total_size) == (2, 1, 1, 50.0, "1.5 KB")
    posts = spark.sql("select 'i' as id, array(named_struct('original_url','u3','alt_text',''), named_struct('original_url','u1','alt_text','')) as images")
    assert [(i.original_url, i.local_path, i.status) for i in assets.with_local_paths(posts, ledger).first().images] == [("u3", "", "skipped"), ("u1", "p1", "success")]


def test_config(tmp_path):
    path = tmp_path / "c.json"
    save_config(CONFIG, str(path))
    assert load_config(str(path)) == CONFIG and load_config(str(tmp_path / "none.json")) == Config()
    path.write_text('{"urls": {"speed": 1}}')
    with pytest.raises(ValueError, match="speed"):
        load_config(str(path))
