from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillstack import cli
from quillstack.config import Config, UrlProfile

CONFIG = Config(site_url="https://s.example.com/", default_author="Ann", urls=UrlProfile(required=("/blog/",), min_parts=2))


def pages(spark, n, edited=()):
    rows = [(f"https://s.example.com/blog/2020/1/{k + 1}/post-{k}", f"<article class=entry-content><h1>T{k}</h1><p>{'word ' * 20}{'new' if k in edited else ''}</p><a href='/blog/x'>l</a></article>") for k in range(n)]
    return spark.createDataFrame(rows, "url string, html string")


def test_archive_resume_and_increment(spark, tmp_path):
    folder = str(tmp_path / "out")
    assert cli.run_archive(spark, pages(spark, 3), folder, CONFIG)["completed"] == 3
    assert cli.run_archive(spark, pages(spark, 4), folder, CONFIG)["completed"] == 4
    posts = cli.Session(spark, folder).posts()
    assert posts.count() == 4 and (tmp_path / "out/markdown/README.md").exists()
    counts = cli.run_incremental(spark, pages(spark, 6, edited={1}).where("url NOT LIKE '%post-0'"), folder, CONFIG)
    assert counts == {"new": 2, "changed": 1, "unchanged": 2, "removed": 1}
    assert cli.Session(spark, folder).posts().count() == 6
    names = sorted(p.name for p in (tmp_path / "out/markdown").glob("2020*.md"))
    assert names[0] == "2020-01-01-post-0.md" and len(names) == 6
    log = cli.readers.update_log(spark, f"{folder}/update_log").first()
    assert log.successful_updates == 3
    listed = cli.readers.updated_urls(spark, f"{folder}/updated_urls")
    assert {r.status for r in listed.collect()} == {"new", "changed"} and listed.count() == 3
    first = pages(spark, 1).select("url", F.lit("failed").alias("status"), F.lit("ValueError: x").alias("error"))
    cli.Session(spark, folder).record(first)
    assert cli.run_retry(spark, pages(spark, 6), folder, CONFIG) == {"retried_urls": 1, "successful_retries": 1}
    assert cli.state.progress(cli.Session(spark, folder).latest()).first().failed == 0


def test_positions_are_dense(spark, tmp_path):
    rows = cli.positioned(spark.range(1000).select(F.concat(F.lit("u"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("url")).repartition(7), f"file://{tmp_path}/stage")
    assert [(r.pos, r.url) for r in rows.orderBy("pos").collect()] == [(k, f"u{k:04d}") for k in range(1000)]


def test_discover(spark):
    found = cli.discover(pages(spark, 1), spark.createDataFrame([("s", "<loc>https://s.example.com/blog/some-post</loc>")], "source string, content string"), None, CONFIG)
    assert {(r.url, r.method) for r in found.collect()} == {("https://s.example.com/blog/some-post", "sitemap")}


def test_discover_gives_a_url_once_by_a_method(spark):
    maps = [(name, "<loc>https://s.example.com/blog/some-post</loc>") for name in ("s", "t")]
    found = cli.discover(pages(spark, 1), spark.createDataFrame(maps, "source string, content string"), None, CONFIG)
    assert [tuple(r) for r in found.collect()] == [("https://s.example.com/blog/some-post", "sitemap")]


def test_create_config(tmp_path):
    cli.main(["create-config", str(tmp_path / "c.json")])
    assert json.loads((tmp_path / "c.json").read_text())["sections"] == ["blog"]


def test_failing_pages_are_recorded_and_order_is_kept(spark, tmp_path, monkeypatch):
    """A page that fails is failed, not completed; a resumed run keeps the old order and puts new posts behind."""
    folder = f"file://{tmp_path}/out"  # a URI, not a path
    deep = "<div>" * 3000 + "x"
    broken = pages(spark, 3).union(spark.createDataFrame([("https://s.example.com/blog/2020/1/9/deep", deep)], "url string, html string"))
    found = cli.run_archive(spark, broken, folder, CONFIG)
    assert (found["completed"], found["failed"]) == (3, 1)
    session = cli.Session(spark, folder)
    failed = session.events().where("status = 'failed'").first()
    assert failed.url.endswith("/deep") and "RecursionError" in failed.error
    order = [r.url for r in session.posts().orderBy("pos").collect()]
    early = spark.createDataFrame([("https://s.example.com/blog/2019/1/1/aaa-first-by-name", "<article class=entry-content><h1>T</h1><p>" + "word " * 20 + "</article>")], "url string, html string")
    cli.run_archive(spark, broken.union(early), folder, CONFIG)
    again = [(r.pos, r.url) for r in session.posts().orderBy("pos").collect()]
    assert again == [*enumerate([*order, early.first().url])]
    assert cli.run_retry(spark, broken, folder, CONFIG)["successful_retries"] == 0  # it fails again and stays failed
    assert [r.url for r in session.latest().where("status = 'failed'").collect()] == [failed.url]
    out = tmp_path / "out"
    one = json.loads(next(p for p in (out / "posts").glob("*.json") if "post-0" in p.name).read_text())
    assert one["content"]["word_count"] > 0 and list(one) == sorted(one)
    main = json.loads((out / "archive.json").read_text())
    assert main["total_posts"] == 4 and main["site"]["total_posts"] == 4 and len(list((out / "backups").glob("*.json"))) >= 1
    assert "Rejected: 0" in (out / "validation_summary.txt").read_text()
    entries = [json.loads(line) for p in (out / "indexes/timeline_index").glob("*.json") for line in p.read_text().splitlines()]
    assert {e["month"] for e in entries} == {"2020-01", "2019-01"} and len(entries) == 4


def test_historical_run(spark, tmp_path):
    rows = [(f"https://s.example.com/blog/{y}/0{y % 9 + 1}/old-post.html", f"<h1>Old {y}</h1><div class=entry-content>{'text ' * 40 if y != 2007 else ''}</div>") for y in (2003, 2006, 2007, 2012, 2020)]
    found = cli.run_historical(spark, spark.createDataFrame(rows, "url string, html string"), str(tmp_path / "h"), CONFIG)
    assert (found["total"], found["extracted"], found["failed"]) == (3, 2, 1) and abs(found["success_rate"] - 200 / 3) < 1e-9
    assert sorted(p.name for p in (tmp_path / "h/markdown").glob("*.md")) == ["2006-09-01_Old_2006.md", "2012-06-01_Old_2012.md"]
