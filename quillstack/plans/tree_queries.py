"""Tree forms of extraction, over pages that are written around the rows of the pages table, so that every field has a value SQL can say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text, urls
from ..operators import extract, markdown
from .registry import query
from .stand_ins import SITE, pages



def _id():
    return F.col("page_id").cast("string")


def _made(spark, sf) -> DataFrame:
    """(page_id, url, html): for each row of pages a page with every kind of markup; what differs goes by the id's remainders."""
    k = lambda m: F.col("page_id") % m
    say = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    when = lambda test, *parts: F.when(test, say(*parts)).otherwise(F.lit(""))
    html = say(
        "<!DOCTYPE html><html><head><title> Page ", _id(), " </title><meta name=description content='  About ", _id(), " '>",
        when(k(4) == 0, "<meta name='author' content='Meta ", _id(), "'>"),
        when(k(3) != 0, "<meta property='article:published_time' content='2019-05-0", (k(9) + 1).cast("string"), "'>"),
        "<script type='application/ld+json'>{\"@type\": \"", F.when(k(5) == 0, "BlogPosting").otherwise("Person"), "\", \"datePublished\": \"2020-01-0", (k(7) + 1).cast("string"), "\", \"dateModified\": \"2021-02-03\"}</script></head><body>",
        "<nav class='menu'><a href='/blog/'>Our <b>Blog</b></a><a href='/blog/'>Blog again</a><a href='/x'>Other</a><a href='/news/", _id(), "'>News ", _id(), "</a></nav>",
        "<article class='entry'>", when(k(2) == 0, "<h1 class='entry-title'>The <i>title</i>\n of ", _id(), "</h1>"), when(k(2) == 1, "<h1> Plain ", _id(), "</h1>"),
        "<div class='blog-meta'><span class='date'>Jan ", (k(9) + 1).cast("string"), ", 2011</span></div>", when(k(4) == 1, "<span class='entry-author'> Ann ", _id(), "</span>"),
        when(k(10) != 7, "<div class='entry-content'><h2>Part ", _id(), "</h2><p>Some words &amp; more of ", _id(), ".</p><p>Second <script>no()</script>paragraph.</p>"),
        when(k(10) == 7, "<div class='entry-content'>short</div><div class='post-content'><p>A text that is longer than fifty characters in all, number ", _id(), "</p>"),
        "<figure><img src='/img/", _id(), ".png' alt='alt ", _id(), "' width='", (k(3) * 50).cast("string"), "' height='80'><figcaption> Cap <b>", _id(), "</b></figcaption></figure><img src='i.gif' width=40 height=auto><img src='' alt=x>",
        "<a href='../up/", _id(), "' title=t>Up</a> <a href='#'>none</a> <a href='https://blog.example.com/blog/2020/some-post-", _id(), "'>in</a> <a href='mailto:a@b.example'>m</a> <a href='../up/", _id(), "'>again</a></div>",
        "<div class='tags'><a rel='tag' href='/t/1'>red</a><a href='/t/2'> blue ", (k(6)).cast("string"), "</a><a href='/t/1'>red</a></div><div class='categories'><a href='/c'>cat ", (k(4)).cast("string"), "</a></div></article>",
        "<div class='blog-item post'>x</div><div class='blog-item'>y</div></body></html>",
    )
    return pages(spark, sf).select("page_id", F.concat(F.lit("https://blog.example.com/blog/"), (2000 + k(20)).cast("string"), F.lit("/1/2/"), _id()).alias("url"), html.alias("html"))


MADE = "SELECT page_id, page_id % 2 AS k2, page_id % 3 AS k3, page_id % 4 AS k4, page_id % 5 AS k5, page_id % 7 AS k7, page_id % 9 AS k9, page_id % 10 AS k10, page_id::VARCHAR AS i, 'https://blog.example.com/blog/' || (2000 + page_id % 20) || '/1/2/' || page_id AS url FROM pages"
TITLE = "CASE WHEN k2 = 0 THEN 'The title of ' || i ELSE 'Plain ' || i END"


@query(f"SELECT page_id, {TITLE} AS title, 'About ' || i AS description, CASE k4 WHEN 0 THEN 'Meta ' || i WHEN 1 THEN 'Ann ' || i ELSE 'Nobody' END AS author FROM ({MADE})")
def tree_metadata(spark, sf):
    d = extract.tree(_made(spark, sf), "title", "meta_description", "author")
    return d.select("page_id", "d.title", F.col("d.meta_description").alias("description"), F.coalesce("d.author", F.lit("Nobody")).alias("author"))


@query(f"""SELECT page_id, CASE WHEN k5 = 0 THEN '2020-01-0' || (k7 + 1) WHEN k3 <> 0 THEN '2019-05-0' || (k9 + 1) ELSE (2000 + page_id % 20) || '-01-02' END || 'T00:00:00' AS published,
 CASE WHEN k5 = 0 THEN '2021-02-03T00:00:00' END AS modified, 'Jan ' || (k9 + 1) || ', 2011' AS dom_date, '2011-01-0' || (k9 + 1) || 'T00:00:00' AS from_dom FROM ({MADE})""")
def tree_dates(spark, sf):
    d = extract.tree(_made(spark, sf), "meta_published", "meta_modified", "ld_json", "dom_date")
    ld = lambda name: F.get_json_object("d.ld_json", f"$.{name}")
    published, modified = dates.effective_dates(urls.url_date(F.col("url")), F.col("d.meta_published"), F.col("d.meta_modified"), ld("datePublished"), ld("dateModified"), F.col("d.dom_date"))
    return d.select("page_id", published.alias("published"), modified.alias("modified"), "d.dom_date", dates.iso(dates.lenient_timestamp(F.col("d.dom_date"))).alias("from_dom"))


@query(f"SELECT page_id, 'cat ' || k4 AS categories, 'red|blue ' || page_id % 6 AS tags FROM ({MADE})")
def tree_taxonomy(spark, sf):
    d = extract.tree(_made(spark, sf), "categories", "tags")
    return d.select("page_id", F.array_join("d.categories", "|").alias("categories"), F.array_join("d.tags", "|").alias("tags"))


@query(f"""SELECT page_id, 'https://blog.example.com/img/' || i || '.png' AS image, 'alt ' || i AS alt, 'Cap ' || i AS caption, k3 * 50 AS width, 80 AS height FROM ({MADE}) WHERE k3 <> 0 AND k10 <> 7""")
def tree_images(spark, sf):
    """Images of the first content element that there is. Icons go: a width of 0 is one; a width of 40 drops the second image before its height is read."""
    d = extract.tree(_made(spark, sf), "images").select("page_id", F.explode("d.images").alias("i"))
    return d.select("page_id", F.col("i.original_url").alias("image"), F.col("i.alt_text").alias("alt"), "i.caption", F.col("i.width").try_cast("int").cast("long").alias("width"), F.col("i.height").try_cast("int").alias("height"))


@query(f"""SELECT page_id, pos, target, type FROM (SELECT page_id, unnest([0, 1, 2]) AS pos, unnest([regexp_replace(url, '/1/2/[^/]*$', '') || '/1/up/' || i, 'https://blog.example.com/blog/2020/some-post-' || i, 'mailto:a@b.example']) AS target,
 unnest(['internal', 'internal', 'email']) AS type FROM ({MADE}))
 UNION ALL SELECT page_id, unnest([3, 4, 5]), unnest(['https://blog.example.com/t/1', 'https://blog.example.com/t/2', 'https://blog.example.com/c']), 'internal' FROM ({MADE}) WHERE k10 = 7""")
def tree_links(spark, sf):
    """Links of the content (of the article where the content has none), dot segments resolved, the first of each target."""
    d = extract.tree(_made(spark, sf), "links")
    full = F.transform("d.links", lambda x: F.struct(urls.absolute_url(x["href"], SITE, F.col("url")).alias("url")))
    found = d.select("page_id", F.posexplode(extract.keep_first(full, "url")).alias("pos", "x"))
    return found.select("page_id", "pos", F.col("x.url").alias("target"), urls.link_type(F.col("x.url"), SITE).alias("type"))


@query(f"SELECT page_id, 13 AS n, 'News ' || i AS fourth FROM ({MADE})")
def tree_all_links(spark, sf):
    d = extract.tree(_made(spark, sf), "all_links")
    return d.select("page_id", F.size("d.all_links").alias("n"), F.element_at("d.all_links.text", 4).alias("fourth"))


@query(f"SELECT page_id, unnest(['/blog/', '/news/' || i]) AS href, unnest(['Our Blog', 'News ' || i]) AS text FROM ({MADE})")
def tree_navigation(spark, sf):
    d = extract.tree(_made(spark, sf), "nav_links").select("page_id", F.explode("d.nav_links").alias("x"))
    return d.select("page_id", "x.href", "x.text")


@query(f"""SELECT page_id, 2 AS blog_items, 2 AS builder_total, 1 AS articles, true AS has_posts, true AS has_navigation, 'Our Blog|Blog again|in' AS candidates, '/blog/|https://blog.example.com/blog/2020/some-post-' || i AS post_hrefs FROM ({MADE})""")
def tree_indicators(spark, sf):
    d = extract.tree(_made(spark, sf), "builder_counts", "article_count", "has_post_elements", "has_navigation", "candidate_links", "post_hrefs")
    counts = F.col("d.builder_counts")
    return d.select(
        "page_id", F.element_at(counts, 1)["count"].alias("blog_items"), F.aggregate(counts, F.lit(0), lambda acc, x: acc + x["count"]).alias("builder_total"), F.col("d.article_count").alias("articles"),
        F.col("d.has_post_elements").alias("has_posts"), "d.has_navigation", F.array_join("d.candidate_links.text", "|").alias("candidates"), F.array_join("d.post_hrefs", "|").alias("post_hrefs"),
    )


@query(f"""SELECT page_id, 'Page ' || i AS title, 13 AS total_links, 6 AS blog_links, true AS has_blog_keywords, 2 AS builder_elements FROM ({MADE})""")
def main_page_profile(spark, sf):
    return extract.main_page_profile(_made(spark, sf), SITE).join(_made(spark, sf).select("page_id", "url"), "url").drop("url")


WORDS = "CASE WHEN k10 <> 7 THEN 'Part ' || i || ' Some words & more of ' || i || '. Second paragraph. Cap ' || i || ' Up none in m again' ELSE 'A text that is longer than fifty characters in all, number ' || i || ' Cap ' || i || ' Up none in m again' END"


@query(f"SELECT page_id, {WORDS} AS words, len(string_split({WORDS}, ' ')) AS word_count FROM ({MADE})")
def tree_content(spark, sf):
    """The first content element with enough in it, without scripts; the second one where the first is short."""
    d = extract.tree(_made(spark, sf), "content_html")
    plain = text.one_line(F.replace(F.regexp_replace("d.content_html", "<[^>]*>", " "), F.lit("&amp;"), F.lit("&")))
    return d.select("page_id", F.regexp_replace(plain, " +", " ").alias("words"), text.word_count(plain).cast("long").alias("word_count"))


@query(f"SELECT page_id, CASE WHEN k10 <> 7 THEN '## Part ' || i ELSE 'A text that is longer than fifty characters in all, number ' || i END AS first_line FROM ({MADE})")
def tree_naive_markdown(spark, sf):
    d = extract.tree(_made(spark, sf), "naive_markdown")
    return d.select("page_id", F.split_part("d.naive_markdown", F.lit("\n"), F.lit(1)).alias("first_line"))


@query(f"""SELECT page_id, CASE WHEN k10 <> 7 THEN '## Part ' || i || chr(10) || chr(10) || 'Some words & more of ' || i || '.' || chr(10) || chr(10) || 'Second paragraph.' ELSE 'A text that is longer than fifty characters in all, number ' || i END
 || chr(10) || chr(10) || '![alt ' || i || '](/img/' || i || '.png)' || chr(10) || chr(10) || 'Cap **' || i || '**' AS head FROM ({MADE})""")
def tree_markdown(spark, sf):
    d = extract.tree(_made(spark, sf), "content_markdown")
    return d.select("page_id", F.regexp_extract("d.content_markdown", r"(?s)^(.*?Cap \*\*[0-9]+\*\*)", 1).alias("head"))


@query(f"""SELECT page_id, {TITLE} AS title, (2000 + page_id % 20) || '-01-01' AS published, (2000 + page_id % 20)::INT AS year, 1 AS month, '2_' || i AS id, i AS slug FROM ({MADE})""")
def tree_historical(spark, sf):
    made = _made(spark, sf)
    found = extract.extract_historical(made).join(made.select("url", "page_id"), "url")
    return found.select("page_id", "title", F.col("published_date").alias("published"), "year", "month", "id", "slug")


@query(f"""SELECT page_id, {TITLE} AS title, 'Post about ' || i AS fallback, (2000 + page_id % 20) || '-1-2-' || i AS id, CASE WHEN k4 > 1 THEN 'Default' WHEN k4 = 0 THEN 'Meta ' || i ELSE 'Ann ' || i END AS author, CASE WHEN k10 = 7 THEN 6 ELSE 3 END AS links, (k3 <> 0 AND k10 <> 7)::INT AS images, NULL::VARCHAR AS error FROM ({MADE})""")
def extract_posts_fields(spark, sf):
    """The whole post record of every page; none fails."""
    from ..config import Config

    made = _made(spark, sf)
    found = extract.extract_posts(made, Config(site_url=SITE, default_author="Default")).join(made.select("url", "page_id"), "url")
    return found.select("page_id", "title", F.concat(F.lit("Post about "), F.col("slug")).alias("fallback"), "id", "author", F.size("links").alias("links"), F.size("images").alias("images"), "error")


@query("""SELECT page_id, '# Head ' || i || chr(10) || chr(10) || 'One _two_ **three** `four` [five](https://blog.example.com/p/' || i || ')' || chr(10) || chr(10) || '  * a' || chr(10) || '  * b ' || i || chr(10) || chr(10) || '> quoted' || chr(10) || chr(10) || '    code ' || i || chr(10) || chr(10) || '* * *' || chr(10) || chr(10) || '![pic](https://blog.example.com/i.png)' AS markdown
 FROM (SELECT page_id, page_id::VARCHAR AS i FROM pages)""")
def html_markdown(spark, sf):
    """Cleaned HTML as Markdown: headings, emphasis, code, links, lists, quotes, rules, images; rooted links made full, scripts gone."""
    html = F.concat(
        F.lit("<script>x</script><h1>Head "), _id(), F.lit("</h1><p>One <em>two</em> <strong>three</strong> <code>four</code> <a href='/p/"), _id(), F.lit("'>five</a></p><ul><li>a<li>b "), _id(),
        F.lit("</ul><blockquote>quoted</blockquote><pre>code "), _id(), F.lit("</pre><hr><p class='sqs-x' data-y=1><img src='/i.png' alt=pic></p><style>y</style>"),
    )
    return pages(spark, sf).select("page_id", markdown.html_to_markdown(html, SITE).alias("markdown"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Kept ' || i WHEN 1 THEN 'plain ' || i ELSE '*No content available*' END
 || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Images' || chr(10) || chr(10) || '![Image 1](https://i.example.com/' || i || '.png)' || chr(10) || '*c ' || i || '*' || chr(10) || chr(10) AS body FROM (SELECT page_id, page_id::VARCHAR AS i FROM pages)""")
def markdown_body_choice(spark, sf):
    """A post's body is its HTML, else its Markdown, else its text, else a mark; its images follow."""
    k = F.col("page_id") % 3
    image = F.struct(F.concat(F.lit("https://i.example.com/"), _id(), F.lit(".png")).alias("original_url"), F.lit(None).cast("string").alias("alt_text"), F.concat(F.lit("c "), _id()).alias("caption"))
    link = F.array().cast("array<struct<url:string,text:string,title:string,type:string>>")
    rows = pages(spark, sf).select("page_id", F.when(k == 0, F.concat(F.lit("<p>Kept "), _id(), F.lit("</p>"))).alias("content_html"), F.lit("").alias("content_markdown"), F.when(k < 2, F.concat(F.lit("plain "), _id())).alias("content_text"), F.array(image).alias("images"), link.alias("links"))
    return rows.select("page_id", markdown.markdown_body(SITE).alias("body"))


@query("""SELECT page_id, 'title: T ' || i || chr(10) || 'date: ''2020-01-02''' || chr(10) || 'author: A' || chr(10) || 'layout: post' || chr(10) || 'tags:' || chr(10) || '- x' || chr(10) || '- y' || i || chr(10) || 'slug: s' || i || chr(10) || 'word_count: ' || (page_id + 1) || chr(10) || 'archived_date: ''2024-01-01''' || chr(10) AS front
 FROM (SELECT page_id, page_id::VARCHAR AS i FROM pages)""")
def markdown_front_matter(spark, sf):
    none = F.lit("").cast("string")
    rows = pages(spark, sf).select(
        "page_id", F.concat(F.lit("T "), _id()).alias("title"), F.lit("2020-01-02").alias("published_date"), F.lit("A").alias("author"), none.alias("excerpt"), none.alias("meta_description"), F.array().cast("array<string>").alias("categories"),
        F.array(F.lit("x"), F.concat(F.lit("y"), _id())).alias("tags"), none.alias("url"), F.concat(F.lit("s"), _id()).alias("slug"), (F.col("page_id") + 1).cast("int").alias("word_count"),
        F.array().cast("array<struct<original_url:string>>").alias("images"),
    )
    return rows.select("page_id", markdown.front_matter("2024-01-01").alias("front"))
