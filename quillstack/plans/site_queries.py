"""Discovery over listing pages, archives and their records, written around the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import UrlProfile
from ..functions import text, urls
from ..operators import archive, assets, discovery, extract, incremental, state, validate
from .registry import query
from .stand_ins import SITE, documents, events, orders, pages, posts

PROFILE = UrlProfile(required=("/post-",), min_parts=1, min_slug=1)
HOST = "regexp_extract(url, '^([a-z]+://[^/]*)', 1)"


def _id():
    return F.col("page_id").cast("string")


def _listing(spark, sf) -> DataFrame:
    """(url, html): a listing page for each year and place that ids fall into, linking to the ids' posts; the first place of a third of the years is missing."""
    year, k = 2005 + F.pmod("page_id", F.lit(10)), F.pmod(F.floor(F.col("page_id") / 10), F.lit(3))
    place = F.when(k == 0, F.concat(F.lit("/notes/"), year.cast("string"))).when(k == 1, F.concat(F.lit("/notes?year="), year.cast("string"))).otherwise(F.concat(F.lit("/blog/"), year.cast("string")))
    rows = pages(spark, sf).where((year % 3 != 0) | (k > 0)).select(F.concat(F.lit("https://blog.example.com"), place).alias("url"), F.concat(F.lit('<li><a href="/post-'), _id(), F.lit('">p</a>')).alias("link"))
    return rows.groupBy("url").agg(F.concat(F.lit("<ul>"), F.array_join(F.array_sort(F.collect_list("link")), ""), F.lit("</ul>")).alias("html"))


LISTED = "SELECT page_id, 2005 + page_id % 10 AS y, (page_id // 10) % 3 AS k FROM pages"


@query(f"""WITH l AS (SELECT * FROM ({LISTED}) WHERE y % 3 <> 0 OR k > 0), f AS (SELECT y, min(k) AS k FROM l GROUP BY y) SELECT 'https://blog.example.com/post-' || page_id AS url FROM l JOIN f USING (y, k)""")
def historical_scan(spark, sf):
    """Of each year's places the first that has posts: the others' posts are not found."""
    return discovery.historical_scan(_listing(spark, sf), SITE, range(2005, 2015), ("notes",), PROFILE)


@query("""SELECT site, place, site || path AS url FROM (SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/]*)', 1) AS site FROM pages), (VALUES (0, '/sitemap.xml'), (1, '/sitemap_index.xml'), (2, '/sitemap-posts.xml'), (3, '/sitemap-blog.xml'), (4, '/sitemap/posts.xml'),
 (5, '/sitemap/blog.xml'), (6, '/sitemaps/sitemap.xml'), (7, '/blog-sitemap.xml'), (8, '/posts-sitemap.xml')) t(place, path)""")
def sitemap_places(spark, sf):
    return discovery.places(_sites(spark, sf), discovery.SITEMAP_PLACES)


@query("""SELECT site, count(*) AS n, string_agg(site || path, ' ' ORDER BY path) FILTER (contains(path, 'notes')) AS of_section FROM (SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/]*)', 1) AS site FROM pages), (SELECT unnest(['/rss', '/feed', '/feeds', '/atom.xml',
 '/rss.xml', '/feed.xml', '/blog/rss', '/blog/feed', '/notes/rss', '/notes/feed', '/blog.rss', '/?format=rss', '/notes?format=rss']) AS path) GROUP BY site""")
def feed_places(spark, sf):
    found = discovery.places(_sites(spark, sf), discovery.expanded(discovery.FEED_PLACES, ("notes",)))
    mine = F.sort_array(F.collect_list(F.when(F.col("url").contains("notes"), F.col("url"))))
    return found.groupBy("site").agg(F.count("*").alias("n"), F.array_join(mine, " ").alias("of_section"))


def _sites(spark, sf):
    return pages(spark, sf).select(F.regexp_extract("url", "^([a-z]+://[^/]*)", 1).alias("site")).distinct()


def _sections(spark, sf):
    """Section and archive pages of one site, each linking to the posts of the ids that fall to it."""
    paths = F.array(*map(F.lit, ("/notes", "/blog-archive", "/?view=archive", "/archive", "/blog", "/journal/", "/posts/archive")))
    at = F.element_at(paths, (F.col("page_id") % 7 + 1).cast("int"))
    rows = pages(spark, sf).select(F.concat(F.lit("https://blog.example.com"), at).alias("url"), F.concat(F.lit('<a class=x href="/post-'), _id(), F.lit('">p</a> <a href="/about">no</a>')).alias("link"))
    return rows.groupBy("url").agg(F.array_join(F.array_sort(F.collect_list("link")), "").alias("html"))


def _posts_of(spark, sf, paths):
    site = spark.createDataFrame([("https://blog.example.com/",)], "site string")
    return discovery.posts_at(discovery.places(site, discovery.expanded(paths, ("notes",))), _sections(spark, sf), SITE, PROFILE).select("place", F.element_at(F.split("post", "/"), -1).alias("post"))


@query("SELECT (page_id % 7)::INT AS place, 'post-' || page_id AS post FROM pages WHERE page_id % 7 < 3")
def section_scan(spark, sf):
    return _posts_of(spark, sf, discovery.SECTION_PLACES)


@query("SELECT CASE page_id % 7 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS place, 'post-' || page_id AS post FROM pages WHERE page_id % 7 IN (1, 2, 3)")
def archive_scan(spark, sf):
    return _posts_of(spark, sf, discovery.ARCHIVE_PLACES)


@query("SELECT CASE page_id % 7 WHEN 4 THEN 0 ELSE 11 END AS place, 'post-' || page_id AS post FROM pages WHERE page_id % 7 IN (4, 5)")
def explored_sections(spark, sf):
    return _posts_of(spark, sf, discovery.EXPLORED_SECTIONS)


@query("SELECT CASE page_id % 7 WHEN 3 THEN 0 WHEN 2 THEN 2 ELSE 4 END AS place, 'post-' || page_id AS post FROM pages WHERE page_id % 7 IN (2, 3, 6)")
def explored_archives(spark, sf):
    return _posts_of(spark, sf, discovery.EXPLORED_ARCHIVES)


@query("""SELECT 'https://s' || page_id || '.example.com' AS site, 'https://s' || page_id || '.example.com' || CASE WHEN page_id % 2 = 0 THEN '/' ELSE '/posts/' END AS blog_url, 2 AS n_posts, '/blog/{slug}' AS patterns FROM pages""")
def blog_structure(spark, sf):
    """A site's main page where it has articles, else its posts page."""
    site = F.concat(F.lit("https://s"), _id(), F.lit(".example.com"))
    body = F.lit("<article><a href='/blog/one'>1</a></article><div class=entry><a href='/blog/two'>2</a><a href='/x'>3</a></div>")
    main = pages(spark, sf).select(F.concat(site, F.lit("/")).alias("url"), F.when(F.col("page_id") % 2 == 0, body).otherwise("<p>none</p>").alias("html"))
    rest = pages(spark, sf).select(F.concat(site, F.lit("/posts/")).alias("url"), body.alias("html"))
    return discovery.blog_structure(pages(spark, sf).select(site.alias("site")), main.union(rest)).withColumn("patterns", F.array_join("patterns", ","))


@query("""WITH u AS (SELECT DISTINCT url FROM pages), p AS (SELECT url FROM u WHERE regexp_matches(lower(url), '/blog/|/post/|/posts/|/article/|/articles/|/news/|/writing/|/journal/|/entry/') OR (regexp_matches(regexp_extract(regexp_replace(regexp_replace(lower(url), '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '([^/]*)/*$', 1), '^[a-z0-9-]{4,}$')))
SELECT 'url' AS kind, url, (row_number() OVER (ORDER BY url))::INT AS rank FROM u QUALIFY rank <= 20 UNION ALL
SELECT 'post', url, (row_number() OVER (ORDER BY url))::INT AS rank FROM p WHERE NOT regexp_matches(lower(url), '/admin|/login|/contact|/about|/home|\\.pdf|\\.jpg|\\.png|\\.gif|\\.css|\\.js|mailto:|tel:|#|javascript:') QUALIFY rank <= 10""")
def explorer_preview(spark, sf):
    return discovery.explorer_report(pages(spark, sf))


@query("SELECT 'https://blog.example.com/post-' || page_id AS url FROM pages")
def crawl_union(spark, sf):
    """Posts that pages link to, and those on the page that a navigation link names."""
    even = pages(spark, sf).where("page_id % 2 = 0").select(F.concat(F.lit("https://blog.example.com/page/"), _id()).alias("url"), F.concat(F.lit("<nav><a href='/hub'>All articles</a></nav><p><a href=\"/post-"), _id(), F.lit("\">p</a>")).alias("html"))
    odd = pages(spark, sf).where("page_id % 2 = 1").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<a href="/post-'), _id(), F.lit('">p</a>')))), "").alias("html")).select(F.lit("https://blog.example.com/hub").alias("url"), "html")
    return discovery.crawl(even.union(odd), SITE, PROFILE)


@query("SELECT 'a' AS method, url FROM pages UNION ALL SELECT 'b', url FROM pages WHERE page_id % 2 = 0")
def method_rows(spark, sf):
    """Methods' URLs one after the other, a URL as often as methods have it."""
    p = pages(spark, sf)
    return discovery.union_methods({"a": p, "b": p.where("page_id % 2 = 0")}).select("method", "url")


# ---- archive records --------------------------------------------------------------------------------------------------------------


def _flat(spark, sf) -> DataFrame:
    """Documents as validated posts with images, links and dates."""
    p = posts(spark, sf)
    k = F.col("pos") % 4
    image = F.struct(F.concat(F.lit("https://i.example.com/"), "id", F.lit(".png")).alias("original_url"), F.lit("a").alias("alt_text"), F.lit("").alias("title"), F.lit("c").alias("caption"), F.lit(10).alias("width"), F.lit(None).cast("int").alias("height"))
    link = lambda kind: F.struct(F.concat(F.lit(f"{kind}:"), "id").alias("url"), F.lit("t").alias("text"), F.lit("").alias("title"), F.lit(kind).alias("type"))
    none = F.lit(None).cast("string")
    return p.select(
        "pos", "url", "id", F.concat(F.lit("s"), "id").alias("slug"), "title", none.alias("meta_description"), "author", none.alias("content_html"), "content_text", F.lit("").alias("content_markdown"), "excerpt", "word_count",
        F.when(k > 0, F.concat(F.lit("2024-01-"), F.lpad((F.col("pos") % 28 + 1).cast("string"), 2, "0"))).alias("published_date"), none.alias("modified_date"), none.alias("scraped_at"), none.alias("extracted_at"), "categories", "tags",
        F.when(k == 1, F.array(image)).otherwise(F.array().cast("array<struct<original_url:string,alt_text:string,title:string,caption:string,width:int,height:int>>")).alias("images"),
        F.array(link("internal"), link("email"), link("odd"), link("phone"), link("external")).alias("links"),
        F.struct(F.lit(0).alias("issues_found"), F.array().cast("array<string>").alias("issues")).alias("validation"),
    )


DATED = "CASE WHEN doc_id % 4 > 0 THEN '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') END"


@query(f"""SELECT doc_id::VARCHAR AS id, coalesce({DATED}, '') AS published_date, '' AS html, md5(text) AS text_md5, source AS category, lang AS tag, CASE WHEN doc_id % 4 = 1 THEN 'https://i.example.com/' || doc_id || '.png' END AS image, CASE WHEN doc_id % 4 = 1 THEN 10 END AS width,
 'odd:' || doc_id || ' external:' || doc_id AS external, 'internal:' || doc_id AS internal FROM documents""")
def archived_projection(spark, sf):
    """The nested record: missing strings empty, sizes in their struct, links in their buckets, unknown kinds external."""
    a = archive.archived_posts(_flat(spark, sf))
    image = F.try_element_at("assets.images", F.lit(1))
    return a.select(
        "id", "published_date", "content.html", F.md5("content.text").alias("text_md5"), F.element_at("metadata.categories", 1).alias("category"), F.element_at("metadata.tags", 1).alias("tag"),
        image["original_url"].alias("image"), image["dimensions"]["width"].alias("width"), F.array_join("assets.links.external.url", " ").alias("external"), F.array_join("assets.links.internal.url", " ").alias("internal"),
    )


@query(f"""SELECT count(*) AS posts, count(*) AS valid_posts, count(*) FILTER (doc_id % 4 > 0) AS posts_with_dates, count(*) FILTER (coalesce(text, '') <> '') AS posts_with_content, 100.0::DOUBLE AS completeness FROM documents""")
def archive_completeness(spark, sf):
    a = archive.archived_posts(_flat(spark, sf).withColumn("title", F.concat(F.lit("t"), "title")))
    return archive.completeness(a)


@query(f"""SELECT source AS category, coalesce({DATED}, '') AS date, doc_id AS pos, doc_id::VARCHAR AS id FROM documents""")
def category_index_rows(spark, sf):
    return archive.index_rows(_flat(spark, sf), F.explode("categories"), "category").drop("title")


@query(f"""SELECT strftime(d, '%Y') AS year, string_agg(m || ':' || n, ' ' ORDER BY m) AS months FROM (SELECT o_orderdate AS d, strftime(o_orderdate, '%Y-%m') AS m, count(*) OVER (PARTITION BY strftime(o_orderdate, '%Y-%m')) AS n, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1 GROUP BY 1""")
def timeline_nested(spark, sf):
    """year -> month -> posts; here how many posts each month has."""
    o = orders(spark, sf).select(F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("id"), F.lit("").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_date"))
    years = archive.nested_timeline(archive.timeline(o)).select(F.explode("index").alias("year", "months"))
    return years.select("year", F.array_join(F.transform(F.map_entries("months"), lambda e: F.concat(e["key"], F.lit(":"), F.size(e["value"]).cast("string"))), " ").alias("months"))


@query("SELECT count(*) AS total_posts, '2024-01-01' AS generated_at FROM documents")
def basic_metadata(spark, sf):
    return archive.basic_metadata(documents(spark, sf), "2024-01-01")


@query("""SELECT count(*) AS total, count(*) FILTER (quality = 1) AS extracted, count(*) FILTER (quality = 0) AS failed, 100.0::DOUBLE * count(*) FILTER (quality = 1) / count(*) AS success_rate, round(avg(nullif(n_chars, 0)) FILTER (quality = 1), 6) AS average_words FROM documents JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)""")
def historical_summary(spark, sf):
    from ..sources.readers import table

    lab = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = documents(spark, sf).join(lab, "doc_id").withColumnRenamed("n_chars", "word_count")
    return archive.historical_summary(d.where("quality = 1"), d.where("quality = 0")).withColumn("average_words", F.round("average_words", 6))


@query("""SELECT page_id, pos::INT AS pos, 'https://i.example.com/' || page_id || '/' || pos AS url, CASE WHEN pos = 1 AND page_id % 2 = 0 THEN 'p' || page_id ELSE '' END AS local_path, CASE WHEN pos = 1 THEN CASE WHEN page_id % 2 = 0 THEN 'success' ELSE 'failed' END ELSE 'skipped' END AS status FROM pages, (SELECT unnest([0, 1, 2]) AS pos)""")
def local_image_paths(spark, sf):
    """Images with the ledger's path and status, in order."""
    image = lambda n: F.struct(F.concat(F.lit("https://i.example.com/"), _id(), F.lit(f"/{n}")).alias("original_url"), F.lit("").alias("alt_text"))
    p = pages(spark, sf).select(F.col("page_id").alias("id"), F.array(image(0), image(1), image(2)).alias("images"))
    even = F.col("page_id") % 2 == 0
    ledger = pages(spark, sf).select(F.concat(F.lit("https://i.example.com/"), _id(), F.lit("/1")).alias("original_url"), F.when(even, F.concat(F.lit("p"), _id())).alias("local_path"), F.when(even, "success").otherwise("failed").alias("status"))
    found = assets.with_local_paths(p, ledger).select(F.col("id").alias("page_id"), F.explode("images").alias("i"))
    return found.select("page_id", F.col("i.at").alias("pos"), F.col("i.original_url").alias("url"), "i.local_path", "i.status")


@query("SELECT doc_id, least(n_chars, 1920) AS width, CASE WHEN n_chars > 1920 THEN (1080 * 1920 // n_chars)::INT ELSE 1080 END AS height FROM documents")
def fitted_image_sizes(spark, sf):
    width, height = assets.fitted_size(F.col("n_chars"), F.lit(1080), 1920)
    return documents(spark, sf).select("doc_id", width.alias("width"), height.alias("height"))


# ---- validation pieces ------------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, concat_ws('|', CASE WHEN k = 0 THEN 'Missing required field: url' END, CASE WHEN k = 1 THEN 'Missing required field: title' END, CASE WHEN k = 2 THEN 'Missing required field: id' END) AS issues, CASE WHEN k = 1 THEN 'Post ' || doc_id ELSE 'T' END AS title, CASE WHEN k = 2 THEN 'post-' || doc_id ELSE 'i' END AS id
 FROM (SELECT doc_id, doc_id % 4 AS k FROM documents)""")
def required_fields(spark, sf):
    k = F.col("doc_id") % 4
    issues, title, id_ = validate.required_fields(F.col("doc_id"), F.when(k > 0, "u").otherwise(""), F.when(k != 1, "T"), F.when(k != 2, "i").otherwise(""))
    return documents(spark, sf).select("doc_id", F.array_join(issues, "|").alias("issues"), title.alias("title"), id_.alias("id"))


@query("""SELECT doc_id, CASE k WHEN 0 THEN 'https://blog.example.com/' || doc_id WHEN 1 THEN 'not a url' WHEN 2 THEN '' ELSE 'https://other.example.com/x/' END AS url, CASE k WHEN 1 THEN 'Invalid URL format: not a url' WHEN 2 THEN 'URL is empty' ELSE '' END AS issues, CASE k WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN 'not a url' ELSE '' END AS slug
 FROM (SELECT doc_id, doc_id % 4 AS k FROM documents)""")
def cleaned_urls(spark, sf):
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, F.concat(F.lit(" http://blog.example.com/"), F.col("doc_id").cast("string"), F.lit(" "))).when(k == 1, "not a url").when(k == 2, "  ").otherwise("https://other.example.com/x/")
    url, issues = validate.clean_url(raw, SITE)
    return documents(spark, sf).select("doc_id", url.alias("url"), F.array_join(issues, "|").alias("issues"), urls.slug_of(url).alias("slug"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 12 WHEN 2 THEN 0 WHEN 3 THEN 3 ELSE -4 END AS word_count, CASE WHEN doc_id % 5 = 2 THEN 'Invalid word count format' ELSE '' END AS issues, 'a|b ' || doc_id AS taxonomy FROM documents""")
def cleaned_counts_and_taxonomy(spark, sf):
    k = F.col("doc_id") % 5
    raw = F.when(k == 0, "0").when(k == 1, " 12 ").when(k == 2, "twelve").when(k == 3, F.lit(None).cast("string")).otherwise("-4")
    count, issues = validate.clean_word_count(raw, F.lit("three words  here"))
    values = F.array(F.lit(" a "), F.lit("a"), F.lit(" "), F.lit(None).cast("string"), F.concat(F.lit("b "), F.col("doc_id").cast("string")), F.lit("a"))
    return documents(spark, sf).select("doc_id", count.alias("word_count"), F.array_join(issues, "|").alias("issues"), F.array_join(validate.clean_taxonomy(values), "|").alias("taxonomy"))


@query("""SELECT doc_id, 'https://i.example.com/' || doc_id || ',https://i.example.com/b' AS images, '100,-1' AS widths, 'Image 1 missing URL' AS image_issues, 'https://x.example.com/' || doc_id || ' external,mailto:a@b email,https://blog.example.com/y internal' AS links, 'Link 2 missing URL' AS link_issues FROM documents""")
def cleaned_images_and_links(spark, sf):
    """Images without a URL go, sizes become numbers or nothing; links keep the first of each URL and get a type where theirs is unknown."""
    d = F.col("doc_id").cast("string")
    image = lambda url, width: F.struct(url.alias("original_url"), F.lit("").alias("alt_text"), F.lit("").alias("title"), F.lit("").alias("caption"), F.lit(width).alias("width"), F.lit("auto").alias("height"))
    link = lambda url, kind: F.struct(url.alias("url"), F.lit("t").alias("text"), F.lit("").alias("title"), F.lit(kind).alias("type"))
    images, image_issues = validate.clean_images(F.array(image(F.concat(F.lit(" https://i.example.com/"), d), " 100"), image(F.lit(" "), "1"), image(F.lit("https://i.example.com/b"), "auto")))
    x = F.concat(F.lit("https://x.example.com/"), d)
    links, link_issues = validate.clean_links(F.array(link(x, "foo"), link(F.lit("mailto:a@b"), ""), link(F.lit(""), "email"), link(F.concat(x, F.lit(" ")), "internal"), link(F.lit("https://blog.example.com/y"), "internal")), SITE)
    return documents(spark, sf).select(
        "doc_id", F.array_join(images["original_url"], ",").alias("images"), F.array_join(F.transform(images, lambda i: F.coalesce(i["width"], F.lit(-1)).cast("string")), ",").alias("widths"), F.array_join(image_issues, "|").alias("image_issues"),
        F.array_join(F.transform(links, lambda x: F.concat_ws(" ", x["url"], x["type"])), ",").alias("links"), F.array_join(link_issues, "|").alias("link_issues"),
    )


@query("""SELECT 'Posts: ' || count(*) || chr(10) || 'Valid: ' || count(*) || chr(10) || 'With issues: 0' || chr(10) || 'Rejected: 0' || chr(10) || 'Issues: 0' || chr(10) || 'Fixes: 0' || chr(10) || 'Success rate: 100.0%' AS summary FROM documents""")
def validation_summary(spark, sf):
    flat = _flat(spark, sf).withColumn("fixes", F.lit(0))
    return validate.validation_summary(validate.validation_report(flat, flat))


# ---- names, keys, text ------------------------------------------------------------------------------------------------------------


@query("""SELECT page_id, '2020-01-02_A_title_' || page_id || '_with_marks' AS filename, 'Some Post_' || page_id || ' Here' AS spaced FROM pages""")
def historical_names(spark, sf):
    made = text.historical_filename(F.lit("2020-01-02T03"), F.concat(F.lit("A title! "), _id(), F.lit(" with: marks?  ")))
    return pages(spark, sf).select("page_id", made.alias("filename"), F.replace(text.title_from_slug(F.concat(F.lit("some-post_"), _id(), F.lit("-here.html"))), F.lit("Post "), F.lit("Post_")).alias("spaced"))


@query("SELECT page_id, md5(url || '|' || left(html, 100)) AS key FROM pages")
def page_cache_keys(spark, sf):
    return pages(spark, sf).select("page_id", state.cache_key(F.col("url"), F.col("html")).alias("key"))


@query("""SELECT page_id, 'https://blog.example.com' || t AS target FROM (SELECT page_id, unnest(['/a/c/' || page_id, '/' || page_id, '/a/b/', '/a/', '/x?q=../y', '/a/b/d#./e']) AS t FROM pages)""")
def dot_segments(spark, sf):
    """References with . and .. against /a/b/page."""
    forms = F.array(F.concat(F.lit("../c/"), _id()), F.concat(F.lit("../../../"), _id()), F.lit("."), F.lit(".."), F.lit("/./z/../x?q=../y"), F.lit("./d#./e"))
    rows = pages(spark, sf).select("page_id", F.explode(forms).alias("href"))
    return rows.select("page_id", urls.absolute_url(F.col("href"), SITE, F.lit("https://blog.example.com/a/b/page?x=1")).alias("target"))


CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '[ \t]+(\n|$)', '\1', 'g'), '\n\s*\n\s*\n', chr(10) || chr(10), 'g'), '\n\s*\n(\s*[-*+])', chr(10) || '\1', 'g'), '\n+(#{1,6} )', chr(10) || chr(10) || '\1', 'g'), '^\s+|\s+$', '', 'g')"


@query(f"""SELECT doc_id, {CLEAN} AS markdown FROM (SELECT doc_id, 'x' || doc_id || '  ' || chr(10) || chr(10) || chr(10) || chr(10) || '- a' || chr(10) || chr(10) || '- b' || chr(10) || '# Head ' || doc_id || chr(10) || 'one' || chr(10) || chr(10) || 'two  ' || chr(10) || ' ' || chr(10) || '## Next' || chr(10) || chr(10) || chr(10) || 'end' || chr(10) AS m FROM documents)""")
def markdown_cleaning(spark, sf):
    d = F.col("doc_id").cast("string")
    m = F.concat(F.lit("x"), d, F.lit("  \n\n\n\n- a\n\n- b\n# Head "), d, F.lit("\none\n\ntwo  \n \n## Next\n\n\nend\n"))
    return documents(spark, sf).select("doc_id", text.clean_markdown(m).alias("markdown"))


# ---- state ------------------------------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT count(*) AS total FROM events), r AS (SELECT unnest(range(1, 11)) AS k) SELECT CASE WHEN k = 10 THEN total ELSE (k * total + 9) // 10 END AS n, total, CASE WHEN k = 10 THEN 100 ELSE 10 * k END::BIGINT AS percent FROM t, r""")
def progress_marks(spark, sf):
    return state.progress_marks(events(spark, sf))


@query("""SELECT count(*) AS total_operations, date_diff('second', min(ts), max(ts))::DOUBLE AS execution_time_seconds, max(value) AS peak_memory_mb, arg_max(value, (ts, value)) AS memory_usage_mb, round(count(*) / date_diff('second', min(ts), max(ts)), 6) AS operations_per_second FROM events""")
def run_metrics(spark, sf):
    return state.run_metrics(events(spark, sf), "ts", "value").withColumn("operations_per_second", F.round("operations_per_second", 6))


@query("""SELECT event_id, coalesce(nullif(concat_ws('|', CASE WHEN value > 2048 THEN 'memory: smaller partitions' END, CASE WHEN value < 0.5 THEN 'speed: look at the source' END, CASE WHEN value > 90 THEN 'processor: fewer tasks at a time' END, CASE WHEN event_id % 2 = 0 THEN 'cache: hardly used' END), ''), 'nothing to change') AS advice FROM events""")
def recommendations(spark, sf):
    v = F.col("value")
    return events(spark, sf).select("event_id", F.array_join(state.recommendations(v, v, v, F.when(F.col("event_id") % 2 == 0, 0.1).otherwise(0.5)), "|").alias("advice"))


@query("SELECT count(DISTINCT user_id) AS size, 1000::BIGINT AS max_size, count(DISTINCT user_id) / 1000.0::DOUBLE AS utilization FROM events")
def cache_stats(spark, sf):
    return state.cache_stats(events(spark, sf), "user_id", 1000)


@query("""SELECT count(*) FILTER (event_id % 3 = 0) AS retried_urls, count(*) FILTER (event_id % 6 = 0) AS successful_retries FROM events""")
def retry_summary(spark, sf):
    before = events(spark, sf).select("event_id", F.when(F.col("event_id") % 3 == 0, "failed").otherwise("completed").alias("status"))
    after = events(spark, sf).select("event_id", F.when(F.col("event_id") % 2 == 0, "completed").otherwise("failed").alias("status"))
    return state.retry_summary(before, after, "event_id")


@query("""SELECT count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed, count(*) AS total, 100.0::DOUBLE * count(*) FILTER (event_type = 'purchase') / count(*) AS completion_rate, 90.0::DOUBLE AS elapsed_seconds FROM events""")
def completion_summary(spark, sf):
    import datetime

    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("seen")
    began = datetime.datetime(2024, 1, 1)
    return state.completion_summary(events(spark, sf).select(status.alias("status")), began, began + datetime.timedelta(seconds=90))


@query("SELECT ts, event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def seen_once(spark, sf):
    """Each key once, the latest row: what a replayed stream leaves."""
    rows = events(spark, sf).withColumn("order", F.struct("ts", "event_id"))
    return archive.last_by_key(rows, "user_id", "order").select("ts", "event_id", "user_id")
