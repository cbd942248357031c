"""URL, page and discovery queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import discovery, extract
from ..sources import readers
from .registry import query
from .stand_ins import PROFILE, SITE, events, orders, pages

PARTS = "list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/'), lambda p: p <> '')"
BARE = "regexp_replace(trim(url), '[?#;].*$', '')"
HREFS = "regexp_extract_all(html, '<a[^>]+href=\"([^\"]*)\"', 1)"
ROOT = "regexp_extract(url, '^([a-z]+://[^/]*)', 1)"
NO_QUERY = "regexp_replace(url, '[?#].*$', '')"
ABSOLUTE = f"""CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN 'https:' || href
 WHEN starts_with(href, '/') THEN 'https://blog.example.com' || href WHEN starts_with(href, '?') THEN {NO_QUERY} || href
 WHEN starts_with(href, '#') THEN regexp_replace(url, '#.*$', '') || href ELSE regexp_replace({NO_QUERY}, '[^/]*$', '') || href END"""
LINK_TYPE = "CASE WHEN starts_with(lower({0}), 'mailto:') THEN 'email' WHEN starts_with(lower({0}), 'tel:') THEN 'phone' WHEN contains({0}, 'https://blog.example.com/') THEN 'internal' ELSE 'external' END"
REJECT = "/admin|/login|/contact|/about|/home|\\.pdf|\\.jpg|\\.png|\\.gif|\\.css|\\.js|mailto:|tel:|#|javascript:"


@query(f"SELECT page_id, {BARE} AS canonical, regexp_replace({BARE}, '^http://blog\\.example\\.com(/|$)', 'https://blog.example.com\\1') AS secured FROM pages")
def url_canonicalize(spark, sf):
    canonical = urls.canonical_url(F.col("url"))
    return pages(spark, sf).select("page_id", canonical.alias("canonical"), urls.secured(canonical, SITE).alias("secured"))


@query(f"SELECT DISTINCT {BARE} || '-p' AS url FROM (SELECT url FROM pages UNION ALL SELECT replace(url, '#top', '?page=2') FROM pages) WHERE regexp_matches(url, '^https?://[^/]+') AND regexp_matches(url, '/(en|fr|de|es)/')")
def url_filter_distinct(spark, sf):
    twice = pages(spark, sf).select("url").union(pages(spark, sf).select(F.replace("url", F.lit("#top"), F.lit("?page=2"))))
    return discovery.filtered_urls(twice.select(F.concat(urls.canonical_url(F.col("url")), F.lit("-p?x=1")).alias("url")), PROFILE)


@query(f"""SELECT page_id, array_to_string(p, '/') AS parts, CASE WHEN len(p) >= 5 THEN array_to_string(p[2:5], '-') WHEN len(p) > 0 THEN p[-1] ELSE 'unknown' END AS id,
 CASE WHEN len(p) >= 2 THEN array_to_string(p[-2:], '_') ELSE coalesce(p[-1], 'unknown') END AS historical_id, coalesce(p[-1], '') AS slug FROM (SELECT page_id, {PARTS} AS p FROM pages)""")
def url_parts_slug_id(spark, sf):
    u = F.col("url")
    return pages(spark, sf).select("page_id", F.concat_ws("/", urls.path_parts(u)).alias("parts"), urls.post_id(u).alias("id"), urls.historical_id(u).alias("historical_id"), urls.last_part(u).alias("slug"))


@query(f"""SELECT page_id, NOT regexp_matches(lower(url), '{REJECT}') AND regexp_matches(lower(url), '/en/|/fr/|/de/|/es/') AND len(p) >= 2
 AND ((length(p[-1]) >= 1 AND regexp_matches(p[-1], '[-\\p{{L}}]')) OR len(p) >= 5) AS is_post FROM (SELECT page_id, url, {PARTS} AS p FROM pages)""")
def url_blog_predicate(spark, sf):
    return pages(spark, sf).select("page_id", urls.is_post_url(F.col("url"), PROFILE).alias("is_post"))


@query(f"""SELECT page_id, NOT regexp_matches(lower(url), '{REJECT}') AND (regexp_matches(lower(url), '/blog/|/post/|/posts/|/article/|/articles/|/news/|/writing/|/journal/|/entry/')
 OR (regexp_matches(lower(p[-1]), '^[a-z0-9-]+$') AND length(p[-1]) > 3)) AS looks_like_post, regexp_matches(lower(url), '/blog/|/post/|/posts/|/article/|/articles/') AS in_section FROM (SELECT page_id, url, {PARTS} AS p FROM pages)""")
def url_explorer_predicate(spark, sf):
    return pages(spark, sf).select("page_id", urls.looks_like_post(F.col("url")).alias("looks_like_post"), urls.in_probe_section(F.col("url")).alias("in_section"))


@query("SELECT DISTINCT '/' || part || '/{slug}' AS pattern FROM (SELECT CASE page_id % 4 WHEN 0 THEN 'blog' WHEN 1 THEN 'post' WHEN 2 THEN 'article' END AS part FROM pages) WHERE part IS NOT NULL")
def url_pattern_distinct(spark, sf):
    part = F.element_at(F.array(*map(F.lit, ("blog", "post", "article", "page"))), (F.col("page_id") % 4 + 1).cast("int"))
    made = pages(spark, sf).select(F.concat(F.lit("https://a.example.com/"), part, F.lit("/"), F.col("page_id").cast("string")).alias("url"))
    return made.select(urls.url_pattern(F.col("url")).alias("pattern")).where("pattern IS NOT NULL").distinct()


@query("SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, count(*) AS pages, count(DISTINCT regexp_replace(url, '[?#].*$', '')) AS urls FROM pages GROUP BY 1")
def url_host_breakdown(spark, sf):
    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))
    return pages(spark, sf).groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.count_distinct(F.regexp_replace("url", "[?#].*$", "")).alias("urls"))


@query("""SELECT o_orderkey, CASE WHEN m BETWEEN 1 AND 12 THEN strftime(try_strptime(format('{:04d}-{:02d}-{:02d}', y, m, d), '%Y-%m-%d'), '%Y-%m-%dT%H:%M:%S') END AS published
 FROM (SELECT o_orderkey, year(o_orderdate) AS y, (o_orderkey % 14)::INT AS m, (o_orderkey % 31 + 1)::INT AS d FROM orders)""")
def url_dates(spark, sf):
    from ..functions.dates import iso

    d = orders(spark, sf)
    made = F.concat_ws("/", F.lit("https://a.example.com/blog"), F.year("o_orderdate").cast("string"), (F.col("o_orderkey") % 14).cast("string"), (F.col("o_orderkey") % 31 + 1).cast("string"), F.lit("x"))
    return d.select("o_orderkey", iso(urls.url_date(made)).alias("published"))


@query("""SELECT y AS year, count(*) AS n FROM (SELECT CASE WHEN year(o_orderdate) % 2 = 0 THEN year(o_orderdate)::INT ELSE (year(o_orderdate) - 1)::INT END AS y FROM orders) WHERE y BETWEEN 1990 AND 1996 GROUP BY 1""")
def year_breakdown(spark, sf):
    y = F.year("o_orderdate")
    made = F.concat(F.lit("https://a.example.com/blog/"), (y - F.pmod(y, F.lit(2))).cast("string"), F.lit("/"), y.cast("string"), F.lit("/x"))
    return discovery.year_breakdown(orders(spark, sf).select(made.alias("url")), 1990, 1996)


@query("""SELECT o_orderkey, year(o_orderdate) BETWEEN 1995 AND 1997 AND o_orderkey % 3 = 0 AS historical FROM orders""")
def historical_filter(spark, sf):
    section = F.when(F.col("o_orderkey") % 3 == 0, "/blog/").when(F.col("o_orderkey") % 3 == 1, "/tag/blog/").otherwise("/other/")
    made = F.concat(F.lit("https://a.example.com"), section, F.year("o_orderdate").cast("string"), F.lit("/x"))
    return orders(spark, sf).select("o_orderkey", urls.is_historical(made, low=1995, high=1997).alias("historical"))


@query("""WITH h AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS h1 FROM pages)
SELECT page_id, h1 AS title, rtrim(left(CASE WHEN s = '' THEN 'untitled' ELSE s END, 50), '-') AS slug FROM (
 SELECT page_id, h1, regexp_replace(regexp_replace(regexp_replace(lower(h1), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM h)""")
def page_title_slug(spark, sf):
    title = extract.heading(F.col("html"))
    return pages(spark, sf).select("page_id", title.alias("title"), text.slugify(title).alias("slug"))


ARTICLE = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1), '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {ARTICLE} AS article FROM pages")
def page_article_text(spark, sf):
    return pages(spark, sf).select("page_id", extract.article_text(F.col("html")).alias("article"))


@query(f"""SELECT page_id, len(list_filter(string_split(a, ' '), lambda w: w <> '')) AS words, CASE WHEN length(a) <= 300 THEN a
 WHEN 300 - position('.' IN reverse(left(a, 300))) > 210 AND contains(left(a, 300), '.') THEN left(a, 301 - position('.' IN reverse(left(a, 300)))) ELSE left(a, 300) || '...' END AS excerpt
 FROM (SELECT page_id, {ARTICLE} AS a FROM pages)""")
def page_word_count_excerpt(spark, sf):
    rows = pages(spark, sf).select("page_id", extract.article_text(F.col("html")).alias("a"))
    return rows.select("page_id", text.word_count(F.col("a")).cast("long").alias("words"), text.excerpt(F.col("a")).alias("excerpt"))


LINK_ROWS = f"""SELECT page_id, url, pos, href, {ABSOLUTE} AS target FROM (SELECT page_id, url, unnest({HREFS}) AS href, unnest(range(len({HREFS}))) AS pos FROM pages) WHERE href NOT IN ('', '#', 'javascript:void(0)')"""


@query(f"""SELECT url, min(pos)::BIGINT AS pos, arg_min(href, pos) AS href, target, {LINK_TYPE.format('target')} AS type FROM ({LINK_ROWS}) GROUP BY url, target""")
def page_links_classified(spark, sf):
    return extract.page_links(pages(spark, sf), SITE).withColumn("pos", F.col("pos").cast("long"))


@query(f"""SELECT url, string_agg(target, ' ' ORDER BY pos) FILTER (type = 'internal') AS internal, count(*) FILTER (type = 'external') AS n_external FROM (
 SELECT url, min(pos) AS pos, target, {LINK_TYPE.format('target')} AS type FROM ({LINK_ROWS}) GROUP BY url, target) GROUP BY url""")
def page_link_buckets(spark, sf):
    from ..operators.archive import link_buckets

    links = extract.page_links(pages(spark, sf), SITE)
    item = F.struct("pos", F.col("target").alias("url"), F.lit("").alias("text"), F.lit("").alias("title"), "type")
    buckets = links.groupBy("url").agg(link_buckets(F.array_sort(F.collect_list(item))).alias("b"))
    return buckets.select("url", F.nullif(F.array_join("b.internal.url", " "), F.lit("")).alias("internal"), F.size("b.external").cast("long").alias("n_external"))


@query(f"SELECT DISTINCT {ABSOLUTE} AS url FROM (SELECT url, unnest({HREFS}) AS href FROM pages) WHERE regexp_matches(lower(href), '/th') AND NOT regexp_matches(lower(href), '{REJECT}') AND len(string_split(href, '/')) >= 2 AND regexp_matches(regexp_replace(href, '[?#].*$', ''), '[-\\p{{L}}]')")
def page_post_urls(spark, sf):
    from ..config import UrlProfile

    return discovery.urls_on_pages(pages(spark, sf), SITE, UrlProfile(required=("/th",), min_parts=1, min_slug=1))


@query("SELECT page_id, replace(url, '&amp;', '&') AS loc FROM pages")
def sitemap_loc_extract(spark, sf):
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url>\n <loc> '), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url></urlset>"))
    return pages(spark, sf).select("page_id", F.explode(readers.sitemap_locations(xml)).alias("loc"))


@query("SELECT page_id, 'https://' || page_id || '.example.com/sitemap.xml' AS child FROM pages")
def sitemap_index_children(spark, sf):
    xml = F.concat(F.lit("<sitemapindex><sitemap><loc>https://"), F.col("page_id").cast("string"), F.lit(".example.com/sitemap.xml</loc><lastmod>2024</lastmod></sitemap></sitemapindex>"))
    return pages(spark, sf).select("page_id", F.explode(readers.child_sitemaps(xml)).alias("child"))


@query("SELECT page_id, unnest([url, 'urn:' || page_id, 'https://a.example.com/' || page_id]) AS link FROM pages")
def feed_links(spark, sf):
    n = F.col("page_id").cast("string")
    feed = F.concat(F.lit("<rss><item><link> "), F.col("url"), F.lit(" </link></item></rss><feed><entry><id>urn:"), n, F.lit('</id><link rel="alternate" href="https://a.example.com/'), n, F.lit('"/></entry></feed>'))
    return pages(spark, sf).select("page_id", F.explode(readers.feed_links(feed)).alias("link"))


@query("SELECT page_id, unnest([url, 'https://a.example.com/s.xml']) AS sitemap FROM pages")
def robots_sitemaps(spark, sf):
    robots = F.concat(F.lit("User-agent: *\nDisallow: /x\nSitemap: "), F.col("url"), F.lit("\r\n sitemap:https://a.example.com/s.xml\n"))
    return pages(spark, sf).select("page_id", F.explode(readers.robots_sitemaps(robots)).alias("sitemap"))


@query("SELECT 'crawl' AS method, count(DISTINCT url) AS urls FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT 'feed', count(DISTINCT url) FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT 'sitemap', count(DISTINCT url) FROM pages")
def discovery_methods(spark, sf):
    p = pages(spark, sf)
    return discovery.method_counts(discovery.union_methods({"sitemap": p, "feed": p.where("page_id % 3 = 0"), "crawl": p.where("page_id % 2 = 0")}))


HITS = "SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS page, (event_type = 'purchase')::INT AS hit FROM events"


@query(f"""WITH h AS ({HITS}), m AS (SELECT *, CASE WHEN (count(*) OVER f5 = 5 AND sum(hit) OVER f5 = 0) OR (page >= 15 AND count(*) OVER f3 = 3 AND sum(hit) OVER f3 = 0) THEN page END AS stop FROM h
 WINDOW f5 AS (PARTITION BY user_id ORDER BY page ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), f3 AS (PARTITION BY user_id ORDER BY page ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT user_id, page, hit FROM (SELECT *, min(stop) OVER (PARTITION BY user_id) AS e FROM m) WHERE e IS NULL OR page <= e""")
def pagination_stop(spark, sf):
    return discovery.pages_until_empty(_hits(spark, sf), ["user_id"]).select("user_id", "page", "hit")


def _hits(spark, sf):
    from pyspark.sql import Window

    page = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return events(spark, sf).select("user_id", page.alias("page"), (F.col("event_type") == "purchase").cast("int").alias("hit"))


@query(f"SELECT user_id, min(page) AS page FROM ({HITS}) WHERE hit > 0 GROUP BY user_id")
def first_hit_template(spark, sf):
    return discovery.first_hit(_hits(spark, sf), ["user_id"], "page").select("user_id", "page")


@query("""SELECT base, t.template, p.page, base || CASE WHEN contains(base, '?') AND starts_with(t.form, '?') THEN '&' || substr(replace(t.form, '{}', p.page::VARCHAR), 2) ELSE replace(t.form, '{}', p.page::VARCHAR) END AS url
 FROM (SELECT DISTINCT 'https://a.example.com/' || lang || CASE WHEN lang = 'en' THEN '?v=1' ELSE '' END AS base FROM documents),
 (VALUES (0, '?page={}'), (1, '?offset={}'), (2, '/page/{}'), (3, '?p={}'), (4, '?start={}'), (5, '&page={}')) t(template, form), (SELECT unnest(range(1, 26))::INT AS page) p""")
def listing_urls(spark, sf):
    from .stand_ins import documents

    bases = documents(spark, sf).select(F.concat(F.lit("https://a.example.com/"), "lang", F.when(F.col("lang") == "en", "?v=1").otherwise("")).alias("base")).distinct()
    return discovery.listing_urls(bases)
