"""Pages to posts.

A page is parsed once, in one Arrow-batched function that returns every field of the tree as a struct; dates, ids, links' types and whatever
else expressions can do is done by expressions. ``article_fields`` is the form without any Python, for pages with plain markup.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import dates, text, urls
from ..functions.dom import Node, markdown, parse
from ..schemas import IMAGE_RAW
from ..shipping import ship

# Selectors, in order of preference.
TITLES = ("h1.entry-title", ".entry-header h1", ".blog-item-title", "h1", "title")
CONTENTS = (".blog-item-content-wrapper", ".entry-content", ".blog-item-wrapper .sqs-block-content", ".blog-basic-grid--text", "article .entry-content", ".post-content", ".content")
AUTHORS = (".blog-meta-item .author", ".entry-author", ".by-author", ".author-name", 'meta[name="author"]')
DATES = (".blog-meta .date", ".entry-date", ".post-date", "time[datetime]")
CATEGORIES = (".blog-meta-item .category", ".categories a", ".cat-links a", '[rel="category tag"]')
TAGS = (".blog-meta-item .tag", ".tags a", ".tag-links a", '[rel="tag"]')
CAPTIONS = (".caption", ".wp-caption-text", "figcaption")
LINKS = (".blog-item-content-wrapper a", ".entry-content a", "article a")
NAVIGATION = ("nav", ".nav", ".navigation", ".menu", ".header-nav", '[data-nc-group="top"]', ".header-menu", ".main-nav")
NAVIGATION_WORDS = ("blog", "posts", "articles", "news", "writing", "journal")
BUILDER_ELEMENTS = (".blog-item", ".blog-item-wrapper", '[data-controller="BlogItem"]', ".blog-basic-grid--text", ".blog-list-item", ".entry-wrap", ".journal-entry")
POST_ELEMENTS = (".blog-item", ".entry", ".post", '[data-controller="BlogItem"]', ".blog-item-wrapper")
POST_LINKS = ('a[href*="/blog/"]', ".blog-item a", ".entry a", "article a", '[data-controller="BlogItem"] a', ".blog-item-wrapper a")
HISTORICAL_TITLES = ("h1.entry-title", "h1", ".entry-title", ".post-title", "title", "h2.entry-title")
HISTORICAL_CONTENTS = (".entry-content", ".post-content", ".content", "article", ".entry", ".post-body", ".main-content")

PROFILE_WORDS = "blog|posts|articles|recent|latest"

RAW_LINK = "struct<href:string,text:string,title:string>"
DOM = (
    "title string, meta_description string, author string, content_html string, content_text string, content_markdown string, naive_markdown string, "
    "meta_published string, meta_modified string, ld_json string, dom_date string, categories array<string>, tags array<string>, "
    f"images array<{IMAGE_RAW}>, links array<{RAW_LINK}>, all_links array<{RAW_LINK}>, nav_links array<{RAW_LINK}>, post_hrefs array<string>, "
    "builder_counts array<struct<selector:string,count:int>>, article_count int, has_post_elements boolean, has_navigation boolean, "
    f"candidate_links array<{RAW_LINK}>, page_title string, body_text string, historical_title string, historical_content string, error string"
)


def _flat(node: Node) -> str:
    return " ".join(node.text().split())


def _first_text(root: Node, selectors: tuple[str, ...]) -> str | None:
    for selector in selectors:
        node = root.first(selector)
        if node is not None:
            found = node.attrs.get("content", "") if node.tag == "meta" else node.attrs.get("datetime") or _flat(node) if node.tag == "time" else _flat(node)
            if found.strip():
                return found.strip()
    return None


def _all_texts(root: Node, selectors: tuple[str, ...]) -> list[str]:
    return list(dict.fromkeys(t for s in selectors for n in root.select(s) if (t := _flat(n))))


def _meta(root: Node, selector: str) -> str | None:
    node = root.first(selector)
    return node.attrs.get("content", "").strip() or None if node is not None else None


def _content(root: Node) -> Node | None:
    """The first content element with more than 50 characters of HTML, else the body."""
    for selector in CONTENTS:
        node = root.first(selector)
        if node is not None and len("".join(c if isinstance(c, str) else c.html() for c in node.children).strip()) > 50:
            return node
    return root.first("body") or root


def _link(node: Node) -> dict:
    return {"href": node.attrs.get("href", ""), "text": _flat(node), "title": node.attrs.get("title", "")}


def _image(node: Node, base: str) -> dict:
    caption = ""
    if node.parent is not None:
        caption = next((_flat(found) for s in CAPTIONS if (found := node.parent.first(s)) is not None), "")
    return {"original_url": _joined(base, node.attrs["src"]), "alt_text": node.attrs.get("alt", ""), "title": node.attrs.get("title", ""), "caption": caption, "width": node.attrs.get("width"), "height": node.attrs.get("height")}


def _joined(base: str, href: str) -> str:
    try:
        return urljoin(base, href)
    except ValueError:
        return href


def _is_icon(node: Node) -> bool:
    """Both sizes given and one, read as a number in turn, below 50."""
    width, height = node.attrs.get("width"), node.attrs.get("height")
    if not width or not height:
        return False
    try:
        return int(width) < 50 or int(height) < 50
    except ValueError:
        return False


def _headed(node: Node) -> str:
    """Plain text in which each heading's own line carries its marks."""
    out = []
    for line in (part.strip() for part in _lines(node)):
        if line:
            out.append(line)
    return "\n".join(out)


def _lines(node: Node) -> Iterator[str]:
    run: list[str] = []
    for child in node.children:
        if isinstance(child, str):
            run.append(child)
        elif child.tag in ("script", "style", "template"):
            continue
        elif child.tag in ("h1", "h2", "h3"):
            yield "".join(run)
            run = []
            yield "#" * int(child.tag[1]) + " " + _flat(child)
        elif child.tag in ("p", "div", "li", "ul", "ol", "article", "section", "blockquote", "br"):
            yield "".join(run)
            run = []
            yield from _lines(child)
        else:
            run.append(child.text())
    yield "".join(run)


def _post_hrefs(root: Node) -> list[str]:
    found = (n.attrs.get("href", "") for s in POST_LINKS for n in root.select(s))
    return list(dict.fromkeys(h for h in found if h and any(p in h.lower() for p in ("/blog/", "/post/", "/posts/", "/article/", "/articles/"))))


def _structured_data(root: Node) -> str | None:
    for node in root.select('script[type="application/ld+json"]'):
        content = "".join(c for c in node.children if isinstance(c, str))
        try:
            data = json.loads(content)
        except ValueError:
            continue
        if isinstance(data, dict) and data.get("@type") in ("BlogPosting", "Article"):
            return content
    return None


def _historical(root: Node) -> tuple[str | None, str | None]:
    """Title over 3 and content over 100 characters; where none passes, the last one found."""
    title = content = None
    for selector in HISTORICAL_TITLES:
        if (node := root.first(selector)) is not None and (found := _flat(node)):
            title = found
            if len(found) > 3:
                break
    for selector in HISTORICAL_CONTENTS:
        if (node := root.first(selector)) is not None:
            content = "\n\n".join(t for t in (p.strip() for p in _lines(node)) if t)
            if len(content) > 100:
                break
    return title, content


def _links_of(root: Node) -> list[dict]:
    found = next((found for s in LINKS if (found := root.select(s))), None) or root.select("a[href]")
    return [_link(n) for n in found if n.attrs.get("href", "") not in ("", "#", "javascript:void(0)")]


def _images_of(root: Node, base: str) -> list[dict]:
    top = next((n for s in (*CONTENTS, "article", "body") if (n := root.first(s)) is not None), root)
    return [_image(n, base) for n in top.select("img") if n.attrs.get("src") and not _is_icon(n)]


def _navigation(root: Node) -> list[dict]:
    """Links of navigation elements whose text speaks of posts, the first of each target."""
    found: dict[str, dict] = {}
    for selector in NAVIGATION:
        for nav in root.select(selector):
            for node in nav.select("a"):
                link = _link(node)
                if link["href"] and any(w in link["text"].lower() for w in NAVIGATION_WORDS):
                    found.setdefault(link["href"], link)
    return [*found.values()]


def _body_text(root: Node) -> str:
    return _flat(root.first("body") or root)


#: Fields that read the tree as it is: name to a function of (root, URL).
READ = {
    "title": lambda root, url: _first_text(root, TITLES) or "Untitled",
    "meta_description": lambda root, url: _meta(root, 'meta[name="description"]') or "",
    "author": lambda root, url: _first_text(root, AUTHORS),
    "meta_published": lambda root, url: _meta(root, 'meta[property="article:published_time"]'),
    "meta_modified": lambda root, url: _meta(root, 'meta[property="article:modified_time"]'),
    "ld_json": lambda root, url: _structured_data(root),
    "dom_date": lambda root, url: _first_text(root, DATES),
    "categories": lambda root, url: _all_texts(root, CATEGORIES),
    "tags": lambda root, url: _all_texts(root, TAGS),
    "images": _images_of,
    "links": lambda root, url: _links_of(root),
    "all_links": lambda root, url: [_link(n) for n in root.select("a[href]")],
    "nav_links": lambda root, url: _navigation(root),
    "post_hrefs": lambda root, url: _post_hrefs(root),
    "builder_counts": lambda root, url: [{"selector": s, "count": len(root.select(s))} for s in BUILDER_ELEMENTS],
    "article_count": lambda root, url: len(root.select("article")),
    "has_post_elements": lambda root, url: any(root.first(s) is not None for s in POST_ELEMENTS),
    "has_navigation": lambda root, url: root.first("nav, .navigation, .menu") is not None,
    "candidate_links": lambda root, url: [link for n in root.select('a[href*="/blog/"], a[href*="/posts/"]')[:10] if (link := _link(n))["text"]],
    "page_title": lambda root, url: _flat(node) if (node := root.first("title")) is not None else "",
    "body_text": lambda root, url: _body_text(root),
}
#: Fields of the content element without scripts and styles.
WRITTEN = {"content_html": Node.html, "content_text": lambda node: node.text().strip(), "content_markdown": markdown, "naive_markdown": _headed}
#: Fields that ``extract_posts`` reads; others are made where they are asked for.
POST_FIELDS = ("title", "meta_description", "author", "meta_published", "meta_modified", "ld_json", "dom_date", "categories", "tags", "images", "links", "content_html", "content_text", "content_markdown")


def dom_record(url: str, html: str, wanted: tuple[str, ...] | None = None) -> dict:
    """Fields of one page's tree, all if none are named."""
    names = [c.split()[0] for c in _columns(DOM)][:-1] if wanted is None else wanted
    root = parse(html)
    data = {name: READ[name](root, url or "") for name in names if name in READ}
    if "historical_title" in names or "historical_content" in names:
        data["historical_title"], data["historical_content"] = _historical(root)
    if any(name in WRITTEN for name in names):
        content = _content(root)
        for node in list(content.walk()):
            if node.tag in ("script", "style"):
                node.remove()
        data |= {name: WRITTEN[name](content) for name in names if name in WRITTEN}
    return data | {"error": None}


def dom_fields(html: Column, url: Column, wanted: tuple[str, ...] | None = None) -> Column:
    """Struct of the wanted fields of a page's tree (all if none are named); ``error`` says why a page gave none."""

    ship(SparkSession.active())
    schema = [c for c in _columns(DOM) if wanted is None or c.split()[0] in (*wanted, "error")]
    names = [c.split()[0] for c in schema]

    @F.pandas_udf(", ".join(schema))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for pages, links in batches:
            rows = []
            for page, link in zip(pages, links, strict=True):
                try:
                    rows.append(dom_record(link, page, wanted))
                except (ValueError, RecursionError) as error:
                    rows.append(dict.fromkeys(names) | {"error": f"{type(error).__name__}: {error}"})
            yield pd.DataFrame(rows, columns=names)

    return run(html, url)


def _columns(ddl: str) -> list[str]:
    """Top-level parts of a schema string."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[at:k].strip())
            at = k + 1
    return [*out, ddl[at:].strip()]


def extract_posts(pages: DataFrame, config: Config = Config()) -> DataFrame:
    """Posts of raw pages (url, html): the flat post record; pages that fail carry ``error``."""
    base = pages.where(F.col("url").isNotNull()).select("url", "html", "scraped_at" if "scraped_at" in pages.columns else F.lit(None).cast("string").alias("scraped_at"))
    d = base.withColumn("d", dom_fields(F.coalesce("html", F.lit("")), F.col("url"), POST_FIELDS))
    published, modified = dates.effective_dates(
        urls.url_date(F.col("url")), F.col("d.meta_published"), F.col("d.meta_modified"), F.get_json_object("d.ld_json", "$.datePublished"), F.get_json_object("d.ld_json", "$.dateModified"), F.col("d.dom_date")
    )
    link = lambda x: F.struct(
        (u := urls.absolute_url(x["href"], config.site_url, F.col("url"))).alias("url"), x["text"].alias("text"), x["title"].alias("title"), urls.link_type(u, config.site_url).alias("type")
    )
    linked = F.transform(F.coalesce("d.links", F.array().cast(f"array<{RAW_LINK}>")), link)
    id_ = urls.post_id(F.col("url"))
    return d.select(
        "url",
        id_.alias("id"),
        urls.last_part(F.col("url")).alias("slug"),
        F.coalesce(F.nullif(F.trim("d.title"), F.lit("")), F.concat(F.lit("Post "), id_)).alias("title"),
        "d.meta_description",
        F.coalesce("d.author", F.lit(config.default_author)).alias("author"),
        "d.content_html",
        "d.content_text",
        "d.content_markdown",
        text.excerpt(F.col("d.content_text")).alias("excerpt"),
        text.word_count(F.col("d.content_text")).cast("string").alias("word_count"),
        published.alias("published_date"),
        modified.alias("modified_date"),
        "scraped_at",
        F.lit(None).cast("string").alias("extracted_at"),
        "d.categories",
        "d.tags",
        "d.images",
        keep_first(linked, "url").alias("links"),
        "d.error",
    )


def keep_first(items: Column, key: str) -> Column:
    """Array of structs without later ones of a key that was there before."""
    keys = F.transform(items, lambda x: x[key])
    return F.filter(items, lambda x, k: F.array_position(keys, x[key]) == k + 1)


def extract_historical(pages: DataFrame, author: str = "") -> DataFrame:
    """Posts of old pages: longer titles and contents win, the date is the first of the URL's month."""
    d = pages.where(F.col("url").isNotNull()).select("url", dom_fields(F.coalesce("html", F.lit("")), F.col("url"), ("historical_title", "historical_content")).alias("d"))
    year, month = urls.year_month(F.col("url"))
    content = F.coalesce("d.historical_content", F.lit(""))
    return d.select(
        "url",
        urls.historical_id(F.col("url")).alias("id"),
        urls.last_part(F.col("url")).alias("slug"),
        F.coalesce("d.historical_title", text.title_from_slug(urls.last_part(F.col("url")))).alias("title"),
        content.alias("content"),
        F.length(content).alias("content_length"),
        text.word_count(content).alias("word_count"),
        F.when(year != "", F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-01"))).alias("published_date"),
        F.nullif(year, F.lit("")).cast("int").alias("year"),
        F.nullif(month, F.lit("")).cast("int").alias("month"),
        F.lit(author).alias("author"),
        F.lit("html").alias("extraction_method"),
    )


def tree(pages: DataFrame, *wanted: str) -> DataFrame:
    """(columns of pages without html, d): the wanted fields of each page's tree."""
    rest = [c for c in pages.columns if c != "html"]
    return pages.select(*rest, dom_fields(F.coalesce("html", F.lit("")), F.col("url"), wanted).alias("d"))


def main_page_profile(pages: DataFrame, site_url: str) -> DataFrame:
    """(url, title, total_links, blog_links, has_blog_keywords, builder_elements): what a page says about the site's posts."""
    d = tree(pages, "page_title", "body_text", "all_links", "builder_counts")
    likely = F.filter("d.all_links", lambda x: urls.looks_like_post(urls.absolute_url(x["href"], site_url, F.col("url"))))
    count = F.aggregate("d.builder_counts", F.lit(0), lambda acc, x: acc + x["count"])
    return d.select("url", F.col("d.page_title").alias("title"), F.size("d.all_links").alias("total_links"), F.size(likely).alias("blog_links"), F.lower("d.body_text").rlike(PROFILE_WORDS).alias("has_blog_keywords"), count.alias("builder_elements"))


# ---- without Python -----------------------------------------------------------------------------------------------------------------


def heading(html: Column) -> Column:
    """First h1, else the title, else "Untitled"; tags and runs of space removed."""
    part = lambda tag: F.nullif(text.one_line(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]+>", "")), F.lit(""))
    return F.coalesce(part("h1"), part("title"), F.lit("Untitled"))


def article_html(html: Column) -> Column:
    """Inner HTML of the article without scripts and styles."""
    inner = F.regexp_extract(html, r"(?is)<article[^>]*>(.*)</article>", 1)
    return F.regexp_replace(F.regexp_replace(inner, r"(?is)<script[^>]*>.*?</script>", ""), r"(?is)<style[^>]*>.*?</style>", "")


def article_text(html: Column) -> Column:
    """Text of the article on one line; entities stay as they are."""
    return text.one_line(F.regexp_replace(article_html(html), r"<[^>]+>", " "))


def hrefs(html: Column) -> Column:
    """Targets of a page's links, in order."""
    return F.regexp_extract_all(html, F.lit(r'<a[^>]+href="([^"]*)"'), F.lit(1))


def page_links(pages: DataFrame, site_url: str) -> DataFrame:
    """(url, pos, href, target, type): a page's links made full and typed, the first of each target."""
    found = pages.select("url", F.posexplode(hrefs(F.col("html"))).alias("pos", "href")).where(~F.col("href").isin("", "#", "javascript:void(0)"))
    full = found.withColumn("target", urls.absolute_url(F.col("href"), site_url, F.col("url")))
    first = full.groupBy("url", "target").agg(F.min_by("href", "pos").alias("href"), F.min("pos").alias("pos"))
    return first.select("url", "pos", "href", "target", urls.link_type(F.col("target"), site_url).alias("type"))
