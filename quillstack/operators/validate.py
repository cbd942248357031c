"""Validation and cleaning of posts: a chain of expressions, each adding its issues in a fixed order.

A post without a URL is rejected and counted as an error; any other is repaired, and one with issues counts once as a warning. Reports are
made per batch, so rates stay between 0 and 100.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import dates, text, urls
from ..functions.ratios import percent
from ..schemas import IMAGE, LINK
from .extract import keep_first


def _issues(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _blank(c: Column) -> Column:
    return F.coalesce(text.stripped(c), F.lit("")) == ""


def required_fields(pos: Column, url: Column, title: Column, id_: Column) -> tuple[Column, Column, Column]:
    """(issues, title, id): missing title and id are replaced by the post's place in its batch."""
    missing = lambda c, name: F.when(F.coalesce(c, F.lit("")) == "", F.lit(f"Missing required field: {name}"))
    place = pos.cast("string")
    return (
        _issues(missing(url, "url"), missing(title, "title"), missing(id_, "id")),
        F.when(F.coalesce(title, F.lit("")) == "", F.concat(F.lit("Post "), place)).otherwise(title),
        F.when(F.coalesce(id_, F.lit("")) == "", F.concat(F.lit("post-"), place)).otherwise(id_),
    )


def clean_url(url: Column, site_url: str) -> tuple[Column, Column]:
    trimmed = text.stripped(url)
    valid = trimmed.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+")
    issue = F.when(trimmed == "", F.lit("URL is empty")).when(~valid, F.concat(F.lit("Invalid URL format: "), trimmed))
    return urls.secured(trimmed, site_url), _issues(issue)


def clean_content(value: Column) -> tuple[Column, Column]:
    """(text, 1 if it changed else 0)."""
    cleaned = text.blank_lines_collapsed(value)
    return cleaned, F.coalesce((cleaned != value).cast("int"), F.lit(0))


def clean_word_count(raw: Column, content: Column) -> tuple[Column, Column]:
    """Numbers stay, 0 and missing are counted anew, anything else is 0 with an issue."""
    given = F.nullif(F.trim(raw.cast("string")), F.lit(""))
    number = given.try_cast("int")
    counted = text.word_count(content)
    value = F.when(given.isNull() | (number == 0), counted).otherwise(F.coalesce(number, F.lit(0)))
    return value, _issues(F.when(given.isNotNull() & number.isNull(), F.lit("Invalid word count format")))


def clean_images(images: Column) -> tuple[Column, Column]:
    """Trimmed fields, sizes as numbers where they are some; images without a URL go with an issue."""
    some = F.coalesce(images, F.array().cast("array<struct<original_url:string,alt_text:string,title:string,caption:string,width:string,height:string>>"))
    plain = lambda c: text.stripped(F.coalesce(c, F.lit("")))
    issues = F.filter(F.transform(some, lambda i, k: F.when(plain(i["original_url"]) == "", F.concat(F.lit("Image "), k.cast("string"), F.lit(" missing URL")))), lambda x: x.isNotNull())
    kept = F.transform(
        F.filter(some, lambda i: plain(i["original_url"]) != ""),
        lambda i: F.struct(
            plain(i["original_url"]).alias("original_url"), plain(i["alt_text"]).alias("alt_text"), plain(i["title"]).alias("title"), plain(i["caption"]).alias("caption"),
            F.trim(i["width"].cast("string")).try_cast("int").alias("width"), F.trim(i["height"].cast("string")).try_cast("int").alias("height"),
        ),
    )
    return kept.cast(f"array<{IMAGE}>"), issues


def clean_links(links: Column, site_url: str) -> tuple[Column, Column]:
    """Trimmed fields, the first of each URL, types read anew where they are none of the four."""
    some = F.coalesce(links, F.array().cast(f"array<{LINK}>"))
    plain = lambda c: text.stripped(F.coalesce(c, F.lit("")))
    issues = F.filter(F.transform(some, lambda x, k: F.when(plain(x["url"]) == "", F.concat(F.lit("Link "), k.cast("string"), F.lit(" missing URL")))), lambda x: x.isNotNull())
    typed = lambda x: F.when(x["type"].isin("internal", "external", "email", "phone"), x["type"]).otherwise(urls.link_type(plain(x["url"]), site_url))
    kept = F.transform(
        F.filter(some, lambda x: plain(x["url"]) != ""),
        lambda x: F.struct(plain(x["url"]).alias("url"), plain(x["text"]).alias("text"), plain(x["title"]).alias("title"), typed(x).alias("type")),
    )
    return keep_first(kept, "url").cast(f"array<{LINK}>"), issues


def clean_taxonomy(values: Column) -> Column:
    """Trimmed, without blanks and repeats, in order; missing is empty."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), text.stripped), lambda x: x != ""))


def validate_posts(posts: DataFrame, config: Config = Config()) -> DataFrame:
    """Flat posts with a position ``pos`` to validated posts: repaired fields, ``validation`` and ``fixes``. Rows without a URL are dropped."""
    p = posts.where(~_blank(F.col("url")))
    site = config.site_url
    missing, title0, id0 = required_fields(F.col("pos"), F.col("url"), F.col("title"), F.col("id"))
    p = p.withColumns({"__missing": missing, "__title": title0, "__id": id0})
    url, url_issues = clean_url(F.col("url"), site)
    title, title_issues = text.clean_title(F.col("__title"))
    p = p.withColumns({"__url": url, "__url_issues": url_issues, "__clean_title": title, "__title_issues": title_issues})
    published, published_issue = dates.checked_date(F.col("published_date"), "published_date")
    modified, modified_issue = dates.checked_date(F.col("modified_date"), "modified_date")
    effective = F.coalesce(published, dates.iso(urls.url_date(F.col("__url"))))
    html, fix1 = clean_content(F.col("content_html"))
    plain, fix2 = clean_content(F.col("content_text"))
    marked, fix3 = clean_content(F.col("content_markdown"))
    count, count_issues = clean_word_count(F.col("word_count"), plain)
    images, image_issues = clean_images(F.col("images"))
    links, link_issues = clean_links(F.col("links"), site)
    empty = _blank(html) & _blank(plain) & _blank(marked)
    issues = F.concat(
        F.col("__missing"), F.col("__url_issues"), F.col("__title_issues"),
        _issues(published_issue, modified_issue, F.when(effective.isNull(), F.lit("No published date found"))),
        _issues(F.when(empty, F.lit("Post has no content"))), count_issues, image_issues, link_issues,
    )
    return p.select(
        "pos",
        F.col("__url").alias("url"),
        F.col("__id").alias("id"),
        F.coalesce(F.nullif(text.stripped(F.col("slug")), F.lit("")), F.nullif(urls.slug_of(F.col("__url")), F.lit("")), text.slug(F.coalesce("__clean_title", F.lit("")))).alias("slug"),
        F.coalesce("__clean_title", F.concat(F.lit("Untitled Post "), F.col("pos").cast("string"))).alias("title"),
        F.coalesce(text.stripped(F.col("meta_description")), F.lit("")).alias("meta_description"),
        F.coalesce(F.nullif(text.stripped(F.col("author")), F.lit("")), F.lit(config.default_author)).alias("author"),
        html.alias("content_html"),
        plain.alias("content_text"),
        marked.alias("content_markdown"),
        F.coalesce("excerpt", F.lit("")).alias("excerpt"),
        count.alias("word_count"),
        effective.alias("published_date"),
        modified.alias("modified_date"),
        "scraped_at",
        "extracted_at",
        clean_taxonomy(F.col("categories")).alias("categories"),
        clean_taxonomy(F.col("tags")).alias("tags"),
        images.alias("images"),
        links.alias("links"),
        F.struct(F.size(issues).alias("issues_found"), issues.alias("issues")).alias("validation"),
        (fix1 + fix2 + fix3).alias("fixes"),
    )


def validation_report(posts: DataFrame, validated: DataFrame) -> DataFrame:
    """One row: posts, valid posts, warnings, errors, issues, fixes, success rate. Validation keeps every post with a URL, so what it dropped are the errors."""
    everything = posts.agg(F.count("*").alias("total_posts"))
    found = validated.agg(
        F.count("*").alias("valid_posts"),
        F.count_if(F.col("validation.issues_found") > 0).alias("warnings"),
        F.coalesce(F.sum("validation.issues_found"), F.lit(0)).alias("issues_found"),
        F.coalesce(F.sum("fixes"), F.lit(0)).alias("fixes_applied"),
    )
    both = everything.join(found).withColumn("errors", F.col("total_posts") - F.col("valid_posts"))
    return both.withColumn("success_rate", percent(F.col("valid_posts"), F.col("total_posts")))


def validation_summary(report: DataFrame) -> DataFrame:
    """(summary): a report as lines for a reader."""
    named = (("Posts", "total_posts"), ("Valid", "valid_posts"), ("With issues", "warnings"), ("Rejected", "errors"), ("Issues", "issues_found"), ("Fixes", "fixes_applied"))
    lines = [F.concat(F.lit(f"{label}: "), F.col(name).cast("string")) for label, name in named]
    return report.select(F.concat_ws("\n", *lines, F.concat(F.lit("Success rate: "), F.format_string("%.1f%%", F.col("success_rate")))).alias("summary"))


def issue_counts(validated: DataFrame) -> DataFrame:
    """(issue, posts): how many posts show each issue."""
    return validated.select(F.explode("validation.issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("posts"))
