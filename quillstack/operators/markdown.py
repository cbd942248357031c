"""Markdown output: front matter, body, file names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.dom import cleaned, markdown
from ..shipping import ship

#: Keys of the front matter, in order.
FRONT_KEYS = ("title", "date", "author", "layout", "excerpt", "description", "categories", "tags", "original_url", "slug", "word_count", "image_count", "featured_image", "archived_date")


def front_matter(archived_date: str) -> Column:
    """YAML front matter of a flat post; empty fields are left out, but for the first four."""

    ship(SparkSession.active())

    @F.pandas_udf("string")
    def dump(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        import yaml

        for rows in batches:
            out = []
            for row in rows.to_dict("records"):
                data = {k: (v.tolist() if hasattr(v, "tolist") else v) for k in FRONT_KEYS if (v := row[k]) is not None}
                data = {k: v for k, v in data.items() if k in FRONT_KEYS[:4] or (v and v == v)}
                data |= {k: int(data[k]) for k in ("word_count", "image_count") if k in data}
                out.append(yaml.dump(data, default_flow_style=False, allow_unicode=True, sort_keys=False))
            yield pd.Series(out)

    some = lambda c: F.nullif(F.col(c), F.lit(""))
    full = lambda c: F.when(F.size(c) > 0, F.col(c))
    return dump(
        F.struct(
            F.coalesce("title", F.lit("")).alias("title"), F.coalesce("published_date", F.lit("")).alias("date"), F.coalesce("author", F.lit("")).alias("author"), F.lit("post").alias("layout"),
            some("excerpt").alias("excerpt"), some("meta_description").alias("description"), full("categories").alias("categories"), full("tags").alias("tags"), some("url").alias("original_url"),
            some("slug").alias("slug"), F.coalesce("word_count", F.lit(0)).alias("word_count"), F.coalesce(F.size("images"), F.lit(0)).alias("image_count"),
            F.nullif(F.try_element_at("images.original_url", F.lit(1)), F.lit("")).alias("featured_image"), F.lit(archived_date).alias("archived_date"),
        )
    )


def html_to_markdown(html: Column, site_url: str) -> Column:
    """Markdown of cleaned HTML; one parse a document, in Arrow batches."""

    ship(SparkSession.active())

    @F.pandas_udf("string")
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([None if p is None else markdown(cleaned(p, site_url)) for p in pages])

    return convert(html)


def markdown_body(site_url: str) -> Column:
    """Body of a flat post: its HTML, else its Markdown, else its text, and the sections of images and links."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    body = F.coalesce(some("content_markdown"), some("content_text"), F.lit("*No content available*"))
    body = F.when(some("content_html").isNotNull(), text.clean_markdown(html_to_markdown(F.col("content_html"), site_url))).otherwise(body)
    return F.concat(body, text.images_section(F.col("images")), text.links_section(F.col("links")))


def markdown_files(posts: DataFrame, site_url: str, archived_date: str) -> DataFrame:
    """(filename, body) of every post."""
    name = text.markdown_filename(F.col("published_date"), F.col("slug"), F.col("id"), F.col("title"))
    whole = F.concat(F.lit("---\n"), front_matter(archived_date), F.lit("---\n\n"), markdown_body(site_url), F.lit("\n"))
    return posts.select(F.concat(name, F.lit(".md")).alias("filename"), whole.alias("body"))


def readme_stats(posts: DataFrame) -> DataFrame:
    """One row: posts, words, first and last date."""
    return posts.agg(F.count("*").alias("posts"), F.coalesce(F.sum("word_count"), F.lit(0)).cast("long").alias("words"), F.min("published_date").alias("first_date"), F.max("published_date").alias("last_date"))


def readme(stats: dict, title: str) -> str:
    """README of a Markdown archive from its statistics."""
    dated = f"\nPosts from {stats['first_date'][:10]} to {stats['last_date'][:10]}.\n" if stats.get("first_date") else ""
    return f"# {title}\n\n{stats['posts']:,} posts, {stats['words']:,} words.\n{dated}\nEach file has YAML front matter and the post's text.\n"


def site_config(title: str, url: str) -> str:
    """Static-site configuration that serves the files."""
    return f"title: {title}\nurl: {url}\nmarkdown: kramdown\npermalink: /:categories/:year/:month/:day/:title/\ndefaults:\n  - scope: {{path: ''}}\n    values: {{layout: post}}\n"
