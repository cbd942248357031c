"""Readers: tables, sitemaps, feeds, robots files, archives, session state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import UrlProfile
from ..functions import urls
from ..schemas import ARCHIVED_POSTS, PHASES, SESSION_EVENTS, UPDATE_LOG, UPDATED_URLS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(source, content): a row for each text file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("content"))


def sitemap_locations(xml: Column) -> Column:
    """Page locations of a sitemap, entities decoded; child sitemaps are not among them."""
    pages = F.regexp_replace(xml, r"(?is)<sitemap>.*?</sitemap>", "")
    return _decoded(F.regexp_extract_all(pages, F.lit(r"(?is)<(?:\w+:)?loc>\s*(.*?)\s*</(?:\w+:)?loc>"), F.lit(1)))


def child_sitemaps(xml: Column) -> Column:
    """Locations that a sitemap index lists."""
    return _decoded(F.regexp_extract_all(xml, F.lit(r"(?is)<(?:\w+:)?sitemap>.*?<(?:\w+:)?loc>\s*(.*?)\s*</(?:\w+:)?loc>.*?</(?:\w+:)?sitemap>"), F.lit(1)))


def _entities(x: Column) -> Column:
    """The five entities of XML, the ampersand's last, without a CDATA mark around."""
    bare = F.regexp_replace(x, r"^<!\[CDATA\[|\]\]>$", "")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(mark))
    return bare


def _decoded(found: Column) -> Column:
    return F.transform(found, _entities)


def feed_links(content: Column) -> Column:
    """Links of an RSS or Atom feed: link texts, ids, link targets; each once."""
    # a feed cut at its opening marks: each piece is a tag's name, attributes, and the text that follows
    pieces = F.transform(F.split(content, "<"), lambda p: F.struct(F.lower(F.regexp_extract(p, r"^(\w+)", 1)).alias("tag"), F.split_part(p, F.lit(">"), F.lit(1)).alias("head"), F.trim(F.regexp_replace(p, "^[^>]*>?", "")).alias("text")))
    of = lambda tag: F.filter(pieces, lambda p: p["tag"] == tag)
    written = lambda tag: F.transform(F.filter(of(tag), lambda p: p["text"] != ""), lambda p: p["text"])
    pointed = F.transform(of("link"), lambda p: F.trim(F.regexp_extract(p["head"], r"(?i)\bhref\s*=\s*(\"|')(.*?)\1", 2)))
    return F.array_distinct(F.transform(F.concat(written("link"), written("id"), F.filter(pointed, lambda u: u != "")), _entities))


def robots_sitemaps(content: Column) -> Column:
    """Sitemaps that a robots file names."""
    lines = F.filter(F.split(content, r"\r?\n"), lambda x: F.lower(F.trim(x)).startswith("sitemap:"))
    return F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^[^:]*:", "")))


def post_urls(documents: DataFrame, content: str, found, profile: UrlProfile | None = UrlProfile()) -> DataFrame:
    """(source, url): post URLs that a parser of this module finds in documents; without a profile those that look like posts."""
    test = urls.looks_like_post(F.col("url")) if profile is None else urls.is_post_url(F.col("url"), profile)
    return documents.select("source", F.explode(found(F.col(content))).alias("url")).where(test).distinct()


def sitemap_tree(index: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """(source, xml) of the sitemaps that are there already and those that an index names, one level deep."""
    named = index.select(F.explode(child_sitemaps(F.col("xml"))).alias("source")).distinct()
    return index.unionByName(sitemaps.join(named, "source", "left_semi")).distinct()


def archive(spark: SparkSession, path: str) -> DataFrame:
    """Archived posts of an archive directory written by ``sinks.write_archive``; rows that do not parse go to _corrupt_record."""
    return spark.read.schema(ARCHIVED_POSTS + ", _corrupt_record string").json(path)


def archive_document(spark: SparkSession, path: str) -> DataFrame:
    """Posts of one archive document with a "posts" list."""
    return spark.read.schema(f"posts array<struct<{ARCHIVED_POSTS.replace(' string', ':string').replace(' struct', ':struct').replace(' array', ':array')}>>").json(path, multiLine=True).select(F.explode("posts").alias("p")).select("p.*")


def session_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of earlier runs; none if there is no table."""
    return _or_empty(spark, path, SESSION_EVENTS)


def update_log(spark: SparkSession, path: str) -> DataFrame:
    return _or_empty(spark, path, UPDATE_LOG)


def updated_urls(spark: SparkSession, path: str) -> DataFrame:
    """Every URL of every update."""
    return _or_empty(spark, path, UPDATED_URLS)


def phases(spark: SparkSession, path: str) -> DataFrame:
    """Phases that runs have finished."""
    return _or_empty(spark, path, PHASES)


def _or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    exists = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def listed_urls(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a saved state's "all_urls" list."""
    return spark.read.schema("all_urls array<string>").json(path, multiLine=True).select(F.explode("all_urls").alias("url"))
