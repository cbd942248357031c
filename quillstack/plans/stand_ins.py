"""The driver's tables read as the engine's own: documents as posts, events as session events, pages as raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import UrlProfile
from ..functions import text, urls
from ..sources.readers import table

SITE = "https://blog.example.com/"
#: The tables' page URLs look like https://host/en/53.
PROFILE = UrlProfile(required=("/en/", "/fr/", "/de/", "/es/"), min_parts=2, min_slug=1)


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url", "html")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders")


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as flat posts: the language is the tag, the source the author and the category."""
    d = documents(spark, sf)
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return d.select(
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("https://blog.example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("doc_id").cast("string").alias("id"),
        first.alias("title"),
        F.col("text").alias("content_text"),
        text.excerpt(F.col("text")).alias("excerpt"),
        text.word_count(F.col("text")).alias("word_count"),
        F.col("source").alias("author"),
        F.array("source").alias("categories"),
        F.array("lang").alias("tags"),
        "n_chars",
    )


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the documents: the new one lacks some, has others, and some texts are changed."""
    d = documents(spark, sf).select(F.col("doc_id").alias("url"), F.col("doc_id").alias("pos"), "text", "lang", "source")
    k = F.pmod("url", F.lit(10))
    old = d.where(k != 0)
    new = d.where(k != 1).withColumn("text", F.when(k == 2, F.concat("text", F.lit(" (edited)"))).otherwise(F.col("text")))
    hashed = lambda f: f.withColumn("content_hash", text.content_hash(F.substring("text", 1, 80), F.col("text"), F.lit(""), F.array("source"), F.array("lang")))
    return hashed(old), hashed(new)


__all__ = ["PROFILE", "SITE", "documents", "events", "orders", "pages", "posts", "snapshots", "urls"]
