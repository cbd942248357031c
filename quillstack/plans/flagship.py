"""The flagship query: pages to statistics of hosts, without a Python function in the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import extract
from .stand_ins import SITE, pages


def page_report(spark: SparkSession, sf: str) -> DataFrame:
    """(host, pages, words, mean_words, longest_slug) over canonical pages."""
    rows = pages(spark, sf).select(urls.secured(urls.canonical_url(F.col("url")), SITE).alias("url"), extract.heading(F.col("html")).alias("title"), extract.article_text(F.col("html")).alias("article"))
    counted = rows.select(F.try_parse_url("url", F.lit("HOST")).alias("host"), text.word_count(F.col("article")).alias("words"), text.slugify(F.col("title")).alias("slug"))
    return counted.groupBy("host").agg(F.count("*").alias("pages"), F.sum("words").alias("words"), F.floor(F.avg("words")).alias("mean_words"), F.max(F.length("slug")).alias("longest_slug"))
