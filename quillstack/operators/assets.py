"""Images: references, download ledger, payload checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import percent
from ..functions.text import human_size


def image_urls(posts: DataFrame) -> DataFrame:
    """Distinct http image URLs, ascending."""
    return posts.select(F.explode("images.original_url").alias("url")).where(F.col("url").startswith("http")).distinct().orderBy("url")


def is_image(content: Column) -> Column:
    """At least 100 bytes that begin like a JPEG, PNG, GIF, WebP or SVG."""
    starts = lambda hex_: F.substring(F.hex(F.substring(content, 1, len(hex_) // 2)), 1, len(hex_)) == hex_
    head = F.hex(F.substring(content, 1, 100))
    webp = starts("52494646") & F.hex(F.substring(content, 1, 20)).contains("57454250")
    return F.coalesce((F.octet_length(content) >= 100) & (starts("FFD8FF") | starts("89504E47") | starts("47494638") | webp | head.contains("3C737667")), F.lit(False))


def fitted_size(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Size of an image shrunk to a width, its shape kept."""
    return F.least(width, F.lit(most)), F.when(width > most, F.floor(height * most / width)).otherwise(height).cast("int")


def download_status(refs: DataFrame, ledger: DataFrame) -> DataFrame:
    """References (url, ...) with local_path and status of the ledger; "skipped" where it has none. Catalyst broadcasts a small ledger."""
    known = ledger.select(F.col("original_url").alias("__u"), "local_path", "status")
    joined = refs.join(known, F.col("url") == F.col("__u"), "left").drop("__u")
    return joined.withColumns({"local_path": F.coalesce("local_path", F.lit("")), "status": F.coalesce("status", F.lit("skipped"))})


def with_local_paths(posts: DataFrame, ledger: DataFrame) -> DataFrame:
    """(id, images): each image with its local path and status, in order."""
    refs = posts.select("id", F.posexplode("images").alias("at", "i")).withColumn("url", F.col("i.original_url"))
    done = download_status(refs, ledger)
    item = F.struct("at", F.col("url").alias("original_url"), F.col("i.alt_text").alias("alt_text"), "local_path", "status")
    return done.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("images"))


def download_report(ledger: DataFrame) -> DataFrame:
    """One row: images, successes, failures, success rate, bytes."""
    counted = ledger.agg(
        F.count("*").alias("total_images"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum(F.when(F.col("status") == "success", F.col("bytes"))), F.lit(0)).alias("total_bytes"),
    )
    return counted.withColumns({"success_rate": percent(F.col("successful"), F.col("total_images")), "total_size": human_size(F.col("total_bytes"))})
