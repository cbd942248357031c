"""The archive: nested records, site statistics, indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import floor_mean, percent


def newest_first(posts: DataFrame) -> DataFrame:
    """Published date descending, ties in input order, undated posts last."""
    return posts.orderBy(F.col("published_date").desc_nulls_last(), F.col("pos"))


def archived_images(images: Column) -> Column:
    return F.transform(
        images,
        lambda i: F.struct(
            i["original_url"].alias("original_url"), F.lit("").alias("local_path"), i["alt_text"].alias("alt_text"), i["caption"].alias("caption"), i["title"].alias("title"),
            F.struct(i["width"].alias("width"), i["height"].alias("height")).alias("dimensions"),
        ),
    )


def link_buckets(links: Column) -> Column:
    """Links by type, order kept; unknown types are external."""
    bare = lambda x: F.struct(x["url"].alias("url"), x["text"].alias("text"), x["title"].alias("title"))
    of = lambda test: F.transform(F.filter(links, test), bare)
    named = ("internal", "email", "phone")
    return F.struct(
        of(lambda x: x["type"] == "internal").alias("internal"),
        of(lambda x: ~F.coalesce(x["type"], F.lit("")).isin(*named)).alias("external"),
        of(lambda x: x["type"] == "email").alias("email"),
        of(lambda x: x["type"] == "phone").alias("phone"),
    )


def archived_posts(posts: DataFrame) -> DataFrame:
    """Validated posts to nested records; missing strings are empty. ``pos`` stays for ordering."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return posts.select(
        "pos", text("id"), text("title"), text("slug"), text("url"), text("published_date"), text("modified_date"), text("author"), text("excerpt"),
        F.struct(F.coalesce("content_html", F.lit("")).alias("html"), F.coalesce("content_text", F.lit("")).alias("text"), F.coalesce("content_markdown", F.lit("")).alias("markdown"), F.coalesce("word_count", F.lit(0)).alias("word_count")).alias("content"),
        F.struct("categories", "tags", F.coalesce("meta_description", F.lit("")).alias("meta_description")).alias("metadata"),
        F.struct(archived_images(F.col("images")).alias("images"), link_buckets(F.col("links")).alias("links")).alias("assets"),
        F.struct(F.coalesce("scraped_at", F.lit("")).alias("scraped_at"), F.coalesce("extracted_at", F.lit("")).alias("extracted_at"), F.col("validation").alias("validation_info")).alias("archive_info"),
    )


def site_metadata(posts: DataFrame) -> DataFrame:
    """One row of statistics; distinct names as sorted arrays. Distinct sets are made per value, not by collecting every post's array."""
    totals = posts.agg(
        F.count("*").alias("total_posts"),
        F.min("published_date").alias("earliest"),
        F.max("published_date").alias("latest"),
        F.coalesce(F.sum("word_count"), F.lit(0)).cast("long").alias("total_words"),
        F.coalesce(F.sum(F.size("images")), F.lit(0)).cast("long").alias("total_images"),
        F.coalesce(F.sum(F.size("links")), F.lit(0)).cast("long").alias("total_links"),
    ).withColumn("average_words", floor_mean(F.col("total_words"), F.col("total_posts")))
    for name, values in (("authors", F.array("author")), ("categories", F.col("categories")), ("tags", F.col("tags"))):
        distinct = posts.select(F.explode(values).alias("v")).where("v <> ''").distinct()
        totals = totals.join(distinct.agg(F.array_sort(F.collect_list("v")).alias(name)))
    return totals


def extraction_summary(posts: DataFrame) -> DataFrame:
    """One row: issues and how many posts have images, links, categories, tags."""
    having = [F.count_if(F.size(c) > 0).alias(f"posts_with_{c}") for c in ("images", "links", "categories", "tags")]
    return posts.agg(F.count("*").alias("total_posts"), F.coalesce(F.sum("validation.issues_found"), F.lit(0)).alias("issues_found"), *having)


def posts_index(posts: DataFrame) -> DataFrame:
    return newest_first(posts).select("id", "title", F.coalesce("published_date", F.lit("")).alias("date"), "author", "word_count", "url", F.concat(F.lit("posts/"), F.col("id"), F.lit(".json")).alias("file"))


def timeline(posts: DataFrame) -> DataFrame:
    """(year, month, posts): entries of a month newest first; undated posts have none."""
    dated = posts.where(F.coalesce("published_date", F.lit("")) != "")
    entry = F.struct(F.col("published_date").alias("date"), F.col("pos").alias("pos"), F.col("id").alias("id"), F.col("title").alias("title"))
    months = dated.groupBy(F.substring("published_date", 1, 4).alias("year"), F.substring("published_date", 1, 7).alias("month")).agg(F.collect_list(entry).alias("p"))
    newest = F.array_sort("p", lambda a, b: F.when(a["date"] > b["date"], -1).when(a["date"] < b["date"], 1).when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0))
    return months.select("year", "month", F.transform(newest, lambda e: F.struct(e["id"].alias("id"), e["title"].alias("title"), e["date"].alias("date"))).alias("posts"))


def timeline_counts(dates: DataFrame, date: str) -> DataFrame:
    """(year, month, n) with a total row per year and one over all, whose missing keys are null."""
    return dates.where(F.col(date).isNotNull()).rollup(F.date_format(date, "yyyy").alias("year"), F.date_format(date, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def inverted_index(posts: DataFrame, values: str, key: str) -> DataFrame:
    """(key, posts): for each category or tag its posts, newest first."""
    entry = F.struct(F.coalesce("published_date", F.lit("")).alias("date"), F.col("pos").alias("pos"), F.col("id").alias("id"), F.col("title").alias("title"))
    listed = posts.select(F.explode(F.array_distinct(values)).alias(key), entry.alias("e")).groupBy(key).agg(F.collect_list("e").alias("p"))
    newest = F.array_sort("p", lambda a, b: F.when(a["date"] > b["date"], -1).when(a["date"] < b["date"], 1).when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0))
    return listed.select(key, F.transform(newest, lambda e: F.struct(e["id"].alias("id"), e["title"].alias("title"), e["date"].alias("date"))).alias("posts"))


def _by_key(key: str, value: str) -> Column:
    """Map of a group's rows, keys ascending; values need not have an order."""
    ascending = lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0)
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)), ascending))


def nested_index(index: DataFrame, key: str, value: str = "posts") -> DataFrame:
    """An index as one row with one map, for a single index document."""
    return index.agg(_by_key(key, value).alias("index"))


def nested_timeline(months: DataFrame) -> DataFrame:
    """year -> month -> posts as one row."""
    years = months.groupBy("year").agg(_by_key("month", "posts").alias("months"))
    return nested_index(years, "year", "months")


def completeness(archive: DataFrame) -> DataFrame:
    """One row: how many archived posts have an id, a title, a date, content; and the share of complete ones."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    whole = has(F.col("id")) & has(F.col("title"))
    found = archive.agg(
        F.count("*").alias("posts"), F.count_if(whole).alias("valid_posts"), F.count_if(has(F.col("published_date"))).alias("posts_with_dates"), F.count_if(has(F.col("content.text")) | has(F.col("content.html"))).alias("posts_with_content")
    )
    return found.withColumn("completeness", percent(F.col("valid_posts"), F.col("posts")))


def _one_by_key(rows: DataFrame, key: str, pick) -> DataFrame:
    """One row of each key; grouped by the key's digest with partial results, so that a long or frequent key moves little."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(F.sha2(F.col(key).cast("string"), 256).alias("__k")).agg(pick(row).alias("__row")).select("__row.*")


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return _one_by_key(rows, key, lambda row: F.max_by(row, order))


def first_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return _one_by_key(rows, key, lambda row: F.min_by(row, order))


def index_rows(posts: DataFrame, key: Column, name: str) -> DataFrame:
    """(key, date, pos, id, title): an index as rows, by key and newest first within it. Sorted by ranges of key and date, so that a key that a third of all
    posts have is spread over tasks."""
    flat = posts.select(key.alias(name), F.coalesce("published_date", F.lit("")).alias("date"), "pos", "id", "title").where(F.coalesce(F.col(name), F.lit("")) != "")
    order = (F.col(name), F.col("date").desc(), F.col("pos"))
    return flat.repartitionByRange(*order).sortWithinPartitions(*order)


def basic_metadata(posts: DataFrame, generated: str) -> DataFrame:
    """One row: how many posts, and when this was said."""
    return posts.agg(F.count("*").alias("total_posts")).withColumn("generated_at", F.lit(generated))


def historical_summary(posts: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: URLs tried, extracted, failed, share in percent, mean words of the posts that have some."""
    lost = failed.agg(F.count("*").alias("failed"))
    found = posts.agg(F.count("*").alias("extracted"), F.avg(F.nullif("word_count", F.lit(0))).alias("average_words"))
    both = found.join(lost).withColumn("total", F.col("extracted") + F.col("failed"))  # two totals of one row each
    return both.select("total", "extracted", "failed", percent(F.col("extracted"), F.col("total")).alias("success_rate"), "average_words")
