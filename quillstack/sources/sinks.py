"""Writers. Tables are written by Spark; documents of one row pass through the driver, files of one post each through the executors."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.archive import archived_posts, basic_metadata, extraction_summary, historical_summary, index_rows, posts_index, site_metadata
from ..shipping import ship
from . import files


def json_rows(frame: DataFrame) -> DataFrame:
    """(value): a row as JSON with its top-level keys sorted."""
    return frame.select(F.to_json(F.struct(*sorted(frame.columns)), {"ignoreNullFields": "false"}).alias("value"))


def pretty(text: str) -> str:
    """JSON with all keys sorted, two spaces a level, other scripts as they are."""
    return json.dumps(json.loads(text), indent=2, sort_keys=True, ensure_ascii=False)


def write_archive(posts: DataFrame, path: str, partition_by_year: bool = True) -> None:
    """Nested posts as JSON lines, by year, so that readers of a year read only it."""
    records = archived_posts(posts).drop("pos")
    if partition_by_year:
        records.withColumn("year", F.coalesce(F.nullif(F.substring("published_date", 1, 4), F.lit("")), F.lit("undated"))).write.mode("overwrite").partitionBy("year").json(path)
    else:
        records.write.mode("overwrite").json(path)


def write_main_document(posts: DataFrame, folder: str, stamp: str) -> None:
    """``archive.json``: site metadata, extraction summary and where the posts are; what was there before is kept under its own time."""
    before = files.read_text(folder, "archive.json")
    if before is not None:
        made = json.loads(before).get("generated_at", "before").replace(":", "")
        files.write_text(f"{folder}/backups", f"archive_{made}.json", before)
    one = lambda frame: json.loads(json_rows(frame).first().value)
    document = one(basic_metadata(posts, stamp)) | {"site": one(site_metadata(posts)), "extraction": one(extraction_summary(posts)), "posts": "archive", "files": "posts"}
    files.write_text(folder, "archive.json", pretty(json.dumps(document)))


def write_post_files(posts: DataFrame, folder: str) -> int:
    """``posts/{id}.json`` of every post, the last of an id; pretty and sorted."""
    records = archived_posts(posts)
    rows = records.select(F.concat("id", F.lit(".json")).alias("filename"), F.col("pos"), F.to_json(F.struct(*[c for c in records.columns if c != "pos"]), {"ignoreNullFields": "false"}).alias("body"))
    last = rows.groupBy("filename").agg(F.max_by("body", "pos").alias("body"))
    return write_named_files(last, f"{folder}/posts", indent=True)


def write_indexes(posts: DataFrame, path: str) -> None:
    """The post, timeline, category and tag indexes: a row an entry, by key and newest first, so no key is ever in one task."""
    posts_index(posts).write.mode("overwrite").json(f"{path}/posts_index")
    month = F.substring("published_date", 1, 7)
    index_rows(posts, month, "month").withColumn("year", F.substring("month", 1, 4)).write.mode("overwrite").json(f"{path}/timeline_index")
    index_rows(posts, F.explode(F.array_distinct("categories")), "category").write.mode("overwrite").json(f"{path}/categories_index")
    index_rows(posts, F.explode(F.array_distinct("tags")), "tag").write.mode("overwrite").json(f"{path}/tags_index")


def write_named_files(frame: DataFrame, folder: str, name: str = "filename", body: str = "body", indent: bool = False) -> int:
    """One file a row in a folder that all executors can write; of equal names one row wins. Returns the number of files."""
    ship(frame.sparkSession)
    unique = frame.groupBy(name).agg(F.max(body).alias(body))

    def write(rows) -> None:
        for row in rows:
            files.write_text(folder, row[name].replace("/", "_"), pretty(row[body]) if indent else row[body])

    unique.foreachPartition(write)
    return unique.count()


def append_log(spark: SparkSession, path: str, row: Row | dict, schema: str) -> None:
    """Append to a log table; readers keep the latest rows."""
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)


def one_document(frame: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file."""
    json_rows(frame).coalesce(1).write.mode("overwrite").text(path)


def write_historical(posts: DataFrame, failed: DataFrame, years: DataFrame, folder: str, stamp: str) -> dict:
    """Old posts: a table of JSON lines, failed URLs, URLs by year, a summary document, and a Markdown file a post. Returns the summary."""
    posts.write.mode("overwrite").json(f"{folder}/historical_posts")
    failed.select("url").write.mode("overwrite").json(f"{folder}/failed_urls")
    years.write.mode("overwrite").json(f"{folder}/year_breakdown")
    summary = json.loads(json_rows(historical_summary(posts, failed)).first().value) | {"extraction_date": stamp, "extraction_method": "html"}
    files.write_text(folder, "summary.json", pretty(json.dumps(summary)))
    write_named_files(historical_files(posts), f"{folder}/markdown")
    return summary


def historical_files(posts: DataFrame) -> DataFrame:
    """(filename, body) of old posts: title, a list of facts, text."""
    from ..functions.text import historical_filename

    fact = lambda label, c, missing: F.concat(F.lit(f"- {label}: "), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(missing)))
    facts = F.concat_ws("\n", fact("URL", "url", ""), fact("Published", "published_date", "unknown"), fact("Author", "author", "unknown"), fact("Words", "word_count", "unknown"))
    body = F.concat(F.lit("# "), "title", F.lit("\n\n"), facts, F.lit("\n\n"), F.coalesce(F.nullif("content", F.lit("")), F.lit("*No content available*")), F.lit("\n"))
    return posts.select(F.concat(historical_filename(F.col("published_date"), F.col("title")), F.lit(".md")).alias("filename"), body.alias("body"))
