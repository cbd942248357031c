"""Command line over tables of pages: archive, status, retry-failed, incremental, historical, create-config."""

from __future__ import annotations

import argparse
import datetime
import logging
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Config, load_config, save_config
from .functions import urls
from .operators import archive, discovery, extract, incremental, markdown, state, validate
from .schemas import PHASES, SESSION_EVENTS, UPDATE_LOG
from .sources import files, readers, sinks

LOG = logging.getLogger("quillstack")


def now() -> datetime.datetime:
    return datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)


def numbered(rows: DataFrame, order: list[str], stage: str) -> DataFrame:
    """Rows with ``pos`` from 0 in an order that is total; numbered per range and shifted, so that no single task sorts them all.

    The ranges are written first: ranges are sampled, and a second look at them could cut elsewhere.
    """
    spark = rows.sparkSession
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).write.mode("overwrite").parquet(stage)
    parts = spark.read.parquet(stage)
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__size"))
    before = sizes.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row a range
    number = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn("__n", number).join(before, F.col("__part") == F.col("__p")).withColumn("pos", (F.col("__n") + F.col("__before")).cast("int")).drop("__part", "__p", "__before", "__n")


def positioned(posts: DataFrame, stage: str) -> DataFrame:
    """Posts with ``pos`` in URL order."""
    return numbered(posts, ["url"], stage)


class Session:
    """Folders of one archive: session events, phases, posts by version, outputs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.id = state.session_id(now(), uuid.uuid4().hex)

    def events(self) -> DataFrame:
        return readers.session_events(self.spark, f"{self.folder}/events")

    def latest(self) -> DataFrame:
        return state.latest_status(self.events(), ["url"], "status", "ts")

    def stage(self, name: str) -> str:
        return f"{self.folder}/staging/{self.id}-{name}"

    def record(self, rows: DataFrame) -> None:
        """Append events of (url, status, error) rows, and of what else an event has if the rows have it."""
        known = {"session_id": F.lit(self.id), "ts": F.lit(now()), "seconds": F.lit(None).cast("double"), "html_len": F.lit(None).cast("long"), "n_images": F.lit(None).cast("long")}
        rows.withColumns({k: v for k, v in known.items() if k not in rows.columns}).select(*[F.col(name).cast(kind).alias(name) for name, kind in (c.split() for c in SESSION_EVENTS.split(", "))]).write.mode("append").parquet(f"{self.folder}/events")

    def phase(self) -> str | None:
        """The last phase that the latest run finished; none after a whole run."""
        last = readers.phases(self.spark, f"{self.folder}/phases").orderBy(F.col("ts").desc()).first()
        return None if last is None or last.phase == state.PHASES[-1] else last.phase

    def finish(self, phase: str) -> None:
        sinks.append_log(self.spark, f"{self.folder}/phases", {"session_id": self.id, "phase": phase, "ts": now()}, PHASES)

    def posts_path(self, version: int) -> str:
        return f"{self.folder}/posts_table/v={version}"

    def versions(self) -> list[int]:
        return files.finished_versions(f"{self.folder}/posts_table")

    def posts(self) -> DataFrame | None:
        found = self.versions()
        return self.spark.read.parquet(self.posts_path(found[-1])) if found else None

    def write_posts(self, fresh: DataFrame, whole: bool = False) -> None:
        """The next version: old posts keep their order, replaced in place by URL; new ones follow. whole: the old ones go."""
        old, version = None if whole else self.posts(), (self.versions() or [0])[-1] + 1
        merged = fresh if old is None else incremental.merge(old, fresh.select(*old.columns))
        order = ["pos", "url"] if old is None else ["added", "pos", "url"]
        again = numbered(merged.withColumnRenamed("pos", "__pos"), [c if c != "pos" else "__pos" for c in order], self.stage("merged"))
        again.drop("added", "__pos").write.mode("overwrite").parquet(self.posts_path(version))

    def extract(self, pages: DataFrame, config: Config) -> DataFrame:
        """Validated posts of pages; every page's outcome is recorded: completed, or failed with its error. Pages without a URL have no event."""
        path = self.stage("extracted")
        extract.extract_posts(pages, config).write.mode("overwrite").parquet(path)
        found = self.spark.read.parquet(path)
        good = validate.validate_posts(positioned(found.where("error IS NULL").drop("error"), self.stage("positions")), config)
        outcome = found.select("url", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), "error", F.length("content_html").cast("long").alias("html_len"), F.size("images").cast("long").alias("n_images"))
        self.record(outcome)
        return good

    def publish(self, posts: DataFrame, config: Config) -> None:
        """Every output from the whole post table."""
        stamp = now().isoformat(timespec="seconds")
        sinks.write_archive(posts, f"{self.folder}/archive")
        sinks.write_main_document(posts, self.folder, stamp)
        sinks.write_post_files(posts, self.folder)
        sinks.write_indexes(posts, f"{self.folder}/indexes")
        sinks.one_document(archive.site_metadata(posts), f"{self.folder}/site_metadata")
        report = validate.validation_report(posts, posts)
        sinks.one_document(report, f"{self.folder}/validation_report")
        sinks.one_document(validate.issue_counts(posts), f"{self.folder}/validation_issues")
        files.write_text(self.folder, "validation_summary.txt", validate.validation_summary(report).first().summary)
        sinks.write_named_files(markdown.markdown_files(posts, config.site_url, now().date().isoformat()), f"{self.folder}/markdown")
        stats = markdown.readme_stats(posts).first().asDict()
        files.write_text(f"{self.folder}/markdown", "README.md", markdown.readme(stats, config.site_url))
        files.write_text(f"{self.folder}/markdown", "_config.yml", markdown.site_config(config.site_url, config.site_url))


def run_archive(spark: SparkSession, pages: DataFrame, folder: str, config: Config, resume: bool = True) -> dict:
    """Phase by phase: extraction of what is not completed, then outputs from everything; a run that broke off goes on after its last finished phase."""
    session = Session(spark, folder)
    began = now()
    done = session.phase() if resume else None
    if state.PHASES.index(done or state.PHASES[0]) < state.PHASES.index("extraction"):
        todo = pages
        if resume and session.versions():
            todo = pages.join(session.latest().where("status = 'completed'").select("url"), "url", "left_anti")
        fresh = session.extract(todo, config)
        session.write_posts(fresh, whole=not resume)
        session.finish("extraction")
    session.publish(session.posts(), config)
    session.finish("output_generation")
    session.finish("completed")
    return state.completion_summary(session.latest(), began, now()).first().asDict()


def run_incremental(spark: SparkSession, pages: DataFrame, folder: str, config: Config, since: datetime.datetime | None = None) -> dict:
    """Difference to the last version, merge, outputs, log."""
    session = Session(spark, folder)
    old = session.posts()
    if old is None:
        raise SystemExit("no archive yet: run archive first")
    path = session.stage("new")
    session.extract(pages, config).write.mode("overwrite").parquet(path)
    new = spark.read.parquet(path)
    hashed = incremental.with_hash(new).withColumn("__modified", F.try_to_timestamp("modified_date"))
    stamp = now().isoformat()
    changes = incremental.diff(incremental.with_hash(old), hashed, modified="__modified", since=since)
    listed = f"{session.folder}/updated_urls"
    changes.where("status IN ('new', 'changed')").select(F.lit(stamp).alias("timestamp"), "url", "status").write.mode("append").parquet(listed)
    counts = {r.status: r.n for r in incremental.diff_counts(changes).collect()}
    mine = readers.updated_urls(spark, listed).where(F.col("timestamp") == stamp)
    session.write_posts(new.join(mine.select("url"), "url", "left_semi"))
    session.publish(session.posts(), config)
    n = counts.get("new", 0) + counts.get("changed", 0)
    sinks.append_log(spark, f"{session.folder}/update_log", {"timestamp": stamp, "successful_updates": mine.count(), "total_requested_updates": n}, UPDATE_LOG)
    return counts


def run_retry(spark: SparkSession, pages: DataFrame, folder: str, config: Config) -> dict:
    """Extract again what failed; what fails again stays failed."""
    session = Session(spark, folder)
    before = session.stage("failed")
    session.latest().write.mode("overwrite").parquet(before)
    latest = spark.read.parquet(before)
    again = pages.join(state.to_retry(latest, "url"), "url", "left_semi")
    if not again.isEmpty():
        fresh = session.extract(again, config)
        if not fresh.isEmpty():
            session.write_posts(fresh)
            session.publish(session.posts(), config)
    return state.retry_summary(latest, session.latest(), "url").first().asDict()


def run_historical(spark: SparkSession, pages: DataFrame, folder: str, config: Config, low: int = 2005, high: int = 2014, listed: DataFrame | None = None) -> dict:
    """Old posts of pages, or of those that a saved list of URLs names: table, Markdown, failed URLs, years, summary."""
    named = pages if listed is None else pages.join(listed.select("url").distinct(), "url", "left_semi")
    old = named.where(urls.is_historical(F.col("url"), tuple(f"/{s.strip('/')}/" for s in config.sections), low, high))
    stage = f"{folder.rstrip('/')}/staging/historical-{uuid.uuid4().hex}"
    extract.extract_historical(old, config.default_author).write.parquet(stage)
    found = spark.read.parquet(stage)
    good = F.coalesce(F.col("content"), F.lit("")) != ""
    years = discovery.year_breakdown(old, low, high)
    return sinks.write_historical(found.where(good), found.where(~good), years, folder, now().isoformat(timespec="seconds"))


def discover(pages: DataFrame, sitemaps: DataFrame | None, feeds: DataFrame | None, config: Config) -> DataFrame:
    """(url, method) over the methods that there is input for, each URL once by each."""
    methods = {"crawl": discovery.crawl(pages, config.site_url, config.urls)}
    root = pages.sparkSession.createDataFrame([(config.site_url.rstrip("/"),)], "site string")
    at = lambda paths: discovery.posts_at(discovery.places(root, discovery.expanded(paths, config.sections)), pages, config.site_url, config.urls).select(F.col("post").alias("url"))
    methods["navigation"] = at(discovery.SECTION_PLACES + discovery.EXPLORED_SECTIONS)
    methods["archives"] = at(discovery.ARCHIVE_PLACES + discovery.EXPLORED_ARCHIVES)
    methods["historical"] = discovery.historical_scan(pages, config.site_url, range(2005, 2015), config.sections, config.urls)
    if sitemaps is not None:
        methods["sitemap"] = readers.post_urls(sitemaps, "content", readers.sitemap_locations, config.urls)
    if feeds is not None:
        methods["rss"] = readers.post_urls(feeds, "content", readers.feed_links, config.urls)
    return discovery.union_methods({k: v.select("url").distinct() for k, v in methods.items()})


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillstack", description=__doc__)
    parser.add_argument("--config")
    parser.add_argument("--log-level", default="INFO")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("archive", "incremental", "retry-failed", "historical", "status"):
        command = commands.add_parser(name)
        command.add_argument("--output", required=True)
        if name != "status":
            command.add_argument("--pages", required=True, help="Parquet table with url and html")
        if name == "archive":
            command.add_argument("--no-resume", action="store_true")
        if name == "incremental":
            command.add_argument("--since", type=datetime.datetime.fromisoformat)
    commands.add_parser("create-config").add_argument("path")
    given = parser.parse_args(args)
    logging.basicConfig(level=given.log_level)
    if given.command == "create-config":
        save_config(Config(), given.path)
        return
    config = load_config(given.config)
    spark = SparkSession.builder.appName("quillstack").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.command == "status":
        print(state.progress(Session(spark, given.output).latest()).first().asDict())
        return
    pages = spark.read.parquet(given.pages)
    if given.command == "archive":
        print(run_archive(spark, pages, given.output, config, not given.no_resume))
    elif given.command == "incremental":
        print(run_incremental(spark, pages, given.output, config, given.since))
    elif given.command == "historical":
        print(run_historical(spark, pages, given.output, config))
    else:
        print(run_retry(spark, pages, given.output, config))


if __name__ == "__main__":
    main()
