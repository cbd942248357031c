"""Incremental, session-state and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import archive, incremental, state
from .registry import query
from .stand_ins import documents, events, orders, snapshots

OLD = "SELECT doc_id AS url, text, lang, source FROM documents WHERE doc_id % 10 <> 0"
NEW = "SELECT doc_id AS url, CASE WHEN doc_id % 10 = 2 THEN text || ' (edited)' ELSE text END AS text, lang, source FROM documents WHERE doc_id % 10 <> 1"


@query(f"""SELECT coalesce(a.url, b.url) AS url, CASE WHEN a.url IS NULL THEN 'new' WHEN b.url IS NULL THEN 'removed' WHEN sha256(a.text) = sha256(b.text) THEN 'unchanged' ELSE 'changed' END AS status FROM ({OLD}) a FULL JOIN ({NEW}) b ON a.url = b.url""")
def incremental_diff(spark, sf):
    old, new = snapshots(spark, sf)
    return incremental.diff(old, new)


@query("SELECT CASE WHEN doc_id % 10 = 0 THEN 'new' WHEN doc_id % 10 = 1 THEN 'removed' WHEN doc_id % 10 = 2 THEN 'changed' ELSE 'unchanged' END AS status, count(*) AS n FROM documents GROUP BY 1")
def incremental_counts(spark, sf):
    old, new = snapshots(spark, sf)
    return incremental.diff_counts(incremental.diff(old, new))


@query("SELECT o_orderkey AS url, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'unchanged' WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM orders")
def incremental_diff_since(spark, sf):
    import datetime

    o = orders(spark, sf).select(F.col("o_orderkey").alias("url"), F.col("o_totalprice").cast("string").alias("content_hash"), "o_orderdate")
    new = o.withColumn("content_hash", F.when(F.col("url") % 7 == 0, "other").otherwise(F.col("content_hash")))
    return incremental.diff(o, new, modified="o_orderdate", since=datetime.datetime(1996, 1, 1))


@query(f"SELECT coalesce(b.url, a.url) AS url, md5(CASE WHEN b.url IS NOT NULL THEN b.text ELSE a.text END) AS digest, a.url IS NULL AS added FROM ({OLD}) a FULL JOIN ({NEW}) b ON a.url = b.url")
def merge_upsert(spark, sf):
    old, new = snapshots(spark, sf)
    return incremental.merge(old, new).select("url", F.md5("text").alias("digest"), "added")


@query("SELECT doc_id AS url FROM documents WHERE doc_id % 10 = 1")
def orphaned_urls(spark, sf):
    old, new = snapshots(spark, sf)
    return incremental.missing_keys(old, new)


@query("SELECT doc_id AS url FROM documents WHERE doc_id % 10 = 0")
def pending_urls(spark, sf):
    old, new = snapshots(spark, sf)
    return incremental.missing_keys(new, old)


@query("SELECT doc_id AS url FROM documents WHERE doc_id % 10 NOT IN (0, 1)")
def common_urls(spark, sf):
    old, new = snapshots(spark, sf)
    return incremental.common_keys(old, new)


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")
def dedupe_keep_first(spark, sf):
    return archive.first_by_key(documents(spark, sf), "text", "doc_id").select("doc_id", F.md5("text").alias("digest"))


@query("SELECT max(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")
def dedupe_last_wins(spark, sf):
    return archive.last_by_key(documents(spark, sf), "text", "doc_id").select("doc_id", F.md5("text").alias("digest"))


STATUS = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'seen' END"
LATEST = f"SELECT user_id, arg_max({STATUS}, (ts, event_id)) AS status FROM events GROUP BY user_id"


def _state(spark, sf):
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("seen")
    return state.latest_status(events(spark, sf).withColumn("status", status), ["user_id"], "status", "ts", "event_id")


@query(LATEST)
def session_state_latest(spark, sf):
    return _state(spark, sf).select("user_id", "status")


@query(f"SELECT count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) AS total, 100.0::DOUBLE * count(*) FILTER (status = 'completed') / count(*) AS completion_rate FROM ({LATEST})")
def progress_summary(spark, sf):
    return state.progress(_state(spark, sf))


@query("SELECT count(*) FILTER (event_type = 'purchase') AS completed, round((1000000 - count(*) FILTER (event_type = 'purchase')) * avg(value) FILTER (event_type = 'purchase'), 2) AS remaining_seconds FROM events")
def eta_estimate(spark, sf):
    return state.remaining_seconds(events(spark, sf), "value", F.col("event_type") == "purchase", 1_000_000).withColumn("remaining_seconds", F.round("remaining_seconds", 2))


@query("SELECT event_id, user_id, sum(event_id) OVER w AS ids_so_far, count(*) OVER w AS n_so_far, max(value) OVER w AS peak FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_totals(spark, sf):
    return state.running_totals(events(spark, sf), ["user_id"], ["ts", "event_id"], {"ids_so_far": "event_id"}, "value").select("event_id", "user_id", F.col("ids_so_far").cast("decimal(38,0)").alias("ids_so_far"), "n_so_far", "peak")


@query(f"SELECT user_id FROM ({LATEST}) WHERE status = 'failed'")
def retry_set(spark, sf):
    return state.to_retry(_state(spark, sf), "user_id")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def update_log_last_50(spark, sf):
    return incremental.keep_latest(events(spark, sf), "ts", 50, "event_id").select("event_id", "user_id")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_tumbling_watermark(spark, sf):
    from ..streaming.updates import windowed_counts

    return windowed_counts(events(spark, sf), "ts", "event_type").select("start", "event_type", "n")


@query(f"SELECT coalesce(b.url, a.url) AS url, md5(CASE WHEN b.url IS NOT NULL THEN b.text ELSE a.text END) AS digest FROM ({OLD}) a FULL JOIN ({NEW}) b ON a.url = b.url")
def stream_upsert_equivalence(spark, sf):
    """Two files of posts stream into the table one after the other; the last state equals the batch merge."""
    import uuid

    from ..streaming.updates import SnapshotTable, upsert_stream

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillstack-")
    folder = f"{base}/upsert-{uuid.uuid4().hex}"
    columns = ["url", "pos", "text", "lang", "source"]
    old, new = (f.select(*columns) for f in snapshots(spark, sf))
    schema = old.schema
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    target = SnapshotTable(spark, f"{folder}/table", ddl)
    for k, side in enumerate((old, new)):
        side.write.parquet(f"{folder}/in/batch={k}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{folder}/in/batch=*")
        upsert_stream(stream.select(*columns), target, f"{folder}/checkpoint").awaitTermination()
    return target.read().select("url", F.md5("text").alias("digest"))
