from __future__ import annotations

import datetime

from quillstack.operators.archive import last_by_key
from quillstack.operators.incremental import merge
from quillstack.streaming.updates import SnapshotTable, new_urls_stream, upsert_stream, windowed_counts

SCHEMA = "url string, pos int, title string"


def test_stream_equals_batch_and_survives_a_replay(spark, tmp_path):
    first = spark.createDataFrame([("a", 1, "1"), ("b", 2, "2")], SCHEMA)
    second = spark.createDataFrame([("b", 3, "new"), ("c", 4, "3"), ("c", 5, "4")], SCHEMA)
    target = SnapshotTable(spark, f"file://{tmp_path}/t", SCHEMA)
    for k, side in enumerate((first, second)):
        side.coalesce(1).write.parquet(f"{tmp_path}/in/batch={k}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/batch=*").select("url", "pos", "title")
        upsert_stream(stream, target, f"{tmp_path}/checkpoint").awaitTermination()
    batch = merge(first, last_by_key(second, "url", "pos")).select("url", "title")
    assert sorted(map(tuple, target.read().select("url", "title").collect())) == sorted(map(tuple, batch.collect()))
    version = target.versions()[-1]
    target.write(merge(target.read(before=version), last_by_key(second, "url", "pos")).select("url", "pos", "title"), version)
    assert sorted(r.title for r in target.read().collect()) == ["1", "4", "new"]


def test_new_urls_and_windows(spark, tmp_path):
    spark.createDataFrame([("a",), ("a",), ("b",)], "url string").coalesce(1).write.parquet(f"{tmp_path}/u")
    query = new_urls_stream(spark.readStream.schema("url string").parquet(f"{tmp_path}/u")).writeStream.format("memory").queryName("seen_urls").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.url for r in spark.table("seen_urls").collect()) == ["a", "b"]
    t = datetime.datetime(2024, 1, 1, 5, 59)
    events = spark.createDataFrame([(t, "x"), (t + datetime.timedelta(minutes=2), "x")], "ts timestamp, kind string")
    assert sorted((r.start.hour, r.n) for r in windowed_counts(events, "ts", "kind").collect()) == [(5, 1), (6, 1)]
