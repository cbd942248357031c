"""Incremental archive over Structured Streaming: micro-batches of posts are upserted by URL, with the same result as one batch merge.

Each micro-batch writes a new snapshot of the post table named by its batch id, so a replayed batch writes the same snapshot again; a pointer
file names the latest one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.archive import last_by_key
from ..operators.incremental import merge


class SnapshotTable:
    """Versions of a table under one folder: v=<batch id>."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in done)

    def read(self, before: int | None = None) -> DataFrame:
        found = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v={found[-1]}") if found else self.spark.createDataFrame([], self.schema)

    def write(self, frame: DataFrame, version: int) -> None:
        frame.write.mode("overwrite").parquet(f"{self.folder}/v={version}")


def upsert_stream(stream: DataFrame, target: SnapshotTable, checkpoint: str, key: str = "url", order: str = "pos") -> StreamingQuery:
    """Upsert every micro-batch; the last row of a key within a batch counts. Idempotent by batch id."""

    def step(batch: DataFrame, batch_id: int) -> None:
        merged = merge(target.read(before=batch_id), last_by_key(batch, key, order), key, order)
        target.write(merged.select(*[f.name for f in stream.schema.fields]), batch_id)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_urls_stream(stream: DataFrame, key: str = "url") -> DataFrame:
    """Each URL once, over restarts too: deduplicated by the query's own state."""
    return stream.dropDuplicates([key])


def windowed_counts(events: DataFrame, ts: str, by: str, length: str = "1 hour", late: str = "10 minutes", value: Column | None = None) -> DataFrame:
    """Tumbling counts and sums of a stream or table of events; a stream's state is dropped behind the watermark."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    return timed.groupBy(F.window(ts, length).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value if value is not None else F.lit(1)).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")
