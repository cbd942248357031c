"""Shared plumbing of the training-text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: ASCII white space: what separates words in every contract of this package.
SPACES = " \t\n\x0b\x0c\r"

#: Rows of an Arrow batch sent to a Python worker; texts may be long, so far fewer than Spark's 10,000.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def session(df: DataFrame) -> SparkSession:
    """The frame's session, with this package on the workers and Arrow batches small enough for long texts."""
    spark = df.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def send_file(spark: SparkSession, path: str) -> str:
    """Send a file of the driver to the executors; returns the name that received takes."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def received(name: str) -> str:
    """Where a sent file is on this executor."""
    return SparkFiles.get(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share; a cluster must name one, a local master (one machine) gets its own."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="quillstack-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, frame: DataFrame) -> None:
    """Delete the folders behind a materialized frame that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = shared_dir(spark).split(":", 1)[-1].lstrip("/")
    for folder in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
        if root in folder:  # only what materialize wrote
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


# ---- row numbers: a decision about a row goes back to the row's own task, the row's text stays where it is ------------------------------------

#: A row's number: its task above these bits, its place in the task below.
PLACE_BITS = 33


#: What may stand above a scan of files for two scans to give the same rows in the same order.
NARROW = frozenset(("Project", "Filter", "SubqueryAlias", "LogicalRelation", "View"))


def stable(docs: DataFrame) -> DataFrame:
    """The frame itself if it is read from files row by row, else a written copy: a shuffle below would number rows differently as columns are pruned."""
    pending, names = [docs._jdf.queryExecution().analyzed()], set()
    while pending:
        node = pending.pop()
        names.add(node.nodeName().split("(")[0].strip())
        children = node.children()
        pending += [children.apply(k) for k in range(children.size())]
    return docs if any(n.startswith(("LogicalRelation", "Relation")) for n in names) and all(n in NARROW or n.startswith("Relation") for n in names) else materialize(docs, "rows")


def numbered(docs: DataFrame, name: str = "__no") -> DataFrame:
    """A stable frame with each row's number; two scans of the same files give the same numbers."""
    return docs.withColumn(name, F.monotonically_increasing_id())


def write_notes(notes: DataFrame, number: str, tag: str) -> str:
    """Write rows about numbered rows to the shared folder, a folder for each task of the numbered frame; returns the path."""
    path = new_path(notes.sparkSession, tag)
    notes.withColumn("part", F.shiftrightunsigned(number, PLACE_BITS)).repartition("part").write.partitionBy("part").parquet(path)
    return path


def read_notes(path: str, part: int) -> pa.Table | None:
    """What was written about one task's rows; called on executors. The shared folder may be of any kind that Arrow opens."""
    from pyarrow import dataset, fs

    path = f"{path}/part={part}"
    system, place = (fs.LocalFileSystem(), "/" + path.split(":", 1)[-1].lstrip("/")) if path.startswith(("/", "file:")) else fs.FileSystem.from_uri(path)
    if system.get_file_info(place).type == fs.FileType.NotFound:
        return None
    return dataset.dataset(place, filesystem=system, format="parquet", exclude_invalid_files=False, ignore_prefixes=["_", "."]).to_table()


def with_notes(numbers: np.ndarray, path: str, held: dict) -> tuple[np.ndarray, pa.Table | None]:
    """(for each row its note's place in the table, -1 without one; the table) of a batch of numbered rows; held keeps the task's table."""
    part = int(numbers[0] >> PLACE_BITS)
    if held.get("part") != part:
        finish_notes(held)
        table = read_notes(path, part)
        held |= {"part": part, "table": table, "seen": 0}
        if table is not None:
            number = table["__no"].to_numpy()
            held["order"] = np.argsort(number)
            held["sorted"] = number[held["order"]]
    if held["table"] is None:
        return np.full(len(numbers), -1), None
    at = np.minimum(np.searchsorted(held["sorted"], numbers), len(held["sorted"]) - 1)
    found = np.where(held["sorted"][at] == numbers, held["order"][at], -1)
    held["seen"] += int((found >= 0).sum())
    return found, held["table"]


def finish_notes(held: dict) -> None:
    """Every note must have met its row: a scan that numbered rows differently is an error, never a wrong result."""
    if held.get("table") is not None and held["seen"] != len(held["table"]):
        raise RuntimeError(f"{len(held['table']) - held['seen']} decisions met no row: the documents changed between two scans")


def without_rows(docs: DataFrame, drops: DataFrame, tag: str) -> DataFrame:
    """A stable frame without the rows whose numbers (``__no``, as ``numbered`` gives) drops lists: read again and filtered in place, no text is shuffled."""
    session(docs)
    names, path = docs.columns, write_notes(drops.select("__no"), "__no", tag)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            if batch.num_rows:
                numbers = batch.column(len(names)).to_numpy()
                dropped, _ = with_notes(numbers, path, held)
                batch = batch.filter(pa.array(dropped < 0))
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=names)
        finish_notes(held)

    return numbered(docs).mapInArrow(run, docs.schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a long column and where it is null (there the value is 0)."""
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def bytes_of(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of a string or binary column, null as empty."""
    for value in column.cast(pa.binary()).to_pylist():
        yield value or b""


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that the operators read, under names no input column can clash with."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
