"""Exact duplicates by a tree merge of sorted digest runs.

Every partition sorts the SHA-256 digests of its texts into runs. A run goes through a butterfly of
``fan_in``-way rounds: in round r a node cuts its run by the r-th digit of the digest and sends each slice to
the node whose r-th digit is that one; the receiver multiway-merges what arrives. After log(nodes) rounds a node
holds, fully merged, the digests whose leading digits are its own number, so no task ever holds more than its share,
and a hot group is one record of a run from its first partition on. Each merge compares whole 32-byte digests and keeps
per digest the identifier that stays, the number of rows and the number of rows that carry this identifier.

Defined cases: a null text equals the empty text; a null id is smaller than every id, and a group of null ids only has
a null keep_id; of rows that repeat both the id that stays and the text, exactly one is kept, the first in the table's files; an empty table gives no rows;
other columns are carried by ``keep_one`` and ignored by ``exact_groups``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import identified, materialize, session, shuffle_partitions, stable, without_rows

NULL_ID = np.int64(-(2**63))
#: Words of a record: four of the digest (big-endian order), the id that stays, rows, rows with that id.
WIDTH = 7


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def merge_runs(runs: list[np.ndarray], largest: bool = True) -> np.ndarray:
    """Multiway merge of sorted runs of uint64 records into one with a record per digest.

    The stable sort finds the runs already in order and merges them; ties of the first word are settled on the whole digest.
    """
    rows = np.concatenate(runs) if len(runs) > 1 else runs[0]
    if len(rows) < 2:
        return rows
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    same = rows[1:, 0] == rows[:-1, 0]
    differ = same & (rows[1:, 1:4] != rows[:-1, 1:4]).any(axis=1)
    if differ.any():
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        same = (rows[1:, :4] == rows[:-1, :4]).all(axis=1)
    starts = np.flatnonzero(np.concatenate(([True], ~same)))
    if len(starts) == len(rows):
        return rows
    ids = rows[:, 4].view(np.int64)
    best = (np.maximum if largest else np.minimum).reduceat(ids, starts)
    carries = ids == np.repeat(best, np.diff(np.append(starts, len(rows))))
    out = rows[starts].copy()
    out[:, 4] = best.view(np.uint64)
    out[:, 5] = np.add.reduceat(rows[:, 5], starts)
    out[:, 6] = np.add.reduceat(np.where(carries, rows[:, 6], np.uint64(0)), starts)
    return out


def _records(digests: pa.Array, ids: pa.Array) -> np.ndarray:
    words = np.frombuffer(b"".join(digests.to_pylist()), dtype=">u8").reshape(-1, 4)
    rows = np.ones((len(words), WIDTH), dtype=np.uint64)
    rows[:, :4] = words
    rows[:, 4] = ids.fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return rows


def _slices(node: int, run: np.ndarray, level: int, levels: int, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Cut a sorted run by its digit of this round; the digit replaces the node's own."""
    digits = (run[:, 0] >> np.uint64(64 - bits * (level + 1))) & np.uint64((1 << bits) - 1)
    place = bits * (levels - 1 - level)
    cuts = np.searchsorted(digits, np.arange((1 << bits) + 1, dtype=np.uint64))
    for digit in range(1 << bits):
        if cuts[digit] < cuts[digit + 1]:
            yield (node & ~(((1 << bits) - 1) << place)) | digit << place, run[cuts[digit] : cuts[digit + 1]]


def _message(parts: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([n for n, _ in parts], pa.int32()), pa.array([r.tobytes() for _, r in parts], pa.binary())], ["node", "run"])


def _first_runs(levels: int, bits: int, run_rows: int, largest: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        node = (context.partitionId() if context else 0) % (1 << bits * levels)
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held)
            held.clear()
            rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
            return _message([*_slices(node, merge_runs([rows], largest), 0, levels, bits)])

        for batch in batches:
            if batch.num_rows:
                held.append(_records(batch["digest"], batch["doc_id"]))
                if sum(map(len, held)) >= run_rows:
                    yield flush()
        if held:
            yield flush()

    return run


def _round(level: int, levels: int, bits: int, largest: bool) -> Callable:
    """Merge what arrived at each node of this partition; pass it on, or give the groups after the last round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = defaultdict(list)
        for batch in batches:
            for node, blob in zip(batch["node"].to_pylist(), batch["run"].to_pylist(), strict=True):
                held[node].append(np.frombuffer(blob, dtype=np.uint64).reshape(-1, WIDTH))
        for node in list(held):
            merged = merge_runs(held.pop(node), largest)
            if level < levels:
                yield _message([*_slices(node, merged, level, levels, bits)])
                continue
            groups = merged[merged[:, 5] > 1]
            keep = groups[:, 4].view(np.int64)
            yield pa.record_batch(
                [
                    pa.array([row.tobytes() for row in groups[:, :4].astype(">u8")], pa.binary()),
                    pa.array(keep, pa.int64(), mask=keep == NULL_ID),
                    pa.array(groups[:, 5].astype(np.int64)),
                    pa.array(groups[:, 6].astype(np.int64)),
                ],
                ["digest", "keep_id", "group_size", "n_keep"],
            )

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in_bits: int = 3, run_rows: int = 1 << 18, largest: bool = True) -> DataFrame:
    """A row (digest, keep_id, group_size, n_keep) for each text that two or more rows have."""
    spark = session(docs)
    digests = identified(docs, id_col, text_col).select("doc_id", digest_of(F.col("text")).alias("digest"))
    sources = max(2, docs.rdd.getNumPartitions())
    levels = max(1, -(-(sources - 1).bit_length() // fan_in_bits))
    nodes = 1 << fan_in_bits * levels
    width = min(nodes, max(shuffle_partitions(spark), nodes >> fan_in_bits))
    runs = digests.mapInArrow(_first_runs(levels, fan_in_bits, run_rows, largest), "node int, run binary")
    for level in range(1, levels + 1):
        schema = "node int, run binary" if level < levels else "digest binary, keep_id long, group_size long, n_keep long"
        runs = runs.repartition(width, "node").mapInArrow(_round(level, levels, fan_in_bits, largest), schema)
    return runs


def _flag(rows: DataFrame, groups: DataFrame, row_id: str, digest: str, kept: str, tie: str) -> DataFrame:
    """Join the groups to rows by digest (a hot group is a skewed left join, which AQE splits) and mark what stays; of rows with equal id and text the least tie."""
    groups = materialize(groups, "exact-groups").select(F.col("digest").alias("__d"), "keep_id", "group_size", "n_keep")
    joined = rows.join(groups, rows[digest] == groups["__d"], "left")
    stays = F.col("group_size").isNull() | F.col(row_id).eqNullSafe(F.col("keep_id"))
    tied_groups = groups.where("n_keep > 1")
    if not tied_groups.isEmpty():  # repeated rows: the first of those that tie, found with partial sums
        first = joined.where(stays & (F.col("n_keep") > 1)).groupBy(F.col(digest).alias("__t")).agg(F.min(tie).alias("__first"))
        joined = joined.join(first, F.col(digest) == F.col("__t"), "left")
        stays = stays & (F.col("__first").isNull() | (F.col(tie) == F.col("__first")))
    return joined.withColumn(kept, F.coalesce(stays, F.lit(False)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = stable(docs)
    digests = identified(docs, id_col, text_col).select("doc_id", digest_of(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("__no"))
    flagged = _flag(digests, exact_groups(docs, id_col, text_col, largest=largest), "doc_id", "digest", "kept", "__no")
    return flagged.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True) -> DataFrame:
    """The input's rows and columns without the duplicates. Only digests and row numbers move; the rows are read again and filtered where they are."""
    docs = stable(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), digest_of(F.col(text_col).cast("string")).alias("__digest"), F.monotonically_increasing_id().alias("__no"))
    flagged = _flag(rows, exact_groups(docs, id_col, text_col, largest=largest), "__id", "__digest", "__kept", "__no")
    return without_rows(docs, flagged.where(~F.col("__kept")), "exact-drops")
