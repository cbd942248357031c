"""SimHash near-duplicates with deletion-variant signatures.

Two fingerprints that differ in at most ``distance`` = 4 bits agree, in one of three segments, but for one bit at most
(three segments with two differing bits each would make six). So every fingerprint is indexed under each segment with one
bit deleted: 64 keys (position, segment without that bit). An equality shuffle on the key brings together every pair to be
linked; each candidate is verified on the whole fingerprints. A bucket gives a spanning forest of its verified links, never
all of its pairs; the forests of all buckets go through distributed connected components.

Equal fingerprints are collapsed first, so a group of copies is one node however large it is. A key that many fingerprints share (a large group of
near copies) is split before the shuffle: two of its fingerprints within the distance agree in one of five pieces of the bits that the key leaves out, so
each goes under its five pieces, and no pair is lost. Such keys are found on every 64th fingerprint by hash; which keys are split changes no result.

Defined cases: null and empty texts, and texts of white space only, have fingerprint zero and link like any other; a null
doc_id is never a component's smallest unless all its ids are null (then component_id is null); repeated rows give a row
each; of a component ``keep_representatives`` keeps the one row with the smallest id (rows with a null id last, then the first in the table's files); an empty table
gives no rows; other columns are carried by ``keep_representatives``, ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, identified, materialize, numbered, session, shuffle_partitions, stable, without_rows
from .components import connected_components, hub_join

SEED = 42
SHINGLE = 4
#: First bits of the segments for distance 4.
SEGMENTS = (0, 22, 43, 64)
#: Buckets up to this size are compared by shifted slices, larger ones block by block.
SMALL_BUCKET = 48
BLOCK = 2048
#: Keys of more fingerprints than this, and than this share of all entries, are split; one fingerprint in so many is looked at to find them.
HOT_KEY, HOT_SHARE, LOOKED_AT = 4 * BLOCK, 10_000, 64
#: First bits of the five pieces of what a key leaves out (43 bits at most).
PIECES = (0, 9, 18, 27, 35, 43)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of a UTF-8 text; 0 if it has no word."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], dtype=np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):
        bits = np.unpackbits(hashes[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    majority = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(majority.view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in bytes_of(batch["text"])], dtype=np.uint64).view(np.int64)
        yield pa.record_batch([batch["doc_id"], pa.array(prints, pa.int64()), batch["__no"]], ["doc_id", "fp", "__no"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, __no) of every row, by its number."""
    session(docs)
    return numbered(identified(docs, id_col, text_col)).mapInArrow(_fingerprints, "doc_id long, fp long, __no long")


def deletion_keys(fp: str = "fp"):
    """The 64 keys of a fingerprint: a segment without one bit, and which."""
    keys = []
    for low, high in zip(SEGMENTS, SEGMENTS[1:], strict=False):
        segment = F.shiftrightunsigned(F.col(fp), low).bitwiseAND(F.lit((1 << high - low) - 1))
        for bit in range(high - low):
            wild = segment.bitwiseAND(F.lit(~(1 << bit) & ((1 << high - low) - 1)))
            keys.append((F.shiftleft(wild, 6) + F.lit(low + bit)).cast("int"))
    return F.array(*keys)


def _hook(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the components of u and v; labels point to the least member."""
    while True:
        a, b = labels[u], labels[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            return
        np.minimum.at(labels, high, low)
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels[:] = jumped


def _link_block(prints: np.ndarray, at: np.ndarray, distance: int, labels: np.ndarray) -> None:
    """Link all pairs of one large bucket without listing them: block by block, hooked as they are found."""
    for i in range(0, len(at), BLOCK):
        left = prints[at[i : i + BLOCK]]
        for j in range(i, len(at), BLOCK):
            close = np.bitwise_count(left[:, None] ^ prints[at[j : j + BLOCK]][None, :]) <= distance
            a, b = np.nonzero(close)
            _hook(labels, at[i + a], at[j + b])


def _link_large(prints: np.ndarray, at: np.ndarray, distance: int, labels: np.ndarray) -> None:
    """Beyond a few blocks, only pairs that agree in one of distance + 1 pieces are compared: none that is close is missed."""
    if len(at) <= 4 * BLOCK:
        _link_block(prints, at, distance, labels)
        return
    edges = np.linspace(0, 64, distance + 2).astype(int)
    for low, high in zip(edges, edges[1:], strict=False):
        piece = (prints[at] >> np.uint64(low)) & np.uint64((1 << int(high - low)) - 1)
        order = np.argsort(piece, kind="stable")
        for part in np.split(at[order], np.flatnonzero(np.diff(piece[order])) + 1):
            if len(part) > 1:
                _link_block(prints, part, distance, labels)


def bucket_links(keys: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (fingerprint, its root) of the links inside buckets of equal key."""
    nodes, node = np.unique(prints, return_inverse=True)
    labels = np.arange(len(nodes))
    order = np.argsort(keys, kind="stable")
    keys, node = keys[order], node[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    for start, size in zip(starts[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET], strict=True):
        _link_large(nodes, node[start : start + size], distance, labels)
    small = np.repeat(sizes <= SMALL_BUCKET, sizes)
    room = np.repeat(starts + sizes, sizes)  # where the bucket of each row ends
    at = np.flatnonzero(small & (np.repeat(sizes, sizes) > 1))
    for shift in range(1, SMALL_BUCKET):
        at = at[at + shift < room[at]]
        if not len(at):
            break
        u, v = node[at], node[at + shift]
        close = np.bitwise_count(nodes[u] ^ nodes[v]) <= distance
        _hook(labels, u[close], v[close])
    linked = np.flatnonzero(labels != np.arange(len(nodes)))
    return nodes[linked], nodes[labels[linked]]


def _forest(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = [], []
        for batch in batches:
            keys.append(batch["key"].to_numpy())
            prints.append(batch["fp"].to_numpy().view(np.uint64))
        if keys:
            u, v = bucket_links(np.concatenate(keys), np.concatenate(prints), distance)
            yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return run


def split_hot(variants: DataFrame, distinct: DataFrame, n: int, hot_key: int = HOT_KEY) -> DataFrame:
    """(key long, fp): entries of hot keys under the pieces of their fingerprint as well."""
    limit = max(hot_key, 64 * n // HOT_SHARE)
    looked = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(LOOKED_AT)) == 0).select(F.explode(deletion_keys()).alias("hot"))
    hot = looked.groupBy("hot").agg(F.count("*").alias("__n")).where(F.col("__n") > max(1, limit // LOOKED_AT)).select("hot")  # HOT_SHARE rows or so at most
    place, low, high = F.col("key").bitwiseAND(F.lit(63)), F.col("fp").bitwiseAND(F.lit((1 << SEGMENTS[1]) - 1)), F.shiftrightunsigned("fp", SEGMENTS[2])
    others = (  # the bits outside the key's segment
        F.when(place < SEGMENTS[1], F.shiftrightunsigned("fp", SEGMENTS[1]))
        .when(place < SEGMENTS[2], F.shiftleft(high, SEGMENTS[1]).bitwiseOR(low))
        .otherwise(F.col("fp").bitwiseAND(F.lit((1 << SEGMENTS[2]) - 1)))
    )
    pieces = [F.shiftrightunsigned(others, a).bitwiseAND(F.lit((1 << b - a) - 1)) for a, b in zip(PIECES, PIECES[1:], strict=False)]
    parts = F.array(*[F.xxhash64(F.col("key"), F.lit(k), piece) for k, piece in enumerate(pieces)])
    marked = variants.join(F.broadcast(hot), F.col("key") == F.col("hot"), "left")
    return marked.select(F.explode(F.when(F.col("hot").isNull(), F.array(F.col("key").cast("long"))).otherwise(parts)).alias("key"), "fp")


def near_groups(prints: DataFrame, distance: int = 4, task_rows: int = 2_000_000, hot_key: int = HOT_KEY) -> DataFrame:
    """(fp, component_id, keep_no) for each distinct fingerprint of (doc_id, fp, __no) rows; keep_no is the number of the component's representative."""
    spark = session(prints)
    prints = prints if "__no" in prints.columns else numbered(prints)
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "__no")
    distinct = materialize(prints.groupBy("fp").agg(F.min(order).alias("least")), "prints")
    n = distinct.count()
    width = max(shuffle_partitions(spark), -(-n * 64 // task_rows))
    variants = distinct.select(F.explode(deletion_keys()).alias("key"), "fp")
    links = split_hot(variants, distinct, n, hot_key).repartition(width, "key").mapInArrow(_forest(distance), "u long, v long")
    roots = connected_components(links)
    rooted = materialize(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("n"))
    return hub_join(rooted, "root", least, n).select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.__no").alias("keep_no"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, distance: int) -> DataFrame:
    """(doc_id, fp, __no, component_id, keep_no) of every row."""
    if distance != 4:
        raise ValueError("the segments are cut for distance 4")
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    groups = near_groups(prints, distance).withColumnRenamed("fp", "__fp")
    return prints.join(groups, prints["fp"] == groups["__fp"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    return _grouped(docs, id_col, text_col, distance).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, one row of each component. Only fingerprints and row numbers move; the rows are read again and filtered where they are."""
    docs = stable(docs)
    return without_rows(docs, _grouped(docs, id_col, text_col, 4).where("__no <> keep_no"), "near-drops")
