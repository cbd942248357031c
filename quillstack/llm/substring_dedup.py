"""Repeated word windows by Rabin-Karp hashes, counted over the whole corpus.

A task hashes every window of ``width`` words of its documents with two independent polynomials (over the two halves of the words' 128-bit XXH3
values; prefix sums make a window a subtraction and a product). A window's hash is 88 bits at every size and setting: 64 of the first and 24 of the
second; words themselves are not compared, so of 10**13 distinct windows one false match in thousands of such corpora is expected. Within a block
of documents equal windows meet first: all but those of the smallest doc_id are repeats whatever else the corpus holds, so a window in a third of all
documents leaves each block once. The remaining distinct hashes are packed, eleven bytes a window with its place, and dealt by hash range (in two hops
where there are more ranges than a block should send messages to), one range to a task; the receiving task counts them by sorting and tells, for each, whether
a smaller doc_id has it (a shuffle of packed runs, then numpy: a row a window would be five times the data). Covered starts go, packed too, to the task of
their row's number, whatever text it has, merge into maximal intervals, and wait in the shared folder for the task that reads the row: texts are
read again and cut where they are, never shuffled.

Defined cases: null and empty texts have no words, n_removed 0 and the hash of the empty text; a null doc_id is neither smaller
nor larger than any, so such rows are returned whole and cover nothing; rows that repeat a doc_id do not cover each other, each
is judged on its own text; texts shorter than a window stay whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, finish_notes, identified, numbered, session, shuffle_partitions, stable, with_notes, write_notes

WINDOW = 50
#: Odd, so that they have inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Words of the documents that a task hashes at once, and windows that a receiving task should get.
BLOCK_WORDS = 1 << 20
TASK_WINDOWS = 1 << 21
#: Ranges that a block sends messages to at most; beyond, a first hop goes to as many groups of ranges.
FAN = 1 << 12
#: Bytes of a window's hash: eight of the first polynomial, three of the second.
HASH_BYTES = 11
SECOND_BITS = np.uint64((1 << 8 * (HASH_BYTES - 8)) - 1)


class WordHashes(dict):
    """Word to the two halves of its XXH3 value. None are kept: a kept value takes some 210 bytes, and hashing all words of a text at once is quicker than finding theirs. A subclass may set others."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        both = xxhash.xxh3_128_intdigest(word)
        return both & 0xFFFFFFFFFFFFFFFF, both >> 64

    def halves(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The first and the second halves of all words."""
        if type(self) is WordHashes:
            both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").reshape(-1, 2)[:, ::-1].astype(np.uint64)
        else:
            both = np.array([self[w] for w in words], np.uint64).reshape(-1, 2)
        return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & (1 << 64) - 1))
    out[0] = 1
    return np.multiply.accumulate(out)


class RollingHash:
    """Rabin-Karp hashes of all windows of a sequence of word values."""

    def __init__(self, width: int, base: int = BASES[0]):
        self.width, self.base, self.inverse = width, base, pow(base, -1, 1 << 64)
        self.forward, self.back = _powers(self.base, 1024), _powers(self.inverse, 1024)

    def windows(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        if n < self.width:
            return np.empty(0, np.uint64)
        if n > len(self.forward):
            self.forward, self.back = _powers(self.base, 2 * n), _powers(self.inverse, 2 * n)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * self.back[:n], dtype=np.uint64)))
        found = (sums[self.width :] - sums[: n - self.width + 1]) * self.forward[: n - self.width + 1]
        found ^= found >> np.uint64(32)  # low bits depend on few words' low bits; mix before the range is taken
        found *= np.uint64(0xD6E8FEB86659FD93)
        return found ^ (found >> np.uint64(32))


def encode_places(table: np.ndarray, size: np.ndarray, place: np.ndarray) -> bytes:
    """Pack (doc_id, row number) rows, how many places each has, and these places (ascending within a row): about a byte a place."""
    starts = np.cumsum(size) - size
    steps = np.diff(place, prepend=0)
    inner = np.ones(len(place), bool)
    inner[starts] = False
    steps = steps[inner]
    wide = steps[steps > 254]
    head = np.array([len(size), len(place), len(wide)], np.int32)
    return b"".join(x.tobytes() for x in (head, table.astype(np.int64), size.astype(np.int32), place[starts].astype(np.int32), np.minimum(steps, 255).astype(np.uint8), wide.astype(np.int32)))


def decode_places(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(table, size, place, bytes read) of encode_places."""
    documents, places, wides = np.frombuffer(blob, np.int32, 3).tolist()
    at = 12
    table = np.frombuffer(blob, np.int64, 2 * documents, at).reshape(-1, 2)
    at += 16 * documents
    size = np.frombuffer(blob, np.int32, documents, at)
    first = np.frombuffer(blob, np.int32, documents, at + 4 * documents)
    at += 8 * documents
    small = np.frombuffer(blob, np.uint8, places - documents, at)
    at += places - documents
    steps = small.astype(np.int32)
    steps[small == 255] = np.frombuffer(blob, np.int32, wides, at)
    place = np.zeros(places, np.int32)
    starts = np.cumsum(size) - size
    inner = np.ones(places, bool)
    inner[starts] = False
    place[inner] = steps
    total = np.cumsum(place)
    return table, size, total - np.repeat(total[starts], size) + np.repeat(first, size), at + 4 * wides


def _task_of(number: np.ndarray, targets: int) -> np.ndarray:
    """The task that gathers a row's replies: by the row's number alone, so copies of a text are spread."""
    mixed = number.astype(np.uint64) * np.uint64(BASES[0])
    return ((mixed >> np.uint64(32)) * np.uint64(targets) >> np.uint64(32)).astype(np.int64)


def _replies(table: np.ndarray, document: np.ndarray, place: np.ndarray, targets: int) -> Iterator[tuple[int, bytes]]:
    """Covered starts (ascending by document and place), packed for the tasks that gather them: (-1 - task, message)."""
    task = _task_of(table[:, 1], targets)
    order = np.argsort(task[document], kind="stable")
    document, place = document[order], place[order]
    of = task[document]
    cuts = np.flatnonzero(np.diff(of, prepend=-1, append=targets))
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = document[a:b]
        fresh = np.flatnonzero(np.diff(part, prepend=-1))
        yield -1 - int(of[a]), encode_places(table[part[fresh]], np.diff(np.append(fresh, b - a)), place[a:b])


MESSAGE = "bucket int, payload binary"


def _messages(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "payload"])


def _range_of(first: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a hash: its leading bits."""
    return ((first >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)


def _by_range(table: np.ndarray, document: np.ndarray, place: np.ndarray, first: np.ndarray, second: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes]]:
    """Windows (ascending by document and place) packed by range: documents and places, then the hashes."""
    bucket = _range_of(first, ranges)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=ranges))
    for a, b in zip(cuts, cuts[1:], strict=False):
        some = order[a:b]
        part = document[some]
        fresh = np.flatnonzero(np.diff(part, prepend=-1))
        raw = np.empty((b - a, HASH_BYTES), np.uint8)
        raw[:, :8] = first[some].view(np.uint8).reshape(-1, 8)
        raw[:, 8:] = second[some].view(np.uint8).reshape(-1, 4)[:, : HASH_BYTES - 8]
        yield int(bucket[some[0]]), encode_places(table[part[fresh]], np.diff(np.append(fresh, b - a)), place[some]) + raw.tobytes()


def _unpacked(blobs: list[pa.Buffer]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(table, document, place, first, second) of messages; takes them out of the list, so that they are not held beside what they become."""
    documents, places = np.array([np.frombuffer(blob, np.int32, 2) for blob in blobs], np.int64).sum(axis=0).tolist()
    tables, document, place = np.empty((documents, 2), np.int64), np.empty(places, np.int32), np.empty(places, np.int32)
    first, second = np.empty(places, np.uint64), np.zeros(places, np.uint32)
    blobs.reverse()
    row = at = 0
    while blobs:
        blob = blobs.pop()
        table, size, found, read = decode_places(blob)
        end = at + len(found)
        tables[row : row + len(table)] = table
        document[at:end] = np.repeat(np.arange(row, row + len(table), dtype=np.int32), size)
        place[at:end] = found
        packed = np.frombuffer(blob, np.uint8, offset=read).reshape(-1, HASH_BYTES)
        first[at:end].view(np.uint8).reshape(-1, 8)[:] = packed[:, :8]
        second[at:end].view(np.uint8).reshape(-1, 4)[:, : HASH_BYTES - 8] = packed[:, 8:]
        row, at = row + len(table), end
    return tables, document, place, first, second


def _ordered(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts) of groups of equal hashes, as given within a group; the second part is only sorted by where first parts meet by chance."""
    order = np.argsort(first, kind="stable")
    ranked = first[order]
    same = ranked[1:] == ranked[:-1]
    pairs = np.flatnonzero(same)
    if (second[order[pairs]] != second[order[pairs + 1]]).any():
        order = np.lexsort((second, first))
        ranked, other = first[order], second[order]
        same = (ranked[1:] == ranked[:-1]) & (other[1:] == other[:-1])
    return order, np.concatenate(([True], ~same))


def _block_messages(ids: list[int], numbers: list[int], hashes: list[tuple[np.ndarray, np.ndarray]], targets: int, ranges: int) -> pa.RecordBatch:
    """Covered starts known inside the block (bucket < 0), and the packed distinct windows by range; empties the list of hashes."""
    table = np.array([ids, numbers], np.int64).T
    by_id = np.argsort(table[:, 0], kind="stable")
    table = table[by_id]
    count = np.array([len(hashes[k][0]) for k in by_id])
    first, second = (np.concatenate([hashes[k][half] for k in by_id]) for half in (0, 1))
    hashes.clear()
    document = np.repeat(np.arange(len(ids), dtype=np.int32), count)
    place = np.arange(len(first), dtype=np.int32) - np.repeat((np.cumsum(count) - count).astype(np.int32), count)
    order, starts = _ordered(first, second)
    owner = table[document[order], 0]  # ascending in a group
    heads = np.flatnonzero(starts)
    covered = np.empty(len(order), bool)
    covered[order] = owner > np.repeat(owner[heads], np.diff(np.append(heads, len(owner))))
    del order, starts, owner, heads
    rows = [*_replies(table, document[covered], place[covered], targets)] if covered.any() else []
    if rows:
        first, second, document, place = (x[~covered] for x in (first, second, document, place))
    return _messages(rows + [*_by_range(table, document, place, first, second, ranges)])


def _hash_windows(width: int, targets: int, ranges: int, word_hashes: Callable = WordHashes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, rolling, size = word_hashes(), [RollingHash(width, base) for base in BASES], 0
        ids, numbers, hashes = [], [], []
        for batch in batches:
            for doc_id, number, text in zip(batch["doc_id"].to_pylist(), batch["__no"].to_pylist(), bytes_of(batch["text"]), strict=True):
                words = text.split()
                if doc_id is None or len(words) < width:
                    continue
                first, second = (r.windows(half) for r, half in zip(rolling, values.halves(words), strict=True))
                ids.append(doc_id)
                numbers.append(number)
                hashes.append((first, (second & SECOND_BITS).astype(np.uint32)))
                size += len(words)
                if size >= BLOCK_WORDS:
                    yield _block_messages(ids, numbers, hashes, targets, ranges)
                    ids, numbers, hashes, size = [], [], [], 0
        if ids:
            yield _block_messages(ids, numbers, hashes, targets, ranges)

    return run


def _deal_again(ranges: int) -> Callable:
    """The second hop: what a group of ranges got, some blocks at a time, by its ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Buffer] = []
        size = 0

        def dealt() -> pa.RecordBatch:
            return _messages([*_by_range(*_unpacked(held), ranges)])

        for batch in batches:
            bucket = batch["bucket"].to_numpy()
            known = pa.array(bucket < 0)
            if known.true_count:
                yield batch.filter(known)
            for k, blob in zip(bucket.tolist(), batch["payload"], strict=True):
                if k >= 0:
                    held.append(blob.as_buffer())
                    size += held[-1].size
                    if size >= BLOCK_WORDS * HASH_BYTES:
                        yield dealt()
                        size = 0
        if held:
            yield dealt()

    return run


def _find_repeats(targets: int) -> Callable:
    """Count the windows of each hash range over all blocks; give back covered starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Buffer]] = defaultdict(list)  # one range, as they are dealt
        for batch in batches:
            bucket = batch["bucket"].to_numpy()
            known = pa.array(bucket < 0)
            if known.true_count:
                yield batch.filter(known)
            for k, blob in zip(bucket.tolist(), batch["payload"], strict=True):
                if k >= 0:
                    held[k].append(blob.as_buffer())
        batch = bucket = known = blob = None  # each would keep a batch beside what is made of it
        for k in list(held):
            rows = [*_repeats_of(held.pop(k), targets)]
            if rows:
                yield _messages(rows)

    return run


def _repeats_of(blobs: list[pa.Buffer], targets: int) -> Iterator[tuple[int, bytes]]:
    tables, document, place, first, second = _unpacked(blobs)
    order, fresh = _ordered(first, second)
    shared = ~fresh  # only hashes that more than one entry has go on
    shared[:-1] |= ~fresh[1:]
    order, fresh = order[shared], fresh[shared]
    if not len(order):
        return
    owner = tables[document[order], 0]
    starts = np.flatnonzero(fresh)
    least = np.repeat(np.minimum.reduceat(owner, starts), np.diff(np.append(starts, len(owner))))
    covered = np.sort(order[owner > least])
    if len(covered):
        yield from _replies(tables, document[covered], place[covered], targets)


def _assemble(width: int) -> Callable:
    """Gather the replies of each row: (doc_id, __no, spans), spans the maximal removal intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, places = [], []
        for batch in batches:
            for blob in batch["payload"].to_pylist():
                table, size, place, _ = decode_places(blob)
                tables.append(np.repeat(table, size, axis=0))
                places.append(place)
        if not tables:
            return
        table, place = np.concatenate(tables), np.concatenate(places)
        tables.clear()
        order = np.lexsort((place, table[:, 1], table[:, 0]))
        table, place = table[order], place[order].astype(np.int64)
        fresh = np.concatenate(([True], (table[1:] != table[:-1]).any(axis=1)))
        gap = np.concatenate(([True], place[1:] > place[:-1] + width)) | fresh  # beyond the end of what is covered so far
        first = np.flatnonzero(gap)
        spans = np.stack((place[first], place[np.append(first[1:], len(place)) - 1] + width), axis=1).astype(np.int32)
        of = np.cumsum(fresh)[first] - 1
        heads = np.flatnonzero(fresh)
        cuts = np.searchsorted(of, np.arange(len(heads) + 1))
        for at in range(0, len(heads), 10_000):
            some = range(at, min(at + 10_000, len(heads)))
            rows = table[heads[some.start : some.stop]]
            yield pa.record_batch([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array([spans[cuts[d] : cuts[d + 1]].tobytes() for d in some], pa.binary())], ["doc_id", "__no", "spans"])

    return run


def _cut(with_text: bool, path: str) -> Callable:
    """(doc_id, text, __no) to the digest columns; a document without spans stays whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            found, table = with_notes(batch["__no"].to_numpy(), path, held)
            out = defaultdict(list)
            for text, k in zip(bytes_of(batch["text"]), found.tolist(), strict=True):
                words = text.split()
                n = len(words)
                kept = words
                if k >= 0:
                    change = np.zeros(n + 1, np.int32)
                    for first, end in np.frombuffer(table["spans"][k].as_py(), np.int32).reshape(-1, 2).tolist():
                        change[first] += 1
                        change[end] -= 1
                    stays = np.cumsum(change[:n]) == 0
                    kept = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                out["n_words"].append(n)
                out["n_removed"].append(n - len(kept))
                text = b" ".join(kept)
                out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
                if with_text:
                    out["kept_text"].append(text.decode("utf-8", "replace"))
            types = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()} | ({"kept_text": pa.string()} if with_text else {})
            yield pa.record_batch([batch["doc_id"], *(pa.array(out[c], t) for c, t in types.items())], ["doc_id", *types])
        finish_notes(held)

    return run


def removal_intervals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, task_windows: int = TASK_WINDOWS, fan: int = FAN, word_hashes: Callable = WordHashes) -> DataFrame:
    """(doc_id, __no, spans) of the rows with repeated windows; __no is the row's number."""
    spark = session(docs)
    base = identified(docs, id_col, text_col)
    letters = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(shuffle_partitions(spark), -(-letters // 6 // task_windows))  # a word has about six bytes; more or fewer only change the size of tasks
    groups = min(ranges, fan)
    sent = numbered(base).mapInArrow(_hash_windows(width, ranges, groups, word_hashes), MESSAGE).repartitionById(groups, "bucket")
    if groups < ranges:
        sent = sent.mapInArrow(_deal_again(ranges), MESSAGE).repartitionById(ranges, "bucket")
    replies = sent.mapInArrow(_find_repeats(ranges), MESSAGE).repartitionById(ranges, "bucket")
    return replies.mapInArrow(_assemble(width), "doc_id long, __no long, spans binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text."""
    session(docs)
    docs = stable(docs)
    path = write_notes(removal_intervals(docs, id_col, text_col, width), "__no", "spans")
    return numbered(identified(docs, id_col, text_col)).mapInArrow(_cut(with_text, path), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
