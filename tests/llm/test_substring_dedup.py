from __future__ import annotations

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack.llm import substring_dedup
from quillstack.llm.common import stable, without_rows
from quillstack.llm.substring_dedup import RollingHash, WordHashes, _task_of, decode_places, encode_places, removal_intervals, remove_repeats

from .helpers import WORDS, awkward, frame


def brute(rows, width):
    words = [WORDS.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if i is not None and i < first.get(key, i + 1):
                first[key] = i
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        yield (str(i), len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())


def test_matches_brute_force(spark):
    rows = awkward() + [(300 + k, "shared " * 55 + f"tail {k}") for k in range(40)]
    for width, blocks in ((50, 1 << 20), (5, 300)):
        keep, substring_dedup.BLOCK_WORDS = substring_dedup.BLOCK_WORDS, blocks
        got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(frame(spark, rows, 4), width=width).collect()]
        substring_dedup.BLOCK_WORDS = keep
        assert sorted(got) == sorted(brute(rows, width))


class FirstHalfCollides(WordHashes):
    """All words have one value in the first half: all windows have one first hash."""

    def __missing__(self, word):
        value = self[word] = (7, super().__missing__(word)[1])
        return value


def intervals(spark, rows, **options):
    found = removal_intervals(frame(spark, rows, 4), width=5, **options).collect()
    return sorted((r.doc_id, np.frombuffer(r.spans, np.int32).tolist()) for r in found)


def test_forced_collisions_and_two_hops_change_nothing(spark):
    rows = awkward() + [(300 + k, "shared " * 12 + f"tail {k}") for k in range(40)]
    plain = intervals(spark, rows)
    assert plain
    assert intervals(spark, rows, word_hashes=FirstHalfCollides) == plain
    assert intervals(spark, rows, task_windows=100, fan=4) == plain  # a few hundred ranges in two hops


def test_a_task_counts_one_range(spark, monkeypatch):
    real = substring_dedup._find_repeats

    def watched(targets):
        def run(batches):
            seen = set()

            def noted():
                for batch in batches:
                    seen.update(k for k in batch["bucket"].to_pylist() if k >= 0)
                    yield batch

            yield from real(targets)(noted())
            if len(seen) > 1:  # each holds two million windows
                raise RuntimeError(f"{len(seen)} ranges in one task")

        return run

    plain = intervals(spark, awkward())
    monkeypatch.setattr(substring_dedup, "_find_repeats", watched)
    assert intervals(spark, awkward(), task_windows=200) == plain
    assert intervals(spark, awkward(), task_windows=200, fan=4) == plain


def test_hashing_a_block_of_new_words_stays_small():
    def batches():
        for at in range(0, 1 << 20, 1 << 16):
            words = [f"w{k}" for k in range(at, at + (1 << 16))]
            texts = [" ".join(words[k : k + 512]) for k in range(0, len(words), 512)]
            ids = pa.array(range(at, at + len(texts)), pa.int64())
            yield pa.record_batch([ids, ids, pa.array(texts)], ["doc_id", "__no", "text"])

    tracemalloc.start()
    sent = sum(batch.num_rows for batch in substring_dedup._hash_windows(50, 16, 16)(batches()))
    peak = tracemalloc.get_traced_memory()[1] >> 20
    tracemalloc.stop()
    assert sent == 16
    assert peak < 120, f"{peak} MB"


def test_replies_of_copies_are_spread():
    numbers = np.concatenate([(np.int64(part) << 33) + np.arange(100) for part in range(100)])  # 10,000 rows of one text, a hundred a task
    load = np.bincount(_task_of(numbers, 64), minlength=64)
    assert load.min() > 100 and load.max() < 220


def test_a_changed_table_is_an_error(spark, tmp_path):
    base = stable(frame(spark, [(k, "a b c d e f") for k in range(20)], 2))
    assert base is not None and stable(base) is base and stable(base.select("doc_id").where("doc_id > 1")).inputFiles() == base.inputFiles()
    rows = base.select("doc_id", "text").withColumn("__no", F.monotonically_increasing_id())
    missing = rows.select("doc_id", (F.col("__no") + 5).alias("__no"))
    with pytest.raises(Exception, match="met no row"):
        without_rows(base, missing, "drops").count()
    assert sorted(r.doc_id for r in without_rows(base, rows.where("doc_id % 3 = 0"), "drops").collect()) == [k for k in range(20) if k % 3]


def test_text_and_empty(spark):
    rows = [(1, "a b c d"), (2, "x a b c y")]
    got = {r.doc_id: r.kept_text for r in remove_repeats(frame(spark, rows), width=3).collect()}
    assert got == {1: "a b c d", 2: "x y"}
    assert remove_repeats(frame(spark, [])).count() == 0


def test_windows_equal_if_and_only_if_words_are():
    values = np.array([1, 2, 3, 1, 2, 3, 1, 2, 9, 3, 2, 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashes = RollingHash(3).windows(values)
    for a in range(len(hashes)):
        for b in range(len(hashes)):
            assert (hashes[a] == hashes[b]) == (values[a : a + 3] == values[b : b + 3]).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 100_000), min_size=1, max_size=30, unique=True).map(sorted), min_size=1, max_size=6))
def test_places_round_trip(rows):
    table = np.array([[k, -k] for k in range(len(rows))], np.int64)
    size = np.array([*map(len, rows)])
    place = np.concatenate([np.array(r) for r in rows])
    blob = encode_places(table, size, place)
    t, s, p, end = decode_places(blob)
    assert (t == table).all() and (s == size).all() and (p == place).all() and end == len(blob)
