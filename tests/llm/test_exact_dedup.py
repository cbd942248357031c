from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np

from quillstack.llm.exact_dedup import exact_dedup, keep_one, merge_runs

from .helpers import awkward, frame


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_matches_brute_force(spark):
    rows = awkward() + [(100 + k, "copy") for k in range(300)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    got = exact_dedup(frame(spark, rows, 5)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for t in groups if sha(t) == r.text_sha256)
        known = [i for i in groups[text] if i is not None]
        assert r.keep_id == (max(known) if known else None)
        assert r.group_size == len(groups[text])
        if r.doc_id != r.keep_id:
            assert not r.kept
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_smallest_and_empty(spark):
    rows = [(3, "a"), (1, "a"), (2, "b")]
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup(frame(spark, rows), largest=False).collect()}
    assert got == {3: (1, False), 1: (1, True), 2: (2, True)}
    assert exact_dedup(frame(spark, [])).count() == 0
    assert keep_one(frame(spark, [])).count() == 0


def test_keep_one_carries_columns(spark):
    docs = frame(spark, awkward())
    out = keep_one(docs)
    assert out.schema == docs.schema
    texts = [r.text or "" for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t in awkward()})


def test_merge_settles_ties_of_the_first_word():
    a = np.array([[1, 2, 0, 0, 5, 1, 1], [1, 3, 0, 0, 9, 1, 1]], np.uint64)
    b = np.array([[1, 2, 0, 0, 7, 2, 1], [4, 0, 0, 0, 1, 1, 1]], np.uint64)
    assert merge_runs([a, b]).tolist() == [[1, 2, 0, 0, 7, 3, 1], [1, 3, 0, 0, 9, 1, 1], [4, 0, 0, 0, 1, 1, 1]]
