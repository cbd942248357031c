from __future__ import annotations

import math
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from quillstack.llm.quality_rules import BUCKETS, PRIOR, THRESHOLD, judge, keep_good, words_of

from .helpers import WORDS, awkward, frame, prose


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def long_hash(value, seed):
    return xxhash.xxh64_intdigest((value % (1 << 64)).to_bytes(8, "little"), seed)


def grams(text):
    """Buckets of words and neighbouring words: the same chained hashes as the DataFrame function."""
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORDS.findall(text)]
    pairs = [long_hash(b, long_hash(a, 42)) for a, b in zip(hashes, hashes[1:], strict=False)]
    return [signed(h) % BUCKETS for h in hashes + pairs]


def base(text):
    words = WORDS.findall(text)
    seen = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {j for k in range(len(words) - 4) if seen[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def corpus():
    rows = awkward() + [(1000 + k, prose(1000 + k, 60)) for k in range(60)]
    junk = [(1200 + k, " ".join(w + "###" for w in prose(1200 + k, 60).split())) for k in range(6)]
    loops = [(1300, "round and round it goes " * 10), (1301, "a\na\nb | c <d> & #"), (1302, "x y z v w " * 2 + " ".join(f"u{k}" for k in range(90)))]
    labels = [(1000 + k, 1, 0) for k in range(40)] + [(1200, 0, 0), (None, 1, 0), (1001, 1, 0)]
    return rows + junk + loops, labels, {i for i, _ in junk}


def labels_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_matches_brute_force(spark, corpus):
    rows, labels, junk = corpus
    got = judge(frame(spark, rows, 4), labels_frame(spark, labels)).collect()
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    raw, target = Counter(), Counter()
    for i, t in rows:
        g = grams(t or "")
        raw.update(g)
        if i in good:
            target.update(g)
    n_raw, n_target = sum(raw.values()), sum(target.values())
    weight = {b: math.log((target[b] + PRIOR) / (raw[b] * n_target / n_raw + PRIOR)) for b in raw}
    want = []
    for i, t in rows:
        five = base(t or "")
        failed = five[0] < 10 or 100 * five[4] > 20 * five[0]
        llr = sum(weight[b] for b in grams(t or "")) / (2 * five[0] - 1) if five[0] else 0.0
        want.append((str(i), *five, failed, not failed and llr >= THRESHOLD, round(llr, 9)))
    assert sorted((str(r[0]), *r[1:8], round(r.llr, 9)) for r in got) == sorted(want)
    kept = {r.doc_id for r in got if r.kept}
    assert {1000 + k for k in range(60)} <= kept
    score = {r.doc_id: r.llr for r in got}  # in so small a corpus the prior is strong; the target's own documents stand above all junk
    assert max(score[i] for i in junk) < min(score[1000 + k] for k in range(40))


def test_plan_has_no_python(spark, corpus):
    rows, labels, _ = corpus
    plan = judge(frame(spark, rows), labels_frame(spark, labels))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_keep_good_and_empty(spark, corpus):
    rows, labels, _ = corpus
    docs = frame(spark, rows)
    out = keep_good(docs, labels_frame(spark, labels))
    assert out.schema == docs.schema and 0 < out.count() < len(rows)
    assert judge(frame(spark, []), labels_frame(spark, labels)).count() == 0
    assert judge(docs, labels_frame(spark, [])).where("llr <> 0").count() == 0


def test_words(spark):
    cases = ["", " \t", "a", " a\x0bb\x0c c\r\n", "a\xa0b  c", "x" * 1000]
    got = [r[0] for r in spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, t string").orderBy("k").select(words_of(F.col("t"))).collect()]
    assert got == [WORDS.findall(c) for c in cases]
