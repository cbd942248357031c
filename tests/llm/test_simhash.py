from __future__ import annotations

import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack.llm.components import connected_components
from quillstack.llm.simhash import bucket_links, deletion_keys, fingerprint, keep_representatives, near_duplicates, near_groups, split_hot

from .helpers import WORDS, awkward, frame

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text: str) -> int:
    words = WORDS.findall(text.translate(LOW))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(prints: dict) -> dict:
    """Least node reachable over links of at most four bits."""
    root = {p: p for p in prints}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    every = list(prints)
    for k, a in enumerate(every):
        for b in every[k + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAB é\t\n\x0b ", max_size=60))
def test_fingerprint(text):
    assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_long_fingerprint():
    text = " ".join(f"w{k % 97}x{k % 31}" for k in range(3000))
    assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_matches_brute_force(spark):
    rows = awkward() + [(200 + k, f"near copy {'word ' * 40} number {k // 3}") for k in range(30)]
    least = {}
    for i, t in rows:
        p = plain_fingerprint(t or "")
        least[p] = min([x for x in (least.get(p), i) if x is not None], default=None)
    root = components(least)
    of = {}
    for p, i in least.items():
        of[root[p]] = min([x for x in (of.get(root[p]), i) if x is not None], default=None)
    got = near_duplicates(frame(spark, rows)).collect()
    want = sorted((i is None, i or 0, f"{(p := plain_fingerprint(t or '')):016x}", str(of[root[p]])) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, str(r.component_id)) for r in got) == want


def test_groups_over_random_fingerprints(spark):
    rng = random.Random(3)
    prints = []
    for _ in range(60):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            prints.append(p)
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                p ^= 1 << bit
    rows = [(k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)]
    root = components(dict.fromkeys(prints))
    least = {}
    for k, p in enumerate(prints):
        least.setdefault(root[p], k)
    got = {r.fp % (1 << 64): r.component_id for r in near_groups(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    assert got == {p: least[root[p]] for p in set(prints)}


def test_hot_keys_are_split_and_lose_no_pair(spark):
    """Thousands of fingerprints with one segment in common, some of them close: the components are those of all pairs."""
    rng = random.Random(8)
    prints = {rng.getrandbits(64) for _ in range(20)}
    for low, size in ((0, 22), (22, 21), (43, 21)):
        segment = rng.getrandbits(size) << low
        for _ in range(1000):
            p = rng.getrandbits(64) & ~(((1 << size) - 1) << low) | segment
            prints.add(p)
            for _ in range(rng.choice((0, 0, 2))):
                for bit in rng.sample(range(64), rng.randint(1, 4)):
                    p ^= 1 << bit
                prints.add(p)
    rows = [(k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(sorted(prints))]
    array = np.array(sorted(prints), np.uint64)
    u, v = bucket_links(np.zeros(len(array), np.int32), array, 4)
    root = dict(zip(u.tolist(), v.tolist(), strict=True))
    least = {}
    for k, p in enumerate(sorted(prints)):
        least.setdefault(root.get(p, p), k)
    frame_ = spark.createDataFrame(rows, "doc_id long, fp long")
    variants = frame_.select(F.explode(deletion_keys()).alias("key"), "fp")
    split = split_hot(variants, frame_, len(rows), hot_key=200)
    assert variants.groupBy("key").count().agg(F.max("count")).first()[0] > 20 * split.groupBy("key").count().agg(F.max("count")).first()[0]
    got = {r.fp % (1 << 64): r.component_id for r in near_groups(frame_, hot_key=200).collect()}
    assert got == {p: least[root.get(p, p)] for p in prints}


def test_components_of_a_hub_and_a_chain(spark):
    edges = [(1, k) for k in range(2, 400)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2001), (2001, 2000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == dict.fromkeys(range(2, 400), 1) | dict.fromkeys(range(1001, 1061), 1000) | {2001: 2000}


def test_every_close_pair_shares_a_key(spark):
    rng = random.Random(4)
    rows = []
    for k in range(300):
        a = b = rng.getrandbits(64)
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        rows += [(k, x - (1 << 64) if x >> 63 else x) for x in (a, b)]
    keys = spark.createDataFrame(rows, "pair long, fp long").select("pair", F.explode(deletion_keys()).alias("key"))
    shared = keys.groupBy("pair", "key").count().where("count > 1").select("pair").distinct().count()
    assert shared == 300


def test_large_bucket_is_linked_whole():
    base = np.uint64(0x0123456789ABCDEF)
    prints = np.unique(base ^ (np.uint64(1) << np.arange(60, dtype=np.uint64)))
    prints = np.unique(np.concatenate([prints, prints ^ np.uint64(1 << 62)]))
    u, v = bucket_links(np.zeros(len(prints), np.int32), prints, 4)
    assert len(set(v.tolist())) == 1 and len(u) == len(prints) - 1


def test_representatives_and_empty(spark):
    docs = frame(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, "quite other words in this text")])
    out = keep_representatives(docs)
    assert out.schema == docs.schema
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3"]
    repeated = frame(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (2, "quite other words in this text"), (None, "x y z"), (None, "x y z")])
    assert sorted(str(r.doc_id) for r in keep_representatives(repeated).collect()) == ["1", "2", "None"]  # one row of each of the three groups
    assert near_duplicates(frame(spark, [])).count() == 0
