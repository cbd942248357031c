from __future__ import annotations

import random
import zlib
from itertools import combinations

import numpy as np

from quillstack.llm import toxicity
from quillstack.llm.toxicity import DECAY, ORDER, SPAN, kernel, score_documents, words_in

from .helpers import awkward, frame

SYLLABLES = "ba ce di fo gu ha le mi no pu ra se ti vo".split()
STEMS = ["blorgh", "snarvik", "quotzel", "wrumpf"]


def document(seed: int, toxic: bool, twist=lambda w: w) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    if toxic:
        for _ in range(3):
            words.insert(rng.randint(0, 50), twist(rng.choice(STEMS) + rng.choice(("", "a", "en", "ix"))))
    return " ".join(words) + "."


def plain_kernel(a: str, b: str) -> float:
    def vector(word):
        codes, out = [1, *map(toxicity.code, word)], {}
        for places in combinations(range(len(codes)), ORDER):
            if places[-1] - places[0] < SPAN:
                key = tuple(codes[p] for p in places)
                out[key] = out.get(key, 0) + DECAY ** (places[-1] - places[0] + 1 - ORDER)
        return out

    x, y = vector(a), vector(b)
    norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return sum(v * y.get(k, 0) for k, v in x.items()) / norm if norm else 0.0


def test_kernel():
    words = ["idiot", "idiots", "i.d.i.o.t", "loser", "banana", "abc", "ab"]
    got = kernel(words, words[:5])
    for i, a in enumerate(words):
        for j, b in enumerate(words[:5]):
            assert abs(got[i, j] - plain_kernel(a, b)) < 0.02, (a, b)


def test_spaced_letters_are_joined():
    assert "idiot" in words_in("you I d i o t!") and words_in("a b c") == ["a", "b", "c"]


def test_held_out_accuracy_and_contract(spark):
    rows = [(k, document(k, k % 4 == 0)) for k in range(600)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(600)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in score_documents(frame(spark, rows), labels).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k].held_out == (k in set(held)) for k in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert np.mean([got[k].predicted == int(k % 4 == 0) for k in held]) > 0.97


VARIANTS = {
    "mark": lambda w: w[:2] + "*" + w[2:],
    "dots": lambda w: ".".join(w),
    "hyphen": lambda w: w[:3] + "-" + w[3:],
    "spaced": lambda w: " ".join(w),
    "doubled": lambda w: w[:2] + w[2] * 2 + w[3:],
    "one letter": lambda w: w[:3] + "x" + w[3:],
    "two letters": lambda w: w[:3] + "xx" + w[3:],
    "two other letters": lambda w: w[:2] + "ow" + w[2:],
}


def test_gapped_and_inserted_characters_are_tolerated(spark):
    rows = [(k, document(k, k % 4 == 0)) for k in range(600)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(600)], "doc_id long, quality int, toxic int")
    rows += [(1000 * (1 + v) + k, document(5000 + 100 * v + k, True, twist)) for v, twist in enumerate(VARIANTS.values()) for k in range(40)]
    rows += [(90_000 + k, document(9000 + k, False)) for k in range(200)]
    got = {r.doc_id: r.predicted for r in score_documents(frame(spark, rows), labels).collect()}
    caught = {name: sum(got[1000 * (1 + v) + k] for k in range(40)) for v, name in enumerate(VARIANTS)}
    assert min(caught.values()) >= 36, caught
    assert sum(got[90_000 + k] for k in range(200)) <= 4


def test_conflicting_labels_and_repeated_rows(spark):
    rows = [(k, document(k, k % 4 == 0)) for k in range(300)]
    true = [(k, 1, int(k % 4 == 0)) for k in range(300)]
    schema = "doc_id long, quality int, toxic int"
    docs = frame(spark, rows + rows[:50] + [(rows[0][0], None)])
    a, b = (sorted((r.doc_id, r.score) for r in score_documents(docs, spark.createDataFrame(x, schema)).collect()) for x in (true, [(k, 1, 0) for k in range(0, 300, 4)] + true[::-1]))
    assert a == b and len(a) == 351


def test_landmarks_come_from_all_words():
    words = [f"{'abcdefghij'[k % 10] * 3}{k}" for k in range(3000)] + ["zqzqzqzq"]
    assert "zqzqzqzq" in toxicity.farthest_first(words, 64)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows = [(k, document(k, k % 4 == 0)) for k in range(300)]
    true = [(k, 1, int(k % 4 == 0)) for k in range(300)]
    false = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 3 == 1 else t) for k, q, t in true]
    schema = "doc_id long, quality int, toxic int"
    a, b = (sorted((r.doc_id, r.score) for r in score_documents(frame(spark, rows), spark.createDataFrame(x, schema)).collect()) for x in (true, false))
    assert a == b


def test_awkward_and_unlabelled(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = score_documents(frame(spark, awkward()), none).collect()
    assert len(got) == len(awkward()) and all(r.score < 0.01 and r.predicted == 0 for r in got)
    assert score_documents(frame(spark, []), none).count() == 0


def test_split_words_and_phrases_of_ordinary_words():
    phrase = document(1, False).split()[5:9]

    def with_phrase(seed: int, together: bool) -> str:
        words = document(seed, False).split()
        for at, w in [(20, " ".join(phrase))] if together else zip((5, 20, 35, 50), phrase, strict=True):
            words.insert(at, w)
        return " ".join(words)

    samples = [(document(k, k % 4 == 0), int(k % 4 == 0)) for k in range(300)]
    samples += [(with_phrase(1000 + k, k % 2 == 0), int(k % 2 == 0)) for k in range(100)]
    machine = toxicity.train(samples)

    def flagged(texts: list[str]) -> int:
        n = 0
        for text, more in zip(texts, machine.window_hits(texts), strict=True):
            words = words_in(text)
            machine.learn(set(words))
            n += machine.score(*machine.describe(words, more)) >= toxicity.CUT
        return n

    assert flagged([document(7000 + k, True, lambda w: w[:3] + " " + w[3:]) for k in range(40)]) >= 36
    assert flagged([with_phrase(8000 + k, True) for k in range(40)]) >= 36
    assert flagged([with_phrase(8000 + k, False) for k in range(40)]) <= 2
    assert flagged([document(9000 + k, False) for k in range(40)]) <= 2


def test_margins_of_windows_are_the_kernel_machine():
    rng = np.random.default_rng(3)
    table = rng.normal(size=toxicity.SLOTS)
    stream = toxicity.Stream(["You idi-ot go. A b\u00e9 cd!", "", "v1.2 next \U0001f600 x"])
    got = stream.margins(table, 0.5)
    strings = [stream.string(k) for k in range(len(got))]
    assert {"youidiot", "idiotgo", "youidiotgo", "ab\u00e9cd", "2next", "nextx", "v12nextx"} <= set(strings) and "goab\u00e9" not in strings
    for text, margin in zip(strings, got, strict=True):
        keys, weights, norms = toxicity.features([text], len(text) + 1, toxicity.NARROW)
        assert abs(margin - 0.5 - (table[keys[0]] * weights).sum() / norms[0]) < 1e-6
