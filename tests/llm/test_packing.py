from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillstack.llm.bpe import PieceCache
from quillstack.llm.packing import best_fit, cut_points, knapsack, pack, pack_histogram

from .helpers import awkward, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_matches_brute_force(spark):
    rows = awkward() + [(400 + k, "short text " * (k + 1)) for k in range(50)]
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        for k, (start, length) in enumerate(cut_points(len(ids))):
            want.append((str(i), k, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
    got = pack(frame(spark, rows), PATH).collect()
    assert sorted((str(r.doc_id), *r[1:5]) for r in got) == sorted(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(r.length for r in got) // 1024) + 3
    assert pack(frame(spark, []), PATH).count() == 0


@pytest.mark.parametrize(("n", "cuts"), [(1, [(0, 1)]), (1024, [(0, 1024)]), (1025, [(0, 1), (1, 1024)]), (2048, [(0, 1024), (1024, 1024)])])
def test_cut_points(n, cuts):
    assert cut_points(n) == cuts


def histogram(lengths, counts) -> np.ndarray:
    out = np.zeros(1025, np.int64)
    out[lengths] = counts
    return out


def held(counts: np.ndarray) -> tuple[int, float, int]:
    """(sequences of the plan, bound, sequences of best-fit), the plan checked."""
    plan, bound = pack_histogram(counts)
    assert (sum((uses * times for uses, times in plan), np.zeros(1025, np.int64)) == counts).all()
    assert all(uses @ np.arange(1025) <= 1024 and times > 0 for uses, times in plan)
    n, size = sum(times for _, times in plan), float(counts @ np.arange(1025)) / 1024
    assert n >= bound * (1 - 1e-9) and bound >= size * (1 - 1e-9)
    return n, bound, sum(times for _, times in best_fit(counts))


@pytest.mark.parametrize("seed", range(6))
def test_plan_serves_every_piece_and_is_never_worse_than_best_fit(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(1025, np.int64)
    if seed % 2:
        counts[1:1024] = rng.integers(0, 40, 1023)
    else:
        counts[rng.integers(1, 1025, 200)] = rng.integers(1, 500, 200)
    n, bound, fit = held(counts)
    assert n <= fit and n <= 1.002 * bound


@pytest.mark.parametrize(("lengths", "counts"), [([342, 343, 500, 200], [5000, 3000, 4000, 2000]), ([700, 350, 330, 300, 250, 600], [2000, 3000, 1500, 4000, 1200, 2500])])
def test_plan_is_near_the_dual_bound_where_nothing_fills_a_sequence(lengths, counts):
    n, bound, fit = held(histogram(lengths, counts))
    assert n <= fit and n <= 1.001 * bound


@pytest.mark.parametrize("seed", range(100, 104))
def test_program_beats_best_fit(seed):
    rng = np.random.default_rng(seed)
    n, _, fit = held(histogram(rng.integers(100, 600, 12), rng.integers(100, 5000, 12)))
    assert n < 0.99 * fit


def test_bound_of_a_small_program():
    n, bound, _ = held(histogram([600, 500], [1, 3]))  # 600 and 500 do not meet; 500 twice
    assert n == 3 and 2 < bound <= 3


def test_knapsack_is_optimal():
    prices = np.zeros(31)
    prices[[3, 7, 11]] = (2.0, 5.0, 8.5)
    best, _ = knapsack(prices, 30)
    brute = max(2 * a + 5 * b + 8.5 * c for a in range(11) for b in range(5) for c in range(3) if 3 * a + 7 * b + 11 * c <= 30)
    assert best[30] == brute


def test_cached_ids_are_the_librarys():
    tokenizer, cache = Tokenizer.from_file(PATH), PieceCache(PATH, limit=50)
    for text in ["", " ", "  a\n\n b  ", "I'll we've 's 123 ¿qué? <|endoftext|> x", "naïve Ωmega 中文 \U0001f600 ͸", "a" * 500, *(t or "" for _, t in awkward())]:
        assert np.frombuffer(cache.packed(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
