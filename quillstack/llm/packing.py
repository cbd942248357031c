"""Best-fit packing of token sequences by a configuration linear program.

1. Tasks tokenize; a document longer than a sequence is cut so that only its first piece may be shorter. Each task also numbers
   its pieces of a length, so ranks over the whole corpus are a sum of counts away: no global sort.
2. The histogram of lengths (at most ``capacity`` numbers) goes to the driver. The covering program "use each length as often as
   it occurs with the fewest sequences" is solved by multiplicative weights, its configurations priced by a knapsack dynamic program: first its
   dual (prices of lengths at which no configuration is worth more than a sequence, and so a bound that no plan goes below), then,
   at these prices, the program itself, weights of lengths falling as their demand is met. Times of configurations are whole numbers; the
   remainder is packed best-fit, longest first. Never more sequences are used than best-fit alone uses.
3. The plan, a list of (configuration, times), says for the i-th piece of each length where it goes. Its size is bounded by the number
   of rounds and lengths, whatever the size of the corpus.
4. A piece's number among those of its length is its number in its task plus the counts of the tasks before, joined by task and length; the
   counts grow with the tasks and are never broadcast.

Defined cases: null and empty texts are the end token alone; rows that repeat a doc_id are packed each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import cache_of
from .common import identified, materialize, received, send_file, session, texts_of

CAPACITY = 1024
END_TOKEN = 2
#: Rounds of the multiplicative weights at most; the gap between plan and bound, as a share of the plan, that ends them; the least worth a taken configuration may lack.
ROUNDS, GAP, MOST_LACK = 200, 5e-4, 0.05
#: Near-dearest configurations that a round's step looks at.
MIXED = 48
#: Settings that the program is solved under: how far an open demand moves a price, what a piece of full size costs more, share of the size in a price.
SETTINGS = ((0.01, 0.02, 1e-3), (0.003, 0.3, 0.05))

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def cut_points(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(at, capacity) for at in range(first, n, capacity)]


def _tokenize(tokenizer: str, capacity: int, end_token: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = cache_of(received(tokenizer))
        end = int(end_token).to_bytes(4, "little")
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), texts_of(batch["text"]), strict=True):
                ids = encode.packed(text) + end
                for k, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
                    out.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = [*zip(*out, strict=True)] or [()] * 7
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], PIECES.replace(" long", "").replace(" int", "").split(", "))

    return run


def knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room 0..capacity the dearest multiset of lengths (prices[length]) that fits: its price, and a length of it (0: none)."""
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(prices > 0)
    priced = prices[lengths]
    ends = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if end := ends[room]:
            worth = priced[:end] + best[room - lengths[:end]]
            k = int(worth.argmax())
            if worth[k] > best[room]:
                best[room], took[room] = worth[k], lengths[k]
    return best, took


def configuration(first: int, took: np.ndarray, capacity: int) -> dict[int, int]:
    """The best configuration with a given length in it: how often each length is used."""
    uses = {first: 1}
    room = capacity - first
    while room > 0:
        length = int(took[room])
        if length:
            uses[length] = uses.get(length, 0) + 1
        room -= length or 1
    return uses


def start_prices(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Prices to start from: of the dual-feasible functions (a rounding of a length's share of a sequence to k-ths, short lengths free and
    lengths that only those fit beside at the full price) the one whose bound is highest; of the lengths' own shares if none is higher."""
    need = np.flatnonzero(counts)
    n = counts[need].astype(float)
    best, found = float((n * need).sum()) / capacity, need / capacity
    for free in np.concatenate(([0], need[need <= capacity // 2])):
        size = np.where(need < free, 0, np.where(need > capacity - free, capacity, need))
        for k in range(1, 21):
            times = (k + 1) * size
            share = np.where(times % capacity == 0, size / capacity, times // capacity / k)
            if (bound := float(n @ share)) > best * (1 + 1e-9):
                best, found = bound, share
        if (bound := float(n @ size) / capacity) > best * (1 + 1e-9):
            best, found = bound, size / capacity
    prices = np.zeros(capacity + 1)
    prices[need] = found
    return prices


def dual_bound(counts: np.ndarray, known: int, start: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """(bound, prices): no plan has fewer sequences than the bound, which is the demand's worth at prices that value no configuration above one.

    Multiplicative weights on the demand of each length: a round prices the lengths by their weights, the knapsack table gives the dearest
    configuration with each, and the weights of lengths that the near-dearest ones hold more of than the demand does fall by a factor, the others
    rise. The factor follows the gap to a known plan; the rounds end when it is below GAP of the plan or less than one sequence.
    """
    need = np.flatnonzero(counts)
    n = counts[need].astype(float)
    bound, prices = float(counts @ start), start
    weight = np.log(0.9 * start[need] + 0.1 * need / capacity)
    here, pace, idle = weight.copy(), 1.0, 0
    for _ in range(rounds):
        if np.ceil(bound - 1e-6) >= known or known - bound <= GAP * known:
            break
        price = np.zeros(capacity + 1)
        price[need] = np.exp(weight - weight.max())
        best, took = knapsack(price, capacity)
        top, worth = best[capacity], price[need] + best[capacity - need]
        now = float(n @ price[need]) / top
        idle += 1
        if now > bound * (1 + 1e-9):
            bound, prices, here, idle = now, price / top, weight.copy(), 0
        elif idle >= 12:
            weight, pace, idle = here.copy(), pace * 0.6, 0
        near = np.flatnonzero(worth >= top * (1 - 1e-3))
        near = near[np.argsort(-n[near] * need[near], kind="stable")[:MIXED]]
        share = n[near] * need[near]
        held = np.zeros(capacity + 1)
        for k, part in zip(need[near].tolist(), (share / share.sum()).tolist(), strict=True):
            for length, uses in configuration(k, took, capacity).items():
                held[length] += part * uses
        worths = n * price[need]
        slope = worths / worths.sum() - held[need] * price[need] / (held @ price)
        if (steep := float(slope @ slope)) < 1e-16:
            break
        step = pace * max(np.log(known / now), 1e-5) / steep * slope
        weight = weight + step / max(1.0, 2 * float(np.abs(step).max()))
    return bound, prices


def start_prices(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Prices to start from: of the dual-feasible functions (a rounding of a length's share of a sequence to k-ths, short lengths free and
    lengths that only those fit beside at the full price) the one whose bound is highest; of the lengths' own shares if none is higher."""
    need = np.flatnonzero(counts)
    n = counts[need].astype(float)
    best, found = float((n * need).sum()) / capacity, need / capacity
    for free in np.concatenate(([0], need[need <= capacity // 2])):
        size = np.where(need < free, 0, np.where(need > capacity - free, capacity, need))
        for k in range(1, 21):
            times = (k + 1) * size
            share = np.where(times % capacity == 0, size / capacity, times // capacity / k)
            if (bound := float(n @ share)) > best * (1 + 1e-9):
                best, found = bound, share
        if (bound := float(n @ size) / capacity) > best * (1 + 1e-9):
            best, found = bound, size / capacity
    prices = np.zeros(capacity + 1)
    prices[need] = found
    return prices


def dual_bound(counts: np.ndarray, known: int, start: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """(bound, prices): no plan has fewer sequences than the bound, which is the demand's worth at prices that value no configuration above one.

    Multiplicative weights on the demand of each length: a round prices the lengths by their weights, the knapsack table gives the dearest
    configuration with each, and the weights of lengths that the near-dearest ones hold more of than the demand does fall by a factor, the others
    rise. The factor follows the gap to a known plan; the rounds end when it is below GAP of the plan or less than one sequence.
    """
    need = np.flatnonzero(counts)
    n = counts[need].astype(float)
    bound, prices = float(counts @ start), start
    weight = np.log(0.9 * start[need] + 0.1 * need / capacity)
    here, pace, idle = weight.copy(), 1.0, 0
    for _ in range(rounds):
        if np.ceil(bound - 1e-6) >= known or known - bound <= GAP * known:
            break
        price = np.zeros(capacity + 1)
        price[need] = np.exp(weight - weight.max())
        best, took = knapsack(price, capacity)
        top, worth = best[capacity], price[need] + best[capacity - need]
        now = float(n @ price[need]) / top
        idle += 1
        if now > bound * (1 + 1e-9):
            bound, prices, here, idle = now, price / top, weight.copy(), 0
        elif idle >= 12:
            weight, pace, idle = here.copy(), pace * 0.6, 0
        near = np.flatnonzero(worth >= top * (1 - 1e-3))
        near = near[np.argsort(-n[near] * need[near], kind="stable")[:MIXED]]
        share = n[near] * need[near]
        held = np.zeros(capacity + 1)
        for k, part in zip(need[near].tolist(), (share / share.sum()).tolist(), strict=True):
            for length, uses in configuration(k, took, capacity).items():
                held[length] += part * uses
        worths = n * price[need]
        slope = worths / worths.sum() - held[need] * price[need] / (held @ price)
        if (steep := float(slope @ slope)) < 1e-16:
            break
        step = pace * max(np.log(known / now), 1e-5) / steep * slope
        weight = weight + step / max(1.0, 2 * float(np.abs(step).max()))
    return bound, prices


def solve_program(counts: np.ndarray, prices: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS, rate: float = 0.01, premium: float = 0.02, blend: float = 1e-3) -> list[tuple[np.ndarray, int]]:
    """Configurations and times, by multiplicative weights on the open demand: [(uses of each length, times)], no length beyond its count.

    The weight of a length is exp(rate * open share of its demand): lengths that lag get dearer by a factor, those ahead cheaper. A round
    prices each length at its dual price (a little of its size blended in, so that free lengths fill what is left) times its weight; one
    knapsack table gives, for every length, the dearest configuration with it. Of the lengths that lag most, those worth a whole sequence at the dual
    prices are taken, for a part of the open demand. When a round takes none, a configuration may be worth a little less.
    """
    size = np.arange(capacity + 1) / capacity
    base = (prices * (1 - blend) + blend * size) * (1 + premium * size)
    total, rest = counts.astype(float), counts.astype(float)
    need = np.flatnonzero(counts)
    plan: list[tuple[np.ndarray, int]] = []
    lack = 1e-6
    for turn in range(rounds):
        share = np.divide(rest, total, out=np.zeros_like(rest), where=total > 0)
        open_ = need[rest[need] > 0]
        if not len(open_) or lack > MOST_LACK:
            break
        price = np.where(share > 0, base * np.exp(rate * share), 0)
        best, took = knapsack(price, capacity)
        worth = price[open_] + best[capacity - open_]
        order = open_[np.lexsort((-open_, -np.round(worth, 9)))]
        before = len(plan)
        for first in order[: max(8, len(order) // 8)].tolist():
            uses = configuration(first, took, capacity)
            times = int(min(rest[length] // n for length, n in uses.items()))
            if times and sum(prices[length] * n for length, n in uses.items()) >= 1 - lack:
                times = times if times < 4 or turn > rounds // 2 else times // 2
                row = np.zeros(capacity + 1, np.int64)
                for length, n in uses.items():
                    row[length] = n
                rest -= row * float(times)
                plan.append((row, times))
        if len(plan) == before:
            lack = max(2 * lack, 1e-4)
    return plan


def best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[np.ndarray, int]]:
    """Best-fit decreasing over a histogram: equal sequences are filled together, so it takes steps by length, not by piece."""
    left = counts.astype(np.int64).copy()
    plan: list[tuple[np.ndarray, int]] = []
    while left.any():
        uses = np.zeros(capacity + 1, np.int64)
        room = capacity
        while room:
            fits = np.flatnonzero((left[: room + 1] > uses[: room + 1]))
            if not len(fits):
                break
            length = int(fits[-1])
            more = min(room // length, int(left[length] - uses[length]))
            uses[length] += more
            room -= more * length
        inside = np.flatnonzero(uses)
        times = int((left[inside] // uses[inside]).min())
        left -= uses * times
        plan.append((uses, times))
    return plan


def pack_histogram(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[np.ndarray, int]], float]:
    """(plan, bound): an integral plan [(uses of each length, times)] that serves counts[length] exactly, and a number of sequences that none can go below.

    The program is rounded as it is solved (times are whole) under each of SETTINGS; best-fit serves what it leaves open. Best-fit of the whole demand
    is the known plan that the program starts from, and stays where the program needs no fewer sequences.
    """
    counts = counts.astype(np.int64)
    whole = np.zeros(capacity + 1, np.int64)
    whole[capacity] = 1
    full = [(whole, int(counts[capacity]))] if counts[capacity] else []
    left = counts.copy()
    left[capacity] = 0
    if not left.any():
        return full, float(counts[capacity])
    plans = [best_fit(left, capacity)]
    length = lambda plan: sum(times for _, times in plan)
    bound, prices = max((dual_bound(left, length(plans[0]), start, capacity, rounds // 2) for start in (start_prices(left, capacity), np.arange(capacity + 1) / capacity * (left > 0))), key=lambda found: found[0])
    for rate, premium, blend in SETTINGS:
        bound, prices = dual_bound(left, min(map(length, plans)), prices, capacity, rounds)
        if min(map(length, plans)) > np.ceil(bound - 1e-6):
            taken = solve_program(left, prices, capacity, rounds, rate, premium, blend)
            plans.append(taken + best_fit(left - sum((uses * times for uses, times in taken), np.zeros_like(left)), capacity))
    return full + min(plans, key=length), bound + float(counts[capacity])


def slots(plan: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of each place the plan has for it."""
    places: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    filled: dict[int, int] = defaultdict(int)
    sequence = 0
    for uses, times in plan:
        offset = 0
        for length in np.flatnonzero(uses)[::-1].tolist():
            for _ in range(int(uses[length])):
                places[length].append((filled[length], sequence, offset))
                filled[length] += times
                offset += length
        sequence += times
    return {length: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for length, rows in places.items()}


def _place(table: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy() + batch["before"].to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(rows):
                    first, start, at = table[int(length[rows[0]])]
                    k = np.searchsorted(first, rank[rows], side="right") - 1
                    sequence[rows], offset[rows] = start[k] + rank[rows] - first[k], at[k]
            yield pa.record_batch([*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_token: int = END_TOKEN, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    session(docs)
    pieces = materialize(identified(docs, id_col, text_col).mapInArrow(_tokenize(send_file(docs.sparkSession, tokenizer), capacity, end_token), PIECES), "pieces")
    counts = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # one row per length, at most capacity
        histogram[length] = n
    plan, _ = pack_histogram(histogram, capacity, rounds)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("part").alias("__part"), F.col("length").alias("__length"), F.coalesce(before, F.lit(0)).alias("before"))
    # a merge join: the counts grow with the tasks, and a piece's row is a few numbers
    numbered = pieces.join(offsets.hint("merge"), (pieces["part"] == offsets["__part"]) & (pieces["length"] == offsets["__length"])).drop("__part", "__length")
    return numbered.mapInArrow(_place(slots(plan)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
