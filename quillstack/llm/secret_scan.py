"""Secrets by patterns and by a randomness test battery.

Base kinds are patterns: assignments to password-like names, access keys, long hexadecimal runs. The battery looks at every
other long token of credential alphabets, all-letter and all-digit ones included: it infers the smallest encoding the token fits (decimal, hex, letters of
one case, base32, base36, letters of both, base62, base64; a run that mixes +/ with _- fits none and is taken apart at them) and asks

* chi-squared uniformity over that alphabet, the runs test about the alphabet's median, and lag-one serial correlation: a token for which one of them
  rejects a uniform random string (at ``LEVEL``) has p-value 1;
* of the others, how unlikely ordinary text is to look so, by the same three kinds of test under the corpus's own statistics: the chi-squared
  statistic's lower tail under its character frequencies, the upper tail of the runs (changes between lower case, upper case and
  digits) under its rate, the lower tail of the neighbours' log-likelihood under its letter pairs. They are combined into 1.5 times the middle one of the
  three, a p-value however they depend on each other, and one that a single null that fits badly (capitals inside words, a rare language) can't make small.

The p-values of all tested tokens of the corpus, those the battery refused included, go through a Benjamini-Hochberg step-up per length class at rate
``RATE``: a class of short tokens, in which the tests can tell little, asks for more than one of long ones. Refusing a token can only raise
its p-value, so the step-up's rate stands as far as the three nulls do (tests hold it on simulated corpora without secrets). Frequencies, rates, pair
counts and p-value histograms are sums over all documents; what reaches the driver is a few thousand numbers whatever the size of the corpus.

Defined cases: null text is empty; texts are scanned whole and tokens of every length tested; rows that repeat a doc_id are scanned each; an empty table gives no
rows; other columns are carried by ``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import identified, materialize, session, texts_of

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
NAMES = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A candidate of the battery; padding is not part of the test.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
MIXED = (re.compile("[+/]"), re.compile("[_-]"))
#: Parts of a run that mixes +/ with _- and so fits no encoding.
PARTS = (re.compile(r"[A-Za-z0-9_-]{20,}"), re.compile(r"[A-Za-z0-9+/]{20,}"), re.compile(r"[A-Za-z0-9]{20,}"))
ENCODINGS = (
    ("decimal", re.compile(r"[0-9]+"), 10),
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 16),
    ("letters", re.compile(r"[a-z]+|[A-Z]+"), 26),
    ("base32", re.compile(r"[A-Z2-7]+"), 32),
    ("base36", re.compile(r"[0-9a-z]+|[0-9A-Z]+"), 36),
    ("base52", re.compile(r"[A-Za-z]+"), 52),
    ("base62", re.compile(r"[0-9A-Za-z]+"), 62),
    ("base64", re.compile(r"[0-9A-Za-z+/]+|[0-9A-Za-z_-]+"), 64),
)
#: Tokens of at most so many characters have their results cached; all lengths are tested.
CACHED = 4096
LEVEL = 0.001
RATE = 0.01
#: A word's neighbouring pairs depend on each other, so the sum's variance is taken this many times larger.
SERIAL_EXCESS = 2.0
#: Length classes of the step-up, by their least length.
CLASSES = (20, 28, 40, 64, 128)
#: Histogram of -ln p: bins a unit, and bins in all.
BINS_A_UNIT, BINS = 8, 8 * 80


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, leftmost and non-overlapping within each."""
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _alphabet(name: str, token: str) -> str:
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    if name == "decimal":
        return digits
    if name == "letters":
        return lower if token[0].islower() else lower.upper()
    if name == "base52":
        return lower.upper() + lower
    if name == "hex":
        return digits + ("ABCDEF" if re.search("[A-F]", token) else "abcdef")
    if name == "base32":
        return lower.upper() + "234567"
    if name == "base36":
        return digits + (lower.upper() if re.search("[A-Z]", token) else lower)
    return digits + lower.upper() + lower + ("" if name == "base62" else "_-" if re.search("[_-]", token) else "+/")


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared with k degrees of freedom (Wilson-Hilferty)."""
    return _normal_tail(((max(x, 0) / k) ** (1 / 3) - 1 + 2 / (9 * k)) / math.sqrt(2 / (9 * k)))


@lru_cache(1 << 16)
def battery(token: str) -> tuple[str, str, float, int] | None:
    """(encoding, alphabet, chi-squared, class changes) if no test rejects a uniform random string, else None."""
    name, _, size = next((e for e in ENCODINGS if e[1].fullmatch(token)), (None, None, 0))
    if name is None:
        return None
    alphabet = _alphabet(name, token)
    place = {c: i for i, c in enumerate(alphabet)}
    values = [place[c] for c in token]
    n = len(values)
    counts = np.bincount(values, minlength=size)
    chi = float((counts * counts).sum()) * size / n - n
    if _chi_tail(chi, size - 1) < LEVEL:
        return None
    high = [v >= size // 2 for v in values]
    n1 = sum(high)
    n0 = n - n1
    if not n0 or not n1:
        return None
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    mean = 1 + 2 * n0 * n1 / n
    spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    if 2 * _normal_tail(abs(runs - mean) / spread) < LEVEL:
        return None
    centred = np.array(values) - np.mean(values)
    serial = float((centred[1:] * centred[:-1]).sum() / max((centred**2).sum(), 1e-9))
    if 2 * _normal_tail(abs(serial + 1 / n) * math.sqrt(n)) < LEVEL:
        return None
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in token]
    return name, alphabet, chi, sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))


def tested(token: str) -> tuple[str, str, float, int] | None:
    """The battery of a token of any length; long ones are not kept in the cache."""
    return (battery if len(token) <= CACHED else battery.__wrapped__)(token)


def tokens(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """What is tested of a run: the run, or, if it fits no encoding, its parts in each alphabet."""
    if not (MIXED[0].search(text, start, end) and MIXED[1].search(text, start, end)):
        return [(start, end)]
    return sorted({m.span() for part in PARTS for m in part.finditer(text, start, end)})


def candidates(text: str, base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, tuple[str, str, float, int] | None]]:
    """(start, end, battery) of the tokens that no base span touches; the battery is None if a test rejects a random string."""
    for m in CANDIDATE.finditer(text):
        if any(a < m.end() and m.start() < b for a, b, _ in base):
            yield from ((start, end, tested(text[start:end])) for start, end in tokens(text, *m.span()) if not any(a < end and start < b for a, b, _ in base))
        else:
            yield from ((start, end, tested(text[start:end])) for start, end in tokens(text, *m.span()))


CLASS_OF = np.zeros(256, np.int8)
CLASS_OF[48:58], CLASS_OF[97:123], CLASS_OF[65:91] = 1, 2, 3
#: Characters of letter pairs, case folded; what stands between words has the last place.
PLACE_OF = np.full(256, 40, np.int64)
PLACE_OF[48:58] = np.arange(10)
PLACE_OF[97:123] = PLACE_OF[65:91] = np.arange(10, 36)
PLACE_OF[[ord(c) for c in "+/_-"]] = np.arange(36, 40)
#: Places of the survey's sums: ASCII characters, neighbours in a word and class changes among them, tested tokens by length class, pairs.
NEIGHBOURS, CHANGES, TESTED, PAIRS = 128, 129, 130, 200
SUMS = PAIRS + 41 * 41


def survey_text(text: str, totals: np.ndarray) -> list[tuple[str, str, float, int]]:
    """Add a text to the sums; (token, alphabet, chi-squared, changes) of the tokens that the battery does not refuse."""
    raw = np.frombuffer(text.encode(), np.uint8)
    totals[:128] += np.bincount(raw, minlength=256)[:128]
    kinds, places = CLASS_OF[raw], PLACE_OF[raw]
    inside = (kinds[1:] > 0) & (kinds[:-1] > 0)
    totals[NEIGHBOURS] += int(inside.sum())
    totals[CHANGES] += int((inside & (kinds[1:] != kinds[:-1])).sum())
    totals[PAIRS:] += np.bincount(places[:-1] * 41 + places[1:], minlength=41 * 41)
    found = []
    for start, end, battery_ in candidates(text, base_spans(text)):
        totals[TESTED + _class_of(end - start)] += 1
        if battery_:
            found.append((text[start:end], *battery_[1:]))
    return found


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a task (a row for each that is not zero) and its tokens (key -1)."""
    totals = np.zeros(SUMS, np.int64)
    for batch in batches:
        yield _survey_batch([(-1, 1, *row) for text in texts_of(batch["text"]) for row in survey_text(text, totals)])
    yield _survey_batch([(k, int(n), None, None, None, None) for k, n in enumerate(totals) if n])


SURVEY = "key int, n long, token string, alphabet string, chi double, changes int"


def _survey_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32())
    columns = [*zip(*rows, strict=True)] or [()] * 6
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in SURVEY.split(", ")])


class Ordinary:
    """The ordinary-text null: p-value of a token that the battery did not refuse."""

    def __init__(self, totals: dict[int, int]):
        self.totals = totals
        self.rate = min(0.5, (totals.get(CHANGES, 0) + 1) / (totals.get(NEIGHBOURS, 0) + 20))
        self.tails = lru_cache(1 << 14)(self._tail)
        self.moments = lru_cache(64)(self._moments)
        pairs = np.array([totals.get(PAIRS + k, 0) for k in range(41 * 41)], float).reshape(41, 41)
        single = pairs[:40, :40].sum(axis=0) + 0.5
        mixed = pairs[:40, :40] + 8 * single / single.sum()  # a rare first character says what all do
        self.log = np.log(mixed / mixed.sum(axis=1, keepdims=True))
        share = mixed / mixed.sum()
        self.mean = float((share * self.log).sum())
        self.spread = math.sqrt(float((share * (self.log - self.mean) ** 2).sum()) * SERIAL_EXCESS)

    def _moments(self, alphabet: str) -> tuple[float, float]:
        one_case = "a" not in alphabet or "A" not in alphabet  # then the letters of both count: a corpus may have few of a case
        q = np.array([self.totals.get(ord(c), 0) + (self.totals.get(ord(c.swapcase()), 0) if one_case and c.isalpha() else 0) + 0.5 for c in alphabet], float)
        q /= q.sum()
        return float((q**2).sum()), float((q**3).sum())

    def _tail(self, n: int, changes: int) -> float:
        """P(Binomial(n, rate) >= changes)."""
        r = self.rate
        terms = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(r) + (n - k) * math.log1p(-r) for k in range(changes, n + 1)]
        top = max(terms)
        return min(1.0, math.exp(top) * sum(math.exp(t - top) for t in terms))

    def serial(self, token: str) -> float:
        """Lower tail of the neighbours' log-likelihood."""
        places = PLACE_OF[np.frombuffer(token.encode(), np.uint8)]
        total = float(self.log[places[:-1], places[1:]].sum())
        n = len(token) - 1
        return _normal_tail((n * self.mean - total) / (self.spread * math.sqrt(n)))

    def p_value(self, token: str, alphabet: str, chi: float, changes: int) -> float:
        n = len(token)
        s2, s3 = self.moments(alphabet)
        size = len(alphabet)
        mean = size * (1 - s2) + n * (size * s2 - 1)
        spread = 2 * size / n * math.sqrt(n * (n - 1) / 2 * (s2 - s2 * s2) + n * (n - 1) * (n - 2) * max(s3 - s2 * s2, 0))
        by_chi = _normal_tail((mean - chi) / max(spread, 1e-9))
        by_runs = self.tails(n - 1, changes)
        return min(1.0, 1.5 * sorted((by_chi, by_runs, self.serial(token)))[1])


def _class_of(n: int) -> int:
    return sum(n >= least for least in CLASSES) - 1


def _bin(p: float) -> int:
    return min(BINS - 1, int(-math.log(max(p, 1e-300)) * BINS_A_UNIT))


def step_up(histogram: dict[tuple[int, int], int], tested_: list[int], rate: float = RATE) -> dict[int, int]:
    """Least accepted bin of each length class: the largest p-value p(k) <= rate * k / m, by bins; m is the number of tokens tested."""
    least = {}
    for group, total in enumerate(tested_):
        passed, accepted = 0, BINS
        for k in range(BINS - 1, -1, -1):
            passed += histogram.get((group, k), 0)
            if passed and math.exp(-k / BINS_A_UNIT) <= rate * passed / total:
                accepted = k
        least[group] = accepted
    return least


class Model:
    """What the corpus says: the null and the accepted bins."""

    def __init__(self, totals: dict[int, int], least: dict[int, int]):
        self.totals, self.least = totals, least
        self.null: Ordinary | None = None

    def __getstate__(self):
        return {"totals": self.totals, "least": self.least, "null": None}

    def spans(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Base spans, and all spans by start, then kind."""
        self.null = self.null or Ordinary(self.totals)
        base = base_spans(text)
        passed = [
            (start, end)
            for start, end, found in candidates(text, base)
            if found and _bin(self.null.p_value(text[start:end], *found[1:])) >= self.least[_class_of(end - start)]
        ]
        more: list[tuple[int, int]] = []
        for start, end in sorted(passed, key=lambda s: (s[0] - s[1], s)):  # of parts that overlap, the longest
            at = bisect_left(more, (end,))
            if not at or more[at - 1][1] <= start:
                more.insert(at, (start, end))
        return base, sorted(base + [(start, end, "random") for start, end in more], key=lambda s: (s[0], KINDS.index(s[2])))


def fit_texts(texts: list[str], rate: float = RATE) -> Model:
    """The model of a few texts, without Spark."""
    totals = np.zeros(SUMS, np.int64)
    found = [row for text in texts for row in survey_text(text, totals)]
    sums = {k: int(n) for k, n in enumerate(totals) if n}
    null = Ordinary(sums)
    histogram = Counter((_class_of(len(row[0])), _bin(null.p_value(*row))) for row in found)
    return Model(sums, step_up(histogram, [sums.get(TESTED + k, 0) for k in range(len(CLASSES))], rate))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> Model:
    """One pass over the corpus for the sums and tokens; sums are made in Spark."""
    session(docs)
    survey = materialize(identified(docs, id_col, text_col).mapInArrow(_survey, SURVEY), "secret-survey")
    totals = {int(k): int(n) for k, n in survey.where("key >= 0").groupBy("key").agg(F.sum("n")).collect()}  # SUMS rows at most

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        null = Ordinary(totals)
        for batch in batches:
            rows = [(_class_of(len(t)), _bin(null.p_value(t, a, x, c))) for t, a, x, c in zip(*(batch[k].to_pylist() for k in ("token", "alphabet", "chi", "changes")), strict=True)]
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.int32()) for i in (0, 1)], ["grp", "bin"])

    counted = survey.where("key = -1").mapInArrow(bins, "grp int, bin int").groupBy("grp", "bin").agg(F.count("*"))
    histogram = {(g, k): n for g, k, n in counted.collect()}  # a few thousand rows at most
    return Model(totals, step_up(histogram, [totals.get(TESTED + k, 0) for k in range(len(CLASSES))], rate))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    model = fit(docs, id_col, text_col, rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), texts_of(batch["text"]), strict=True):
                base, every = model.spans(text)
                count = [sum(s[2] == kind for s in every) for kind in KINDS]
                rows.append((doc_id, *count[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), count[3]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = [*zip(*rows, strict=True)] or [()] * 7
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return identified(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


MARK = "<SECRET>"


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = MARK) -> str:
    """The text with the mark in place of each maximal run of overlapping spans."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", rate: float = RATE) -> DataFrame:
    """The input's rows and columns with secrets replaced; length_col, if there is one, follows. A null text stays null."""
    session(docs)
    model = fit(docs.withColumn("__none", F.lit(None).cast("long")), "__none", text_col, rate)
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else redacted(t, model.spans(t)[1]) for t in batch[text_col].to_pylist()]
            columns = {name: batch[name] for name in names}
            columns[text_col] = pa.array(texts, batch[text_col].type)
            if length_col in columns:
                was = batch[text_col].to_pylist()
                columns[length_col] = pa.array([n if a == b else len(b) for n, a, b in zip(columns[length_col].to_pylist(), was, texts, strict=True)], columns[length_col].type)
            yield pa.record_batch([*columns.values()], names=[*columns])

    return docs.mapInArrow(run, schema)
