"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel compares two words by the four-character subsequences they share, gaps allowed: one that spans s characters of a word counts
``DECAY`` ** s, and the kernel of two words is the normalised sum of products over what they share. A word with inserted characters
keeps most of its subsequences, a little longer; letters written apart are joined to one word first.

Training, on labelled documents only (labels are given to documents; what is learned from are the words and windows of their sentences):

1. Words which toxic documents have and others lack (a one-sided binomial test) are positive examples; the words of clean documents are
   negative ones. Positive words are also shown gapped and with one or two inserted characters. Clean words that were not learned from and look
   toxic to the first machine are learned by the second.
2. Landmarks are drawn from the positive words (farthest first in the kernel, so that every family has one) and from frequent clean words.
   Nystroem features are K(L, L)^(-1/2) k(x, L); a linear SVM with squared hinge loss is fitted to them by Newton steps.
3. A second machine of the same kind learns windows: two to four neighbouring words of a sentence, written together, under the kernel with
   narrower gaps. Positive ones are the toxic words (which may be split by spaces) and the windows that toxic documents have and others lack;
   negative ones are windows of clean documents. Phrases of ordinary words are found by it.
4. A machine's decision function is a weighted sum of kernels with the landmarks, so it folds into one table of subsequences. Documents are
   described by the three best margins of their words and windows (those that hold no toxic word and do not overlap) and by how many reach
   HIT; a logistic function of these, fitted to the documents' labels, gives the score.

Each worker scores a distinct word once. The training sample is bounded by ``MAX_TOXIC`` and ``MAX_CLEAN`` documents of ``MAX_CHARS`` characters in
all (in hash order of their ids, whole texts only), and of their clean words and windows by ``HEAD`` and ``TAIL``, the most frequent and an even
sample of the others, to which come all that look toxic.

Defined cases: a document with labels of both kinds is toxic; of rows that repeat a labelled doc_id the shortest text is learned from; null and empty texts get the score of a text without words; without labelled toxic rows every score is 0; labels,
language, source and doc_id never enter a score; rows that repeat a doc_id are scored each; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, zip_longest

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import identified, session, texts_of

#: Bounds of the training sample, documents and characters.
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 2000, 3000, 24_000_000
DECAY = 0.6
#: Characters of a subsequence. One spans at most so many characters; longer words are scored in windows of LONGEST.
ORDER, SPAN, LONGEST = 4, 9, 24
#: Windows are so many neighbouring words of a sentence, written together; a subsequence of theirs spans at most so many characters.
WINDOWS, NARROW = (2, 3, 4), 5
LANDMARKS, CLEAN_LANDMARKS, VARIED = 224, 96, 80
#: Times that the clean words with the largest margins are added to the landmarks.
HARDER = 3
#: Slots of the hashed table of subsequences.
CODES, SLOTS = 64, 1 << 20
STEP = 0x9E3779B97F4A7C15
#: Clean words to learn from: the most frequent, and an even sample of the others.
HEAD, TAIL = 5000, 14_000
#: Margin from which a word counts as an insult in a document.
HIT = 0.5
#: Margin from which a word's runs of a letter are looked at; clean words lie below it.
NEAR = -0.9
CUT = 0.7
WORD = re.compile(r"[^\s.,;:!?\"()\[\]{}|]+(?:[.,;:!?|]+[^\s.,;:!?\"()\[\]{}|]+)*")
INNER = re.compile(r"[\W_]+")
RUNS = re.compile(r"(.)\1+", re.DOTALL)


def code(character: str) -> int:
    """Letters have a code each, other characters share the rest."""
    place = ord(character) - 97
    return place + 2 if 0 <= place < 26 else 28 + ord(character) % 35


@lru_cache(256)
def subsequences(n: int, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of the subsequences of a word of n characters."""
    found = [(i, *rest) for i in range(n) for rest in combinations(range(i + 1, min(n, i + span)), ORDER - 1)]
    places = np.array(found, np.int64).reshape(-1, ORDER)
    return places, DECAY ** (places[:, -1] - places[:, 0] + 1 - ORDER).astype(float)


def features(words: list[str], n: int, span: int = SPAN, with_norms: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(slots of the subsequences, weights, norms) of words of equal length, n characters with the mark before the first."""
    places, weights = subsequences(n, span)
    codes = np.array([[1, *map(code, w)] for w in words], np.int64).reshape(-1, n)
    keys = codes[:, places[:, 0]]
    for k in range(1, ORDER):
        keys = keys * CODES + codes[:, places[:, k]]
    keys = (keys * 0x9E3779B1 >> 9) & SLOTS - 1
    if span == NARROW:
        return keys, weights, np.full(len(words), np.sqrt((weights**2).sum()))
    return keys, weights, norms_of(keys, weights) if with_norms else None


def norms_of(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Norms of rows of weighted slots, equal slots of a row taken together."""
    order = np.argsort(keys, axis=1)
    ranked, mass = np.take_along_axis(keys, order, 1), weights[order]
    total = np.cumsum(mass, axis=1)
    last = np.concatenate((ranked[:, 1:] != ranked[:, :-1], np.ones((len(keys), 1), bool)), axis=1)
    until = np.where(last, total, 0)
    before = np.concatenate((np.zeros((len(keys), 1)), np.maximum.accumulate(until, axis=1)[:, :-1]), axis=1)
    return np.maximum(np.sqrt((np.where(last, total - before, 0) ** 2).sum(axis=1)), 1e-12)


def by_length(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    groups = defaultdict(list)
    for i, w in enumerate(words):
        groups[len(w) + 1].append(i)
    yield from groups.items()


def kernel(words: list[str], landmarks: list[str], span: int = SPAN) -> np.ndarray:
    """Normalised kernel of each word with each landmark."""
    known = [(i, keys[k], weights / norms[k]) for n, rows in by_length(landmarks) if n >= ORDER for keys, weights, norms in [features([landmarks[i] for i in rows], n, span)] for k, i in enumerate(rows)]
    used = np.unique(np.concatenate([keys for _, keys, _ in known])) if known else np.empty(0, np.int64)
    slot = np.zeros(SLOTS, np.int32)
    slot[used] = np.arange(1, len(used) + 1)
    dense = np.zeros((len(used) + 1, len(landmarks)), np.float32)  # (slots used, landmarks)
    for i, keys, mass in known:
        np.add.at(dense[:, i], slot[keys], mass)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for n, rows in by_length(words):
        if n < ORDER:
            continue
        for at in range(0, len(rows), 500):
            some = rows[at : at + 500]
            keys, weights, norms = features([words[i] for i in some], n, span)
            found = slot[keys]
            sums = np.zeros((len(some), len(landmarks)), np.float32)
            for column in np.flatnonzero(found.any(axis=0)):
                sums += weights[column] * dense[found[:, column]]
            out[some] = sums / norms[:, None]
    return out


def words_in(text: str) -> list[str]:
    """Lower-case words without outer punctuation; runs of single letters are joined to a word as well."""
    words = WORD.findall(text.lower())
    run: list[str] = []
    for w in [*words, ""]:
        if len(w) == 1:
            run.append(w)
        elif run:
            if len(run) > 3:
                words.append("".join(run))
            run = []
    return words


@lru_cache(1)
def kinds() -> np.ndarray:
    """Of each character below 65536: 0 inside words but no letter, 1 letter or digit, 2 between words, 3 end mark, 4 space, 5 new line."""
    return np.array([5 if c == "\n" else 4 if c.isspace() else 3 if c in ".!?" else 2 if c in ",;:\"()[]{}|" else int(c.isalnum()) for c in map(chr, range(1 << 16))], np.int8)


class Stream:
    """Letters of some texts without what is between them, and the windows over neighbouring words of their sentences."""

    def __init__(self, texts: list[str]):
        lowered = [t.lower() for t in texts]
        raw = np.frombuffer("".join(t + "\n" for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.append(kinds()[np.minimum(raw, 0xFFFF)], np.int8(5))
        kind[:-1][raw > 0xFFFF] = 1
        kind[:-1][(raw >= 0x1F000) & (raw < 0x1FB00)] = 0  # emoji
        end = (kind[:-1] == 5) | (kind[:-1] == 3) & (kind[1:] >= 4)
        kind = kind[:-1]
        at = np.flatnonzero(kind == 1)
        word = np.cumsum(kind >= 2, dtype=np.int32)[at]
        first = np.flatnonzero(np.diff(word, prepend=-1))
        self.letters = raw[at]
        self.text = self.letters.tobytes().decode("utf-32-le", "surrogatepass")
        self.bounds = np.append(first, len(at))
        sentence = np.cumsum(end, dtype=np.int32)[at[first]]
        doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])[at[first]]
        parts = []
        for k in WINDOWS:
            some = np.flatnonzero(sentence[k - 1 :] == sentence[: len(sentence) - k + 1]) if len(sentence) >= k else np.empty(0, np.int64)
            parts.append((some, np.full(len(some), k)))
        self.word, self.size = (np.concatenate(p) for p in zip(*parts, strict=True))
        self.start, self.end = self.bounds[self.word], self.bounds[self.word + self.size]
        long_ = self.end - self.start >= ORDER
        self.word, self.size, self.start, self.end = self.word[long_], self.size[long_], self.start[long_], self.end[long_]
        self.doc = doc[self.word]

    def string(self, k: int) -> str:
        return self.text[self.start[k] : self.end[k]]

    def words(self, k: int) -> list[str]:
        bounds = self.bounds[self.word[k] : self.word[k] + self.size[k] + 1].tolist()
        return [self.text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def hashes(self) -> np.ndarray:
        """64 bits of each window's letters."""
        n = len(self.letters)
        power, back = (np.cumprod(np.append(np.uint64(1), np.full(n, p, np.uint64)), dtype=np.uint64) for p in (STEP, pow(STEP, -1, 1 << 64)))
        total = np.append(np.uint64(0), np.cumsum((self.letters.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64))
        found = (total[self.end] - total[self.start]) * back[self.start]
        return found ^ found >> np.uint64(29)

    def margins(self, table: np.ndarray, bias: float) -> np.ndarray:
        """Decision function of each window, as ``features`` with NARROW has it."""
        place = self.letters.astype(np.int64) - 97
        codes = np.append(np.where((place >= 0) & (place < 26), place + 2, 28 + self.letters % 35), np.zeros(ORDER, np.int64))
        n = len(self.letters)
        c = [codes[k : n + k] for k in range(ORDER + 1)]

        def values(a, b, c, d) -> np.ndarray:
            return table[(((a * CODES + b) * CODES + c) * CODES + d) * 0x9E3779B1 >> 9 & SLOTS - 1]

        near = np.append(0, np.cumsum(values(*c[:4]), dtype=float))
        far = np.append(0, np.cumsum(values(c[0], c[1], c[2], c[4]) + values(c[0], c[1], c[3], c[4]) + values(c[0], c[2], c[3], c[4]), dtype=float))
        f = [x[self.bounds[:-1]] for x in c]
        marked = values(1, *f[:3]) + DECAY * (values(1, f[0], f[1], f[3]) + values(1, f[0], f[2], f[3]) + values(1, f[1], f[2], f[3]))
        size = self.end - self.start
        sums = marked[self.word] + near[self.end - 3] - near[self.start] + DECAY * (far[self.end - 4] - far[self.start])
        return bias + sums / np.sqrt(size - 2 + 3 * (size - 3) * DECAY**2)


def views(word: str) -> list[str]:
    """What is scored for a word: itself, without inner punctuation too, in overlapping windows if it is long."""
    inner = INNER.sub("", word)
    found = [word] if inner == word or not inner else [word, inner]
    return [w[at : at + LONGEST] for w in found for at in range(0, max(1, len(w) - LONGEST // 2), LONGEST // 2)]


LETTERS = "etaoinshrdlucmfwypvbgkjqxz"


def gapped(word: str) -> list[str]:
    """The same word with characters inserted."""
    middle, k = len(word) // 2, sum(map(ord, word))
    pair = LETTERS[k % 26] + LETTERS[(k // 7 + 11) % 26]
    return [
        *views("".join(c + "." for c in word))[:1],
        word[:middle] + "*" + word[middle:],
        word[:1] + "-" + word[1:],
        word[:middle] + word[middle : middle + 1] + word[middle:],
        word[:2] + pair + word[2:],
        word[:-2] + pair[0] * 2 + word[-2:],
        word[:middle] + "xx" + word[middle:],
    ]


class Machine:
    """The fitted decision function and the document's logistic function."""

    def __init__(self, table: np.ndarray, bias: float, weights: tuple[float, ...], windows: tuple[np.ndarray, float] | None = None):
        self.table, self.bias, self.weights, self.windows = table, bias, weights, windows
        self.cache: dict[str, float] = {}

    def __getstate__(self):
        used = np.flatnonzero(self.table)
        return {"used": used.astype(np.int32), "values": self.table[used], "bias": self.bias, "weights": self.weights, "windows": self.windows}

    def __setstate__(self, state):
        table = np.zeros(SLOTS, np.float32)
        table[state["used"]] = state["values"]
        self.__init__(table, state["bias"], state["weights"], state["windows"])

    def margins(self, words: list[str]) -> list[float]:
        """Margins of distinct words: the best of their views; of a word that is near an insult, with one letter for each run of a letter too."""
        out = self.plain_margins(words)
        near = [i for i in np.flatnonzero((out > NEAR) & (out < HIT)) if RUNS.search(words[i])]
        if near:
            single = self.plain_margins([RUNS.sub(r"\1", INNER.sub("", words[i])) for i in near])
            out[near] = np.maximum(out[near], single)
        return out.tolist()

    def plain_margins(self, words: list[str]) -> np.ndarray:
        """Margins, exact from NEAR on; below it a bound that is below NEAR too."""
        flat = [(v, i) for i, w in enumerate(words) for v in views(w)]
        out = np.full(len(words), -np.inf)
        strings = [v for v, _ in flat]
        for n, rows in by_length(strings):
            if n >= ORDER:
                for at in range(0, len(rows), 512):
                    some = rows[at : at + 512]
                    keys, weights, _ = features([strings[i] for i in some], n, with_norms=False)
                    sums = (self.table[keys] * weights).sum(axis=1)
                    margin = self.bias + np.maximum(sums, 0) / np.sqrt((weights**2).sum())  # no norm is less, so no margin more
                    close = np.flatnonzero(margin >= NEAR)
                    if len(close):
                        margin[close] = self.bias + sums[close] / norms_of(keys[close], weights)
                    np.maximum.at(out, np.array([flat[i][1] for i in some]), margin)
        return np.where(np.isinf(out), -1.0, out)  # a word without a subsequence is no insult

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.cache]
        if new:
            if len(self.cache) > 400_000:
                self.cache.clear()
                new = list(words)
            self.cache.update(zip(new, self.margins(new), strict=True))

    def window_hits(self, texts: list[str]) -> list[list[float]]:
        """Of each text: the margins from HIT on of windows that do not overlap and hold no word that is a hit itself, each string once."""
        out: list[list[float]] = [[] for _ in texts]
        if self.windows is None:
            return out
        stream = Stream(texts)
        margins = stream.margins(*self.windows)
        found = np.flatnonzero(margins >= HIT)
        self.learn({w for k in found for w in stream.words(k)})
        taken, seen = set(), set()
        for k in found[np.argsort(-margins[found], kind="stable")]:
            places = range(stream.word[k], stream.word[k] + stream.size[k])
            if taken.isdisjoint(places) and all(self.cache[w] < HIT for w in stream.words(k)):
                taken.update(places)
                if (once := (stream.doc[k], stream.string(k))) not in seen:
                    seen.add(once)
                    out[stream.doc[k]].append(float(margins[k]))
        return out

    def describe(self, words: list[str], more: list[float]) -> tuple[float, float, float, float]:
        """Of distinct words, and of margins of windows: the three best margins from HIT on, and log of one plus their number."""
        if not words:
            return -1.0, -1.0, -1.0, 0.0
        margins = [*map(self.cache.__getitem__, set(words)), *more]
        hits = sorted([m for m in margins if m >= HIT], reverse=True)
        best = [min(m, 2.5) for m in (*hits[:3], -1.0, -1.0, -1.0)[:3]]
        return *best, float(np.log1p(len(hits)))

    def score(self, *described: float) -> float:
        *weights, bias = self.weights
        return float(1 / (1 + np.exp(-np.clip(sum(w * d for w, d in zip(weights, described, strict=True)) + bias, -30, 30))))


def toxic_words(documents: list[tuple[list[str], int]]) -> tuple[list[tuple[str, int]], Counter]:
    """Words that toxic documents have and others lack, each with its toxic documents, and the document counts of clean documents' words."""
    toxic, clean = Counter(), Counter()
    for words, label in documents:
        (toxic if label else clean).update(set(words))
    n_toxic = sum(label for _, label in documents)
    share = max(n_toxic / max(len(documents), 1), 1e-6)
    found = []
    for word, n in toxic.items():
        if len(word) >= 3 and n >= 2:
            of = n + clean[word]
            # binomial tail bound (Chernoff) of n or more toxic among `of` documents
            rate = n / of
            if rate > max(0.8, share):
                bound = of * (rate * np.log(rate / share) + ((1 - rate) * np.log((1 - rate) / (1 - share)) if rate < 1 else 0))
                if bound > np.log(max(len(toxic), 1)) + np.log(2):
                    found.append((bound, word, n))
    return [(w, n) for _, w, n in sorted(found, reverse=True)], clean


def farthest_first(words: list[str], n: int, span: int = SPAN) -> list[str]:
    """Landmarks that cover the words: each next one is, of all words, one least like those chosen (looked for some at a time)."""
    if len(words) <= n:
        return words
    chosen = [0]
    like = kernel(words, words[:1], span)[:, 0]
    while len(chosen) < n:
        far = np.argsort(like, kind="stable")[:8]
        limit = like[far[-1]]
        near = kernel(words, [words[k] for k in far], span)
        for column, k in enumerate(far.tolist()):
            if len(chosen) < n and (column == 0 or like[k] <= limit):
                chosen.append(k)
                like = np.maximum(like, near[:, column])
        like[chosen] = np.inf
    return [words[k] for k in chosen]


def fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 40) -> np.ndarray:
    """Squared-hinge linear SVM with a bias as the last weight: Newton steps on the active rows, each with a line search."""
    x = np.concatenate((x, np.ones((len(x), 1), x.dtype)), axis=1)
    w = np.zeros(x.shape[1])
    w[-1] = -1
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-3

    def loss(margin: np.ndarray, w: np.ndarray) -> float:
        return 0.5 * float(ridge @ (w * w)) + float((cost * np.maximum(0, 1 - margin) ** 2).sum())

    margin = y * (x @ w)
    now = loss(margin, w)
    for _ in range(steps):
        active = np.flatnonzero(margin < 1)
        square, linear = np.diag(ridge), np.zeros(len(w))
        for at in range(0, len(active), 2000):  # in blocks, so that memory stays small
            some = active[at : at + 2000]
            xa = x[some].astype(float)
            weighted = xa * cost[some, None]
            square = square + 2 * weighted.T @ xa
            linear += 2 * weighted.T @ y[some]
        new = np.linalg.solve(square, linear)
        toward = y * (x @ new)
        size = 1.0
        while size > 1e-4 and (then := loss(margin + size * (toward - margin), w + size * (new - w))) >= now:
            size /= 2
        if size <= 1e-4 or now - then < 1e-6 * now:
            break
        margin, w, now = margin + size * (toward - margin), w + size * (new - w), then
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> np.ndarray:
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 1e-2 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def collapsed(samples: list[tuple[str, int]]) -> tuple[list[tuple[str, int]], np.ndarray]:
    """Samples without copies and near copies of one label, and how many each stands for: words of a text that was copied are not evidence each time.

    A sample joins an earlier one with which it shares one of the two least hashes of its three-word shingles.
    """
    kept: list[tuple[str, int]] = []
    size: list[int] = []
    seen: dict[tuple[int, int], int] = {}
    for text, label in samples:
        words = (text or "").encode().split()
        hashes = {xxhash.xxh64_intdigest(b" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))}
        keys = [(label, h) for h in sorted(hashes)[:2]]
        at = next((seen[k] for k in keys if k in seen), None)
        if at is None:
            at = len(kept)
            kept.append((text or "", label))
            size.append(0)
        size[at] += 1
        for k in keys:
            seen.setdefault(k, at)
    return kept, np.array(size, float)


def train(samples: list[tuple[str, int]], rates: tuple[float, float] = (1.0, 1.0)) -> Machine:
    """Fit on (text, label) rows; rates: how many rows of the corpus a sampled clean and a sampled toxic row stand for."""
    samples, copies = collapsed(samples)
    documents = [(words_in(t), int(label)) for t, label in samples]
    positive, clean = toxic_words(documents)
    if not positive:
        return Machine(np.zeros(SLOTS, np.float32), -1.0, (0.0, 0.0, 0.0, 0.0, -30.0))
    support: dict[str, int] = {}
    for word, n in positive:
        for view in views(word):
            support.setdefault(view, n)
    positive = [*support]
    every = Counter()
    for word, n in clean.items():
        if len(word) >= 2:
            for view in views(word):
                if view not in support:
                    every[view] += n
    negative = [w for w, _ in every.most_common()]
    step = max(1, (len(negative) - HEAD) // TAIL)
    learned = negative[:HEAD] + negative[HEAD::step]
    share = [1.0] * min(HEAD, len(negative)) + [float(min(step, 12))] * (len(learned) - min(HEAD, len(negative)))
    landmarks = farthest_first(positive, LANDMARKS)
    variants = [v for w in landmarks[:VARIED] if len(w) >= 4 for v in gapped(w)]
    for again in (True, False):
        words = positive + variants + learned
        y = np.array([1.0] * (len(positive) + len(variants)) + [-1.0] * len(learned))
        # a clean word counts by its documents, so that short frequent ones are not taken for the stems they begin (and a rare one for those left out)
        # and a toxic one by its own
        cost = np.concatenate((3 * np.sqrt([min(400, support[w]) for w in positive]), np.full(len(variants), 1.5), np.sqrt([min(400, 1 + every[w]) for w in learned]) * share))
        table, bias = fit_table(words, y, cost, landmarks, learned, harder=1 if again else HARDER)
        if again:  # the other clean words that look toxic are learned too
            known = set(learned)
            others = [w for w in negative if w not in known]
            margins = Machine(table, bias, ()).margins(others)
            toxic_like = [w for w, m in zip(others, margins, strict=True) if m > -0.3]
            learned = toxic_like + learned
            share = [1.0] * len(toxic_like) + share
    machine = Machine(table, bias, ())
    machine.windows = train_windows(samples, positive, machine)
    described = []
    for at in range(0, len(samples), 64):
        some = [words for words, _ in documents[at : at + 64]]
        more = machine.window_hits([t or "" for t, _ in samples[at : at + 64]])
        machine.learn({w for words in some for w in words})
        described += [machine.describe(words, hits) for words, hits in zip(some, more, strict=True)]
    described = np.array(described)
    labels = np.array([label for _, label in documents], float)
    weight = np.where(labels > 0, rates[1], rates[0]) * copies
    use = np.ones(described.shape[1], bool)
    while True:  # more or stronger insults never lower a score
        fitted = fit_logistic(described * use, labels, weight)
        if (fitted[:-1] >= 0).all() or not use.any():
            break
        use &= fitted[:-1] >= 0
    machine.weights = tuple((fitted * np.append(use, True)).tolist())
    return machine


def toxic_windows(samples: list[tuple[str, int]], machine: Machine) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """Windows that toxic documents have and others lack and that hold no toxic word; frequent and other windows of clean documents; each with its documents."""
    counts = []
    texts = [[t or "" for t, label in samples if label == k] for k in (0, 1)]
    for some in texts:
        found = []
        for at in range(0, len(some), 64):
            stream = Stream(some[at : at + 64])
            hashes = stream.hashes()
            once = np.unique(hashes + stream.doc.astype(np.uint64) * np.uint64(STEP), return_index=True)[1]
            found.append(hashes[once])
        counts.append(np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64)))
    (clean, n_clean), (toxic, n_toxic) = counts
    share = max(len(texts[1]) / max(len(samples), 1), 1e-6)
    at = np.minimum(np.searchsorted(clean, toxic), max(len(clean) - 1, 0))
    of = n_toxic + (np.where(clean[at] == toxic, n_clean[at], 0) if len(clean) else 0)
    rate = n_toxic / of
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = of * (rate * np.log(rate / share) + np.where(rate < 1, (1 - rate) * np.log((1 - rate) / (1 - share)), 0))
    good = (n_toxic >= 2) & (rate > max(0.8, share)) & (bound > np.log(max(len(toxic), 1)) + np.log(2))
    by_count = np.argsort(-n_clean, kind="stable")
    step = max(1, (len(by_count) - HEAD) // TAIL)
    picked = np.sort(np.concatenate((by_count[:HEAD], by_count[HEAD::step])))
    out = []
    for some, keys, n in ((texts[1], toxic[good], n_toxic[good]), (texts[0], clean[picked], n_clean[picked])):
        named: dict[str, int] = {}
        for at in range(0, len(some), 64):
            stream = Stream(some[at : at + 64])
            hashes = stream.hashes()
            for k in np.flatnonzero(np.isin(hashes, keys)):
                if some is texts[0] or not stream.string(k) in named:
                    words = stream.words(k)
                    machine.learn(set(words))
                    if some is texts[0] or all(machine.cache[w] < HIT for w in words):
                        named[stream.string(k)] = int(n[np.searchsorted(keys, hashes[k])])
        out.append(sorted(named.items(), key=lambda s: (-s[1], s[0])))
    return out[0], out[1]


def train_windows(samples: list[tuple[str, int]], positive: list[str], machine: Machine) -> tuple[np.ndarray, float]:
    """The machine of windows: toxic words (however they are split) and toxic phrases against windows of clean documents."""
    phrases, clean = toxic_windows(samples, machine)
    words = [w for w in dict.fromkeys(INNER.sub("", w) for w in positive) if len(w) >= ORDER]
    support = dict.fromkeys(words, 100) | dict(phrases)
    toxic = [*support]
    documents = {w: n for w, n in clean if w not in support}
    if not toxic or not documents:
        return np.zeros(SLOTS, np.float32), -1.0
    landmarks = farthest_first([p for pair in zip_longest(words, (p for p, _ in phrases)) for p in pair if p], LANDMARKS, NARROW)
    texts = [t or "" for t, label in samples if not label]
    for again in (True, False):
        negative = [*documents]
        y = np.array([1.0] * len(toxic) + [-1.0] * len(negative))
        cost = np.concatenate((3 * np.sqrt([min(400, support[w]) for w in toxic]), np.sqrt([min(400, 1 + documents[w]) for w in negative])))
        table, bias = fit_table(toxic + negative, y, cost, landmarks, negative, NARROW)
        if again:  # the windows of all clean documents that look toxic are learned too
            for at in range(0, len(texts), 64):
                stream = Stream(texts[at : at + 64])
                for k in np.flatnonzero(stream.margins(table, bias) > -0.3):
                    if (w := stream.string(k)) not in support and len(documents) < 2 * (HEAD + TAIL):
                        documents[w] = documents.get(w, 0) + 3
    return table, bias


def fit_table(words: list[str], y: np.ndarray, cost: np.ndarray, landmarks: list[str], negative: list[str], span: int = SPAN, harder: int = HARDER) -> tuple[np.ndarray, float]:
    """Nystroem features and the machine on them, folded into a table of subsequences, and the bias."""
    landmarks = landmarks + negative[: 2 * CLEAN_LANDMARKS : 2]
    like = np.empty((len(words), 0), np.float32)
    for again in range(harder + 1):  # the clean words that look most toxic become landmarks too
        like = np.concatenate((like, kernel(words, landmarks[like.shape[1] :], span)), axis=1)
        inside = kernel(landmarks, landmarks, span).astype(float)
        values, vectors = np.linalg.eigh((inside + inside.T) / 2)
        keep = values > 1e-4
        root = vectors[:, keep] / np.sqrt(values[keep])  # K(L, L)^(-1/2) up to a rotation
        x = like @ root.astype(np.float32)
        w = fit_svm(x, y, cost)
        beta, bias = root @ w[:-1], float(w[-1])
        if again < harder:
            margin = x[y < 0] @ w[:-1] + bias
            known = set(landmarks)
            landmarks += [v for k in np.argsort(-margin) if (v := negative[k]) not in known][:CLEAN_LANDMARKS]
    table = np.zeros(SLOTS, np.float32)
    for n, rows in by_length(landmarks):
        if n >= ORDER:
            keys, weights, norms = features([landmarks[i] for i in rows], n, span)
            for k, i in enumerate(rows):
                np.add.at(table, keys[k], beta[i] * weights / norms[k])
    return table, bias


def held_out(doc_id) -> object:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[list[tuple[str, int]], tuple[float, float]]:
    """A bounded sample of labelled rows outside the held-out fold, by hash of the id, and what a row of each class stands for."""
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("__toxic")).where(F.col("__id").isNotNull() & F.col("__toxic").isin(0, 1) & ~held_out(F.col("__id")))
    usable = known.groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    count = {int(k): int(n) for k, n in usable.groupBy("__toxic").agg(F.count("*")).collect()}
    picks = [usable.where(F.col("__toxic") == k).orderBy(F.xxhash64("__id"), "__id").limit(most) for k, most in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    ids = F.broadcast(picks[0].union(picks[1]))  # at most MAX_TOXIC + MAX_CLEAN rows
    rows = identified(docs, id_col, text_col).join(ids, F.col("doc_id") == F.col("__id")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "__toxic")
    one = rows.groupBy("doc_id", "__toxic").agg(F.min(F.struct(F.length("text").alias("n"), F.xxhash64("text").alias("h"))).alias("k"))
    room = F.sum("k.n").over(Window.partitionBy(F.col("__toxic")).orderBy(F.xxhash64("doc_id"), "doc_id"))  # at most so many rows, no texts
    fits = one.withColumn("__sum", room).where(F.col("__sum") <= MAX_CHARS // 2).select(F.col("doc_id").alias("__d"), F.col("k.h").alias("__h"))
    texts = rows.join(F.broadcast(fits), (F.col("doc_id") == F.col("__d")) & (F.xxhash64("text") == F.col("__h"))).groupBy("doc_id", "__toxic").agg(F.min("text").alias("text"))
    found = sorted(texts.select("doc_id", "text", "__toxic").collect(), key=lambda r: (r[0], r[1]))
    sampled = Counter(r[2] for r in found)
    return [(r[1], r[2]) for r in found], tuple(count.get(k, 0) / max(1, sampled[k]) for k in (0, 1))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    session(docs)
    machine = train(*training_rows(docs, labels, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            scores = []
            texts = texts_of(batch["text"])
            for at in range(0, len(texts), 64):
                some = [words_in(t) for t in texts[at : at + 64]]
                more = fitted.window_hits(texts[at : at + 64])
                fitted.learn({w for words in some for w in words})
                scores += [fitted.score(*fitted.describe(words, hits)) for words, hits in zip(some, more, strict=True)]
            yield pa.record_batch([batch["doc_id"], pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = identified(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
