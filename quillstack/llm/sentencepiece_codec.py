"""SentencePiece encoding and decoding from a model file.

An Aho-Corasick automaton over the pieces reads a text once. At each position it stands at the longest piece-prefix that ends
there; following output links gives every piece that ends there, longest first, and each relaxes the best path of the position.
What "best" means is the model's: for a unigram model the largest sum of scores, relaxed at each position; for a BPE model the one segmentation that
the merges produce, which is the path in which every two neighbours stay apart when merged on their own (pieces' scores order the
merges). No sum of scores has that path as its best, so for BPE models (the registered query's is one) the relaxation is replaced: the first
match, longest first, that stays apart from the piece before it is the position's. Characters that no piece covers become byte pieces, or the unknown piece.

White space never joins what stands before it to it (no piece has the marker after another character; the model is asked), so
a text is encoded part by part and parts are remembered.

Defined cases: null and empty texts have no ids and decode to the empty text; texts of any length are encoded whole; rows that repeat a doc_id are
encoded each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import identified, received, send_file, session, texts_of

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""
    at, end = 0, len(blob)

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = blob[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    while at < end:
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            size, at = varint(at)
            value, at = blob[at : at + size], at + size
        else:
            size = 8 if tag & 7 == 1 else 4
            value, at = blob[at : at + size], at + size
        yield tag >> 3, value


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str, limit: int = 1 << 19):
        with open(path, "rb") as file:
            blob = file.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.model, self.prefix, self.squeeze = UNIGRAM, True, True
        for number, value in _fields(blob):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.model = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("a model with a normalization table isn't supported")
                self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if self.model not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.model} isn't supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.letters = frozenset(p for p in self.ids if len(p) == 1)
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self.model == UNIGRAM or self._stands(i):  # the merges never end in the others
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.together: dict[int, bool] = {}
        self.penalty = min(self.scores[i] for i in self.ids.values()) - 10
        whole = not any(MARK in p.lstrip(MARK) for p in self.ids)
        alone = "" if any("\n" in p for p in self.ids) else "\n"  # a line end that no piece holds parts the text as well
        self.parts = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + f"|{alone}" * bool(alone) if whole else "(?s).+")
        self.cache: dict[str, bytes] = {}
        self.limit = limit
        self.apart = lru_cache(1 << 18)(self._apart)
        self.history = lru_cache(1 << 16)(self._history)

    def normalized(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if text and self.prefix:
            text = " " + text
        return text.replace(" ", MARK)

    def _merged(self, text: str) -> list[int]:
        """Ids by doing the merges: the highest score first, leftmost among equals."""
        symbols = list(text)
        while True:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                i = self.ids.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                return [self.ids.get(s, -1) for s in symbols]
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def _history(self, piece: int | str) -> tuple[list[float], list[str], list[str]]:
        """Merges of a piece's own text: their scores in order, and its first and its last symbol before each and at the end."""
        symbols = list(self.pieces[piece]) if isinstance(piece, int) else [piece]
        scores, firsts, lasts = [], [symbols[0]], [symbols[-1]]
        while True:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                i = self.ids.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                return scores, firsts, lasts
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            scores.append(best)
            firsts.append(symbols[0])
            lasts.append(symbols[-1])

    def _apart(self, left: int | str, right: int | str) -> bool:
        """Whether two pieces in a row are what the merges make of their text: the pieces' own merges, highest score first and leftmost among
        equals, are replayed until one across the boundary comes first, or none is left."""
        own, _, lasts = self.history(left)
        other, firsts, _ = self.history(right)
        i = j = 0
        none = -np.inf
        while True:
            across = self.ids.get(lasts[i] + firsts[j])
            b = self.scores[across] if across is not None else none
            a = own[i] if i < len(own) else none
            c = other[j] if j < len(other) else none
            if a == b == c == none:
                return True
            if a >= b and a >= c:
                i += 1
            elif b >= c:
                return False
            else:
                j += 1

    def _viterbi(self, text: str) -> list[int | str]:
        """The best path as ids, and characters that no piece covers."""
        n = len(text)
        if self.model == BPE and self.letters.issuperset(text):
            return self._merged_path(text)
        last: list[int | str | None] = [None] * (n + 1)  # the piece that ends here on the best path
        came = [0] * (n + 1)
        score = [0.0] + [-np.inf] * n
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for end, found in self.automaton.iter(text):  # in order of position, output links from the longest piece on
            ends[end + 1].append(found)
        unigram = self.model == UNIGRAM
        for at in range(1, n + 1):
            if unigram:
                for i, size in ends[at]:
                    if (value := score[at - size] + self.scores[i]) > score[at]:
                        score[at], last[at], came[at] = value, i, at - size
                if not any(size == 1 for _, size in ends[at]) and (value := score[at - 1] + self.penalty) > score[at]:
                    score[at], last[at], came[at] = value, text[at - 1], at - 1
                continue
            for i, size in ends[at]:
                before = at - size
                if before and (last[before] is None or not self.apart(last[before], i)):
                    continue
                last[at], came[at] = i, before
                break
            else:
                if text[at - 1] not in self.ids and (at == 1 or last[at - 1] is not None):
                    last[at], came[at] = text[at - 1], at - 1
        path: list[int | str] = []
        at = n
        while at:
            path.append(last[at])
            at = came[at]
        return path[::-1]

    def _merged_path(self, text: str) -> list[int]:
        """The pass over a text whose characters are all pieces: matches come by position, longest first, and the first that fits is it."""
        n = len(text)
        last, came = [-1] * (n + 1), [0] * (n + 1)
        together = self.together
        if len(together) > 1 << 20:
            together.clear()
        for end, (i, size) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                before = end - size
                if before:
                    left = last[before]
                    if left < 0:
                        continue
                    pair = left << 20 | i
                    fits = together.get(pair)
                    if fits is None:
                        fits = together[pair] = self._apart(left, i)
                    if not fits:
                        continue
                last[end], came[end] = i, before
        path, at = [], n
        while at:
            path.append(last[at])
            at = came[at]
        return path[::-1]

    def _stands(self, i: int) -> bool:
        """Whether the merges of a piece's own text end in this piece."""
        return self._merged(self.pieces[i]) == [i]

    def _encode_part(self, part: str) -> bytes:
        ids: list[int] = []
        for step in self._viterbi(part):
            if isinstance(step, int):
                ids.append(step)
            elif self.bytes:
                ids += [self.bytes[b] for b in step.encode()]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return np.array(ids, dtype="<u4").tobytes()

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        cache, out = self.cache, []
        for part in self.parts.findall(self.normalized(text)):
            ids = cache.get(part)
            if ids is None:
                ids = self._encode_part(part)
                if len(part) <= 64:
                    if len(cache) >= self.limit:
                        cache.clear()
                    cache[part] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        out: list[bytes] = []
        for i in ids:
            if self.kinds[i] == BYTE:
                out.append(bytes([int(self.pieces[i][3:5], 16)]))
            elif self.kinds[i] == UNKNOWN:
                out.append(" ⁇ ".encode())
            elif self.kinds[i] != CONTROL:
                out.append(self.pieces[i].encode())
        text = b"".join(out).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@cache
def codec_of(path: str) -> Codec:
    """A worker's codec, with what it remembers, over all of its tasks."""
    return Codec(path)


def _round_trip(name: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(received(name))
        table = [codec.decode([i]).encode() if codec.kinds[i] not in (NORMAL, USER, BYTE) else bytes([int(p[3:5], 16)]) if codec.kinds[i] == BYTE else p.replace(MARK, " ").encode() for i, p in enumerate(codec.pieces)]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), texts_of(batch["text"]), strict=True):
                ids = codec.packed(text)
                numbers = np.frombuffer(ids, "<u4").tolist()
                back = b"".join([table[i] for i in numbers])
                back = back[1:] if codec.prefix and back.startswith(b" ") else back
                rows.append((doc_id, len(numbers), zlib.crc32(ids), back == text.encode(), zlib.crc32(back), *([numbers] if with_ids else [])))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int32())][: 5 + with_ids]
            columns = [*zip(*rows, strict=True)] or [()] * len(types)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "n_tokens", "ids_crc32", "round_trip", "decoded_crc32", "ids"][: 5 + with_ids])

    return run


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_crc32 (little-endian 32-bit ids), whether they decode to the text, decoded_crc32, ids if asked for."""
    session(docs)
    schema = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, decoded_crc32 long" + ", ids array<int>" * with_ids
    return identified(docs, id_col, text_col).mapInArrow(_round_trip(send_file(docs.sparkSession, model), with_ids), schema)
