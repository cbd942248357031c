"""Byte-level BPE ids of a ``tokenizers`` file, remembered by pre-token.

The file's pre-tokenizer splits a text by one pattern and the model encodes each part on its own, so the ids of a text are
those of its parts in a row; parts recur, so most come from a table. New parts are merged by rank, where the file's merges are in the
order of their ids (that is checked), else encoded by the library. Texts with a special token's string, or with characters whose class
may differ between Unicode versions, go to the library whole.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import regex

PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Latin, Greek and Cyrillic letters, general punctuation and CJK ideographs: classes that no Unicode version changed.
UNSETTLED = regex.compile(r"[^\x00-ͷЀ-҂Ҋ-ԯ‐-‧‰-⁞€™ぁ-ゖァ-ヺ一-龥]")


def _byte_names() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def _ranked(model: dict):
    """Function from the bytes of a part to its ids, if the file's merges are in the order of their ids; else None."""
    vocabulary = model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    first = len(_byte_names())
    if model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("ignore_merges") or any(vocabulary.get(a + b) != first + k for k, (a, b) in enumerate(pairs)):
        return None
    import tiktoken

    names = _byte_names()
    ranks = {bytes(names[c] for c in token): i for token, i in vocabulary.items() if i < first + len(pairs) and all(c in names for c in token)}
    if len(ranks) != first + len(pairs) or any(len(t) == 1 and i >= first for t, i in ranks.items()):
        return None
    return tiktoken.Encoding("parts", pat_str=".", mergeable_ranks=ranks, special_tokens={})._encode_single_piece


@cache
def cache_of(path: str) -> PieceCache:
    """A worker's table, over all of its tasks."""
    return PieceCache(path)


class PieceCache(dict):
    """Pre-token to the little-endian 32-bit bytes of its ids."""

    def __init__(self, path: str, limit: int = 1 << 19, longest: int = 64):
        super().__init__()
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kind = spec.get("pre_tokenizer") or {}
        plain = kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and not spec.get("normalizer")
        self.special = [t["content"] for t in spec.get("added_tokens") or ()]
        self.limit, self.longest, self.plain = limit, longest, bool(plain)
        self.merge = _ranked(spec["model"])

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        ids = np.array(self.merge(part.encode()), dtype="<u4").tobytes() if self.merge else self.whole(part)
        if len(part) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[part] = ids
        return ids

    def packed(self, text: str) -> bytes:
        """Ids of a text, little-endian, 32 bits each."""
        if not self.plain or UNSETTLED.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.__getitem__, PATTERN.findall(text)))
