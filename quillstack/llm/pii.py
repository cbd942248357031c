"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, URL schemes, and cues of identifiers (IBAN, SSN, account words, names of credentials).
Each anchor starts a deterministic parser that expands to the boundaries of what may stand there and validates it: email address,
IPv4 address, payment card (Luhn), telephone number; and, beyond the base kinds, IBAN (mod 97), social security number, account number
after its cue, credentials inside a URL, and the value that a credential's name (password, token, key) gives or an access key's own prefix opens.

A parser never reads what an earlier match of its kind has consumed, so base kinds are leftmost and non-overlapping exactly as
the patterns of the contract say (tests hold them against these patterns).

Defined cases: null text is empty; texts are scanned whole; rows that repeat a doc_id are scanned each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import identified, session, texts_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "account", "login", "credential")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[\x20:#=]*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
SSN = re.compile(r"[\x20:#=]*((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9-])")
ACCOUNT = re.compile(r"(?:\x20?(?:number|no\.?|nr\.?|#))?[\x20:#=]{1,3}([0-9](?:[\x20-]?[0-9]){5,19})(?![0-9])", re.IGNORECASE)
LOGIN = re.compile(r"([^\s/@:]+:[^\s/@]+)@[A-Za-z0-9.-]+")
CREDENTIAL = re.compile(r"""["']?\x20{0,8}[:=]\x20{0,8}["']?([A-Za-z0-9+/_.=-]{8,})""")
ACCESS = re.compile(r"[A-Z0-9]{12,}")
CUES = {"iban": ("IBAN", "Iban", "iban"), "ssn": ("SSN", "ssn"), "account": ("account", "Account", "acct", "Acct", "Konto", "konto", "cuenta", "compte"), "login": ("://",), "credential": tuple(f(w) for w in ("password", "passwd", "secret", "token", "api_key", "apikey") for f in (str, str.upper, str.capitalize)), "access": ("AKIA",)}


@cache
def anchors() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for digit in "0123456789":
        automaton.add_word(digit, "digit")
    automaton.add_word("@", "at")
    automaton.add_word("+", "plus")
    for kind, cues in CUES.items():
        for cue in cues:
            automaton.add_word(cue, kind)
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by kind as listed, then start."""
    found: list[tuple[int, int, str]] = []
    email_end = ip_end = card_end = phone_end = 0
    for at, kind in anchors().iter(text):
        if kind == "digit":
            if at >= ip_end:
                chain = DOTTED.match(text, at)
                ip_end = chain.end()
                if chain[0].count(".") >= 3:
                    parts, place = chain[0].split("."), at
                    for k in range(0, len(parts) - 3, 4):
                        size = sum(map(len, parts[k : k + 4])) + 3
                        if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if not p.strip("0") else p.lstrip("0")) <= 255 for p in parts[k : k + 4]):
                            found.append((place, place + size, "ip"))
                        place += size + 1
            if at >= card_end:
                chain = DIGITS.match(text, at)
                card_end = chain.end() if chain else at + 1
                if chain and card_end - at >= 16:
                    digits = _digits(chain[0])
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found.append((at, card_end, "card"))
        elif kind == "at":
            start = at
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            domain = DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                email_end = domain.end()
                found.append((start, email_end, "email"))
        elif kind == "plus":
            if at >= phone_end and (number := DIALLED.match(text, at)):
                phone_end = number.end()
                if 8 <= len(_digits(number[0])) <= 15:
                    found.append((at, phone_end, "phone"))
        elif kind == "iban":
            if (m := IBAN.match(text, at + 1)) and _iban(m[1]):
                found.append((*m.span(1), "iban"))
        elif kind == "ssn":
            if m := SSN.match(text, at + 1):
                found.append((*m.span(1), "ssn"))
        elif kind == "account":
            if m := ACCOUNT.match(text, at + 1):
                found.append((*m.span(1), "account"))
        elif kind == "credential":
            if m := CREDENTIAL.match(text, at + 1):
                found.append((*m.span(1), "credential"))
        elif kind == "access":
            if m := ACCESS.match(text, at + 1):
                found.append((at - 3, m.end(), "credential"))
        elif m := LOGIN.match(text, at + 1):
            found.append((*m.span(1), "login"))
    return sorted(found, key=lambda s: (KINDS.index(s[2]), s[0]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), texts_of(batch["text"]), strict=True):
            spans = find(text)
            base = [s for s in spans if s[2] in BASE_KINDS]
            rows.append((doc_id, *(sum(s[2] == kind for s in base) for kind in BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base), len(spans)))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        columns = [*zip(*rows, strict=True)] or [()] * 9
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_other", "n_all"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_other (added spans), n_all."""
    session(docs)
    return identified(docs, id_col, text_col).mapInArrow(_scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_other long, n_all long")
