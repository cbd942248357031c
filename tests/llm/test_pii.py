from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quillstack.llm.pii import BASE_KINDS, find, luhn, scan

from .helpers import awkward, frame

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "x@y.z", "1", "25", "255", "256", "000", "1.2.3.4", "-", " ", "+", "+49 30 ", "(0)", "4111111111111111", "4111 1111", "é", "_", "%", "@a.b"]), max_size=14))
def test_base_kinds_are_the_patterns(parts):
    text = "".join(parts)
    assert [s for s in find(text) if s[2] in BASE_KINDS] == plain(text)


def test_more_kinds():
    text = "IBAN: DE89 3704 0044 0532 0130 00, iban DE89370400440532013001. SSN 123-45-6789 ssn 000-12-3456 account number: 12345678 https://user:pw@host.example/x"
    assert [(k, text[a:b]) for a, b, k in find(text) if k not in BASE_KINDS] == [("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789"), ("account", "12345678"), ("login", "user:pw")]


MORE = {
    "iban": r"(?:IBAN|Iban|iban)[\x20:#=]*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])",
    "ssn": r"(?:SSN|ssn)[\x20:#=]*((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9-])",
    "credential": r"""(?:password|passwd|secret|token|api_key|apikey|PASSWORD|PASSWD|SECRET|TOKEN|API_KEY|APIKEY|Password|Passwd|Secret|Token|Api_key|Apikey)["']?\x20{0,8}[:=]\x20{0,8}["']?([A-Za-z0-9+/_.=-]{8,})|(AKIA[A-Z0-9]{12,})""",
}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["IBAN", "iban: ", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "SSN ", "ssn#", "123-45-6789", "900-12-3456", "token", "Password", "=", ": ", '"', "longvalue12", "x", " ", "AKIA", "ABCDEFGH0123"]), max_size=10))
def test_added_kinds_are_their_patterns(parts):
    text = "".join(parts)
    for kind, pattern in MORE.items():
        want = set()
        for k in range(len(text)):
            if m := re.compile(pattern).match(text, k):
                at = 1 if m[1] else 2
                plain_ = m[at].replace(" ", "")
                if kind != "iban" or 15 <= len(plain_) <= 34 and int("".join(str(int(c, 36)) for c in plain_[4:] + plain_[:4])) % 97 == 1:
                    want.add((*m.span(at), kind))
        assert {s for s in find(text) if s[2] == kind} == want, kind


def test_documents(spark):
    rows = awkward() + [(900, "mail a.b@c.example +1 (706) 555-3138, 10.0.0.1, 4644 3483 9801 0899"), (901, "1" * 5000)]
    got = scan(frame(spark, rows)).collect()
    want = sorted((str(i), hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in plain(t or "")).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    r = next(r for r in got if r.doc_id == 900)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, int(luhn("4644348398010899")), 1)
    assert r.n_other == 0 and r.n_all == 3 + int(luhn("4644348398010899"))
    assert scan(frame(spark, [])).count() == 0
