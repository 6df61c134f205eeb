"""The rules once more in plain Python, one text at a time, for comparison in tests."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata

# The patterns in Python's dialect, in emission order.
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = [
    ("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("URL", r"(?i)\b(?:https?://|www\.)[^\s<>()\[\]{}\"']+"),
    ("IPV4", rf"\b(?:{OCTET}\.){{3}}{OCTET}\b"),
    ("SECRET", r"\b(?:sk|pk|rk)-[A-Za-z0-9]{16,}\b"),
    ("SECRET", r"\bAKIA[0-9A-Z]{16}\b"),
    ("SECRET", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b"),
    ("SECRET", r"\bxox[baprs]-[A-Za-z0-9\-]{10,}\b"),
    ("CREDIT_CARD", r"(?<!\d)(?:\d[ \-]?){13,19}(?!\d)"),
    (
        "PHONE",
        r"(?<![\w.])(?:\+?\d{1,3}[ .\-]?)?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]\d{2,4}){1,4}(?![\w])",
    ),
    ("AR_CUIT", r"(?<!\d)(\d{2})[ \-]?(\d{8})[ \-]?(\d)(?!\d)"),
    ("AR_CBU", r"(?<!\d)\d{22}(?!\d)"),
    ("AR_DNI", r"(?<!\d)\d{1,2}\.\d{3}\.\d{3}(?!\d)"),
    ("AR_DNI", r"(?i)\b(?:dni|d\.n\.i\.?|documento)\b[\s:n°º\-]*(?P<it>(?:\d{1,2}\.?\d{3}\.?\d{3})|\d{7,8})"),
]
# Priority of each label.
PRIORITY = {
    "AR_CBU": 60,
    "AR_CUIT": 55,
    "SECRET": 50,
    "AR_DNI": 45,
    "CREDIT_CARD": 40,
    "EMAIL": 35,
    "IPV4": 25,
    "URL": 20,
    "PHONE": 10,
}


def digits_of(text):
    return [unicodedata.decimal(c) for c in text if c.isdecimal()]


def luhn(text):
    d = digits_of(text)[::-1]
    return len(d) >= 13 and sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def cuit(text):
    d = digits_of(text)
    if len(d) != 11:
        return False
    rest = sum(a * b for a, b in zip(d, (5, 4, 3, 2, 7, 6, 5, 4, 3, 2))) % 11
    return d[10] == {0: 0, 1: 9}.get(rest, 11 - rest)


VALID = {"CREDIT_CARD": luhn, "PHONE": lambda t: len(digits_of(t)) >= 7, "AR_CUIT": cuit}


def raw(text):
    found = []
    for label, pattern in PATTERNS:
        group = "it" if "?P<it>" in pattern else 0
        for m in re.finditer(pattern, text):
            if VALID.get(label, bool)(m[0]):
                found.append((label, m.start(group), m.end(group), m[group]))
    return found


def resolve(found, priority):
    order = sorted(range(len(found)), key=lambda i: (found[i][1] - found[i][2], -priority.get(found[i][0], 0), found[i][1], i))
    taken = []
    for i in order:
        _, start, end, _ = found[i]
        if start < end and all(end <= s or e <= start for _, s, e, _ in taken):
            taken.append(found[i])
    return sorted(taken, key=lambda span: span[1])


def propagate(text, found):
    first = {}
    for label, _, _, value in found:
        first.setdefault(value, label)
    more = []
    for value, label in first.items():
        if len(value.strip()) >= 4:
            more += [(label, m.start(), m.end(), value) for m in re.finditer(re.escape(value), text)]
    return found + more


def finalize(text, found, priority=PRIORITY):
    return resolve(propagate(text, found), priority)


def detect(text):
    return finalize(text, raw(text))


def hmac_token(key, text):
    return hmac.new(key, text.strip().lower().encode(), hashlib.sha256).hexdigest()[:16]
