"""The thirteen built-in detectors as column expressions.

The patterns describe Python ``re`` semantics, so the classes are spelled out for the
JVM: ``\\w`` is letters, numbers and underscore of all scripts, ``\\d`` all decimal digits,
and each word boundary is written as the look-around it amounts to at that place. Every
detector is guarded by a cheaper test that each of its matches must satisfy.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from .offsets import MARK, NO_SPANS, marked_pieces, marker_free, spans_of_pieces, with_original_text
from .sql import Sql, array, keep, let, lit, struct, transform, when
from .text import DIGIT, SPACE, WORD, WORD_CHARS, is_ascii
from .validators import cuit_ok, luhn_ok, phone_ok

_NOT_AFTER_WORD = f"(?<!{WORD})"
_NOT_BEFORE_WORD = f"(?!{WORD})"
_BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
_LOCAL = r"[A-Za-z0-9._%+\-]"
# a leading word character needs a non-word before it, a leading ". % + -" a word one
_EMAIL_START = rf"(?:[A-Za-z0-9_](?<!{WORD}.)|[.%+\-](?<={WORD}.))"

# Priority of each label when two spans of equal length overlap.
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


def _has(*needles: str) -> Callable[[Sql], Sql]:
    return lambda text: " or ".join(f"contains({text}, {lit(n)})" for n in needles)


def _like(pattern: str) -> Callable[[Sql], Sql]:
    return lambda text: f"rlike({text}, {lit(pattern)})"


@dataclass(frozen=True)
class Detector:
    name: str
    label: str
    pattern: str
    guard: Callable[[Sql], Sql]
    # Java replacement that puts the marker around the reported part of the match
    marked: str = f"{MARK}$0{MARK}"
    valid: Callable[[Sql], Sql] | None = None
    # the guard needs a look only where the text has four digits close together
    numeric: bool = False


def _detectors(d: str) -> tuple[Detector, ...]:
    """The detectors for a digit class ``d``.

    A match that starts with a digit must not follow one. The look-behind comes after the
    first digit and covers both, so that nearly all positions fail on one character test.
    """
    octet = f"(?:25[0-5]|2[0-4]{d}|1?{d}?{d})"
    first = f"{d}(?<!{d}{d})"
    # The patterns. Order is the order in which spans are emitted.
    return (
        Detector(
            "email",
            "EMAIL",
            # All starts within a run of local characters end at the same place, so they succeed or fail together:
            # a long run that fails is taken as a whole and dropped again, and is not read once for each start.
            rf"{_EMAIL_START}{_LOCAL}*+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}{_NOT_BEFORE_WORD}|{_EMAIL_START}{_LOCAL}{{100,}}+",
            _has("@"),
            valid=lambda x: f"contains({x}, '@')",
        ),
        Detector(
            "url",
            "URL",
            rf"(?iu){_NOT_AFTER_WORD}(?:https?://|www\.)[^{SPACE}<>()\[\]{{}}\x22\x27]+",
            # "://" needs no letter, "www." is looked for in any case
            lambda t: f"contains({t}, '://') or rlike({t}, {lit(r'[wW][wW]{2}[.]')})",
        ),
        Detector(
            "ipv4",
            "IPV4",
            rf"(?={d}){_NOT_AFTER_WORD}(?:{octet}\.){{3}}{octet}{_NOT_BEFORE_WORD}",
            _like(rf"{d}\.{d}{{1,3}}\.{d}"),
            numeric=True,
        ),
        Detector(
            "secret_prefixed",
            "SECRET",
            rf"[spr](?<!{WORD}.)k-[A-Za-z0-9]{{16,}}{_NOT_BEFORE_WORD}",
            _has("sk-", "pk-", "rk-"),
        ),
        Detector(
            "secret_cloud",
            "SECRET",
            rf"A(?<!{WORD}.)KIA[0-9A-Z]{{16}}{_NOT_BEFORE_WORD}",
            _has("AKIA"),
        ),
        Detector(
            "secret_forge",
            "SECRET",
            rf"g(?<!{WORD}.)h[pousr]_[A-Za-z0-9]{{20,}}{_NOT_BEFORE_WORD}",
            _has("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
        ),
        Detector(
            "secret_chat",
            "SECRET",
            rf"x(?<!{WORD}.)ox[baprs]-[A-Za-z0-9\-]{{10,}}{_BOUNDARY}",
            _has("xox"),
        ),
        Detector(
            "card",
            "CREDIT_CARD",
            rf"{first}[ \-]?(?:{d}[ \-]?){{12,18}}(?!{d})",
            _like(rf"{d}(?:[ \-]?{d}){{12}}"),
            valid=luhn_ok,
            numeric=True,
        ),
        Detector(
            "phone",
            "PHONE",
            rf"(?=[+({d[1:-1]}])(?<![{WORD_CHARS}.])(?:\+?{d}{{1,3}}[ .\-]?)?(?:\({d}{{1,4}}\)[ .\-]?)?"
            rf"{d}{{2,4}}(?:[ .\-]{d}{{2,4}}){{1,4}}{_NOT_BEFORE_WORD}",
            _like(rf"{d}{d}[ .\-]{d}{d}"),
            valid=phone_ok,
            numeric=True,
        ),
        Detector(
            "cuit",
            "AR_CUIT",
            rf"{first}{d}[ \-]?{d}{{8}}[ \-]?{d}(?!{d})",
            _like(rf"{d}{d}[ \-]?{d}{{8}}[ \-]?{d}"),
            valid=cuit_ok,
            numeric=True,
        ),
        Detector(
            "cbu",
            "AR_CBU",
            rf"{first}{d}{{21}}(?!{d})",
            _like(rf"{d}{d}{{21}}"),
            numeric=True,
        ),
        Detector(
            "dni_dotted",
            "AR_DNI",
            rf"{first}{d}?\.{d}{{3}}\.{d}{{3}}(?!{d})",
            _like(rf"{d}\.{d}{{3}}\.{d}{{3}}"),
            numeric=True,
        ),
        Detector(
            "dni_context",
            "AR_DNI",
            rf"(?iu)({_NOT_AFTER_WORD}(?:dni|d\.n\.i\.?|documento){_BOUNDARY}[{SPACE}:n°º\-]*)"
            rf"({d}{{1,2}}\.?{d}{{3}}\.?{d}{{3}}|{d}{{7,8}})",
            _like(r"[dD](?iu:ni|\.n\.i|ocumento)"),
            marked=f"$1{MARK}$2{MARK}",
            numeric=True,
        ),
    )


# Nearly all texts have no digits but 0 to 9, and those are much cheaper to look for.
DETECTORS = _detectors("[0-9]")
WIDE_DETECTORS = _detectors(DIGIT)
_OTHER_DIGIT = rf"[{DIGIT}&&[^0-9]]"


def _four_digits(d: str) -> str:
    """Any match of a numeric detector has four digits with at most one separator between two."""
    return rf"{d}(?:[ .\-]?{d}){{3}}"


def raw_spans(text: Sql, only: tuple[str, ...] | None = None, guarded: bool = True) -> Sql:
    """Spans of the chosen detectors in emission order, overlaps included.

    ``text`` must be bound. ``guarded=False`` drops the cheap tests; it exists so that a
    test can show that they never change a result.
    """

    def pieces(d: Detector, t: Sql, digits: Sql) -> Sql:
        found = struct(label=lit(d.label), pieces=marked_pieces(t, d.pattern, d.marked))
        if not guarded:
            return found
        test = f"{digits} and ({d.guard(t)})" if d.numeric else d.guard(t)
        return f"case when {test} then {found} end"

    def hits(detectors: tuple[Detector, ...], digit: str, t: Sql) -> Sql:
        chosen = [d for d in detectors if only is None or d.label in only]

        def scan(digits: Sql) -> Sql:
            return array(pieces(d, t, digits) for d in chosen)

        if not any(d.numeric for d in chosen):
            return scan("true")
        return let(f"rlike({t}, {lit(_four_digits(digit))})", scan)

    def scan(t: Sql) -> Sql:
        wide = f"not ({is_ascii(t)}) and rlike({t}, {lit(_OTHER_DIGIT)})"
        found = when(wide, hits(WIDE_DETECTORS, DIGIT, t), hits(DETECTORS, "[0-9]", t))
        return f"flatten({transform(keep(found, lambda h: f'size({h}.pieces) > 1'), _valid_spans)})"

    return with_original_text(let(marker_free(text), scan), text)


def _valid_spans(hit: Sql) -> Sql:
    checks = {d.label: d.valid for d in DETECTORS if d.valid is not None}

    def valid(s: Sql) -> Sql:
        cases = " ".join(f"when {lit(label)} then {check(f'{s}.text')}" for label, check in checks.items())
        return f"case {s}.label {cases} else true end"

    return keep(spans_of_pieces(f"{hit}.pieces", f"{hit}.label"), valid)


def detect_label(text: Sql, label: str) -> Sql:
    """One label's spans, before propagation and overlap resolution."""
    return let(text, lambda t: when(f"{t} is null", NO_SPANS, raw_spans(t, (label,))))
