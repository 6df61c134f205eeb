"""Text helpers whose results must agree with Python's ``str`` methods."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from .sql import Sql, let, lit, when

# The code points for which Python's str.isspace() is true.
SPACE_POINTS = (
    *range(0x09, 0x0E),
    *range(0x1C, 0x21),
    0x85,
    0xA0,
    0x1680,
    *range(0x2000, 0x200B),
    0x2028,
    0x2029,
    0x202F,
    0x205F,
    0x3000,
)
PY_SPACE = "".join(map(chr, SPACE_POINTS))
# Python's \s (as the inside of a character class), \w and \d for the JVM.
SPACE = "".join(rf"\x{{{cp:X}}}" for cp in SPACE_POINTS)
# The letter and the digit written out belong to the classes anyway: Java steps back by whole
# code points in a look-behind only where the pattern holds a character beyond U+FFFF.
WORD_CHARS = r"\p{L}\p{N}_𐐨"
WORD = f"[{WORD_CHARS}]"
DIGIT = r"[\p{Nd}𝟎]"

HYPHEN_BREAK = r"-[ \t]*\n[ \t]*"


def normalize_text(text: Sql) -> Sql:
    """Rejoin words and identifiers that a hyphen plus line break split in two."""
    return when(f"contains({text}, '\n')", f"regexp_replace({text}, {lit(HYPHEN_BREAK)}, '-')", text)


def strip(text: Sql) -> Sql:
    return f"trim(BOTH {lit(PY_SPACE)} FROM {text})"


def is_blank(text: Sql) -> Sql:
    return f"length({strip(text)}) = 0"


def is_ascii(text: Sql) -> Sql:
    return f"octet_length({text}) = char_length({text})"


@cache
def _decimal_digits() -> tuple[str, str]:
    """All non-ASCII decimal digits and the ASCII digit each one stands for."""
    digits = "".join(ch for ch in map(chr, range(0x80, sys.maxunicode + 1)) if ch.isdecimal())
    return digits, "".join(str(unicodedata.decimal(ch)) for ch in digits)


def only_digits(text: Sql) -> Sql:
    return f"regexp_replace({text}, {lit(r'\P{Nd}+')}, '')"


def ascii_digits(text: Sql) -> Sql:
    """The decimal digits of ``text`` as ASCII, everything else dropped."""
    source, target = _decimal_digits()
    return let(
        only_digits(text), lambda d: when(is_ascii(d), d, f"translate({d}, {lit(source)}, {lit(target)})")
    )
