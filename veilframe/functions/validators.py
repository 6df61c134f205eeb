"""Check-digit and length rules applied to candidate matches."""

from __future__ import annotations

from .sql import Sql, let, when
from .text import ascii_digits, only_digits

# The mod-11 weights of the Argentine tax number.
CUIT_WEIGHTS = (5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
MIN_CARD_DIGITS = 13
MIN_PHONE_DIGITS = 7


def luhn_ok(text: Sql) -> Sql:
    """Luhn checksum over the digits of ``text``; at least 13 digits are needed."""

    return let(ascii_digits(text), lambda d: f"length({d}) >= {MIN_CARD_DIGITS} and luhn_check({d})")


def cuit_ok(text: Sql) -> Sql:
    """Mod-11 check digit over exactly 11 digits."""

    def check(digits: Sql) -> Sql:
        weighted = (f"{w} * (ascii(substring({digits}, {i}, 1)) - 48)" for i, w in enumerate(CUIT_WEIGHTS, 1))
        return let(
            f"({' + '.join(weighted)}) % 11",
            lambda rest: f"case {rest} when 0 then 0 when 1 then 9 else 11 - {rest} end = int(right({digits}, 1))",
        )

    return let(ascii_digits(text), lambda d: when(f"length({d}) <> 11", "false", check(d)))


def phone_ok(text: Sql) -> Sql:
    return f"length({only_digits(text)}) >= {MIN_PHONE_DIGITS}"
