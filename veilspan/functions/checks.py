"""Checksum tests on candidate values."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from veilspan.functions.sqltext import let, words_of

# --- fixed values: checksum weights --------------------------------------
SNILS_WEIGHTS = [9, 8, 7, 6, 5, 4, 3, 2, 1]
INN10_WEIGHTS = [2, 4, 10, 3, 5, 9, 4, 6, 8]
INN12_FIRST_WEIGHTS = [7, 2, 4, 10, 3, 5, 9, 4, 6, 8]
INN12_SECOND_WEIGHTS = [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]


@lru_cache(maxsize=1)
def _digit_alphabet() -> tuple[str, str]:
    """Decimal digits outside ASCII and the ASCII digit each stands for."""
    others = [
        c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"
    ]
    return "".join(others), "".join(str(unicodedata.decimal(c)) for c in others)


def digit_string(value: str) -> str:
    """The decimal digits of a value, in ASCII."""
    source, target = _digit_alphabet()
    translated = (
        f"case when octet_length({value}) > char_length({value}) "
        f"then translate({value}, '{source}', '{target}') else {value} end"
    )
    return f"regexp_replace({translated}, '[^0-9]', '')"


def _digit(at: int) -> str:
    return f"(ascii(substr(d, {at + 1}, 1)) - 48)"


def _dot(weights: list[int]) -> str:
    """Weighted sum over the first digits."""
    return "(" + " + ".join(f"{_digit(i)} * {w}" for i, w in enumerate(weights)) + ")"


def luhn_ok(value: str) -> str:
    """Exactly 16 digits that pass the Luhn test."""

    def term(at: int) -> str:
        digit = _digit(at)
        # With 16 digits the ones to double stand at even places from the left.
        doubled = f"(case when {digit} > 4 then {digit} * 2 - 9 else {digit} * 2 end)"
        return digit if at % 2 else doubled

    total = " + ".join(term(i) for i in range(16))
    return let(
        "d", digit_string(value), f"case when length(d) = 16 then ({total}) % 10 = 0 else false end"
    )


def snils_ok(value: str) -> str:
    """Eleven digits whose last two are the control number.

    A remainder of 100 is compared as 100, so it can never match two digits.
    """
    expected = "case when t < 100 then t when t in (100, 101) then 0 else t % 101 end"
    control = f"{_digit(9)} * 10 + {_digit(10)}"
    same = let("t", _dot(SNILS_WEIGHTS), f"{expected} = {control}")
    return let(
        "d", digit_string(value), f"case when length(d) = 11 then {same} else false end"
    )


def inn_ok(value: str) -> str:
    """Ten digits with one control digit or twelve with two."""

    def control(weights: list[int], at: int) -> str:
        return f"{_dot(weights)} % 11 % 10 = {_digit(at)}"

    return let(
        "d",
        digit_string(value),
        f"case when length(d) = 10 then {control(INN10_WEIGHTS, 9)} "
        f"when length(d) = 12 then {control(INN12_FIRST_WEIGHTS, 10)} "
        f"and {control(INN12_SECOND_WEIGHTS, 11)} else false end",
    )


def full_name_ok(value: str) -> str:
    """At least two words, each of two letters or more."""
    return let(
        "ws", words_of(value), "size(ws) >= 2 and forall(ws, w -> char_length(w) >= 2)"
    )


_CHECKS = {
    "bank_card": luhn_ok,
    "snils": snils_ok,
    "inn": inn_ok,
    "fio": full_name_ok,
}


def check_for(category: str):
    """The test of a category, or None when every candidate is accepted."""
    return _CHECKS.get(category)


def value_ok(category: str, value: str) -> str:
    """Dispatch over a findings table."""
    arms = " ".join(f"when '{name}' then {test(value)}" for name, test in _CHECKS.items())
    return f"case {category} {arms} else true end"
