"""Masked forms of found values."""

from __future__ import annotations

from veilspan.functions.sqltext import let, words_of

IDENTIFIER_CATEGORIES = ("phone", "bank_card", "snils", "inn", "passport")


def mask_full_name(value: str) -> str:
    """First word and the initial of the second; a lone word keeps its first letter."""
    lone = (
        f"concat(substr({value}, 1, 1), repeat('*', greatest(char_length({value}) - 1, 0)))"
    )
    short = "concat(ws[0], ' ', substr(ws[1], 1, 1), '.')"
    return let("ws", words_of(value), f"case when size(ws) >= 2 then {short} else {lone} end")


def mask_identifier(value: str) -> str:
    """Three characters at each end, stars between; short values vanish."""
    size = f"char_length({value})"
    return (
        f"case when {size} > 6 then "
        f"concat(left({value}, 3), repeat('*', {size} - 6), right({value}, 3)) "
        f"else repeat('*', {size}) end"
    )


def mask_email(value: str) -> str:
    """Two characters of the local part and the whole domain."""
    return let(
        "p",
        f"split({value}, '@')",
        f"case when size(p) = 2 then concat(left(p[0], 2), '***@', p[1]) else {value} end",
    )


def mask_other(value: str) -> str:
    """Ten characters and an ellipsis; values up to ten stay readable."""
    return (
        f"case when char_length({value}) > 10 then concat(left({value}, 10), '...') "
        f"else {value} end"
    )


def masked(category: str, value: str) -> str:
    """Dispatch over a findings table."""
    identifiers = ", ".join(f"'{c}'" for c in IDENTIFIER_CATEGORIES)
    return (
        f"case when {category} = 'fio' then {mask_full_name(value)} "
        f"when {category} in ({identifiers}) then {mask_identifier(value)} "
        f"when {category} = 'email' then {mask_email(value)} "
        f"else {mask_other(value)} end"
    )
