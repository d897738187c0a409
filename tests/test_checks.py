"""Checksums, masks and levels: generated numbers, brute force, monotonicity."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from veilspan.functions import checks, masks
from veilspan.operators.levels import (
    LEVEL_1,
    LEVEL_2,
    LEVEL_3,
    LEVEL_4,
    NO_LEVEL,
    REGULAR,
    SENSITIVE,
    SPECIAL,
    protection_level,
    with_recommendations,
)


def _column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.selectExpr("i", f"{expression} as x").orderBy("i").collect()]


def _luhn_digit(body: str) -> str:
    total = 0
    for i, d in enumerate(reversed(body)):
        d = int(d) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _snils(body: str) -> str | None:
    total = sum((9 - i) * int(d) for i, d in enumerate(body))
    control = total if total < 100 else 0 if total in (100, 101) else total % 101
    return None if control == 100 else f"{body}{control:02d}"


def _inn(body: str) -> str:
    tail = [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]
    for _ in range(1 if len(body) == 9 else 2):
        weights = tail[-len(body):]
        body += str(sum(int(d) * w for d, w in zip(body, weights)) % 11 % 10)
    return body


digits = lambda n: st.text("0123456789", min_size=n, max_size=n)


@settings(max_examples=3, deadline=None)
@given(st.lists(digits(15), min_size=60, max_size=60), st.integers(0, 15), st.integers(1, 9))
def test_card_accepts_only_the_right_digit(spark, bodies, at, shift):
    good = [b + _luhn_digit(b) for b in bodies]
    changed = [g[:at] + str((int(g[at]) + shift) % 10) + g[at + 1 :] for g in good]
    assert all(_column(spark, good, checks.luhn_ok("v")))
    assert not any(_column(spark, changed, checks.luhn_ok("v")))


@settings(max_examples=3, deadline=None)
@given(st.lists(digits(9), min_size=60, max_size=60), st.lists(digits(10), min_size=60, max_size=60))
def test_snils_and_inn(spark, nine, ten):
    valid = [s for s in map(_snils, nine) if s]
    assert all(_column(spark, valid, checks.snils_ok("v")))
    all_controls = [nine[0] + f"{c:02d}" for c in range(100)]
    assert sum(_column(spark, all_controls, checks.snils_ok("v"))) == (_snils(nine[0]) is not None)
    inns = [_inn(b) for b in nine + ten]
    assert all(_column(spark, inns, checks.inn_ok("v")))
    wrong = [i[:-1] + str((int(i[-1]) + 1) % 10) for i in inns]
    assert not any(_column(spark, wrong, checks.inn_ok("v")))


def test_check_details(spark):
    assert _column(spark, ["4539-1488 0343 6467", "４539148803436467", "453914880343646", ""],
                   checks.luhn_ok("v")) == [True, True, False, False]
    # Weighted sums of 100 and 101 give control 00; a remainder of 100 never matches.
    rng = random.Random(3)
    seen = set()
    while seen != {100, 101, 201}:
        body = "".join(rng.choices("0123456789", k=9))
        total = sum((9 - i) * int(d) for i, d in enumerate(body))
        if total in (100, 101, 201) and total not in seen:
            seen.add(total)
            controls = [body + f"{c:02d}" for c in range(100)]
            accepted = [c[-2:] for c, ok in zip(controls, _column(spark, controls, checks.snils_ok("v"))) if ok]
            assert accepted == ([] if total == 201 else ["00"])
    assert _column(spark, ["ИНН: 500100732259", "500100732258", "12345"],
                   checks.inn_ok("v")) == [True, False, False]
    assert _column(spark, ["Ян Ли", "Я Ли", "Иванов", " Ян\nЛи "],
                   checks.full_name_ok("v")) == [True, False, False, True]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(max_size=25), min_size=40, max_size=40))
def test_identifier_mask_keeps_length(spark, values):
    values = [v.encode("utf-8", "ignore").decode().replace("\x00", "") for v in values]
    got = _column(spark, values, masks.mask_identifier("v"))
    want = [v[:3] + "*" * (len(v) - 6) + v[-3:] if len(v) > 6 else "*" * len(v) for v in values]
    assert got == want


def test_other_masks(spark):
    assert _column(spark, ["Орлов  Андрей\nИльич", "Орлов", ""],
                   masks.mask_full_name("v")) == ["Орлов А.", "О****", ""]
    assert _column(spark, ["petrov@x.ru", "a@x.ru", "a@b@c", "none"],
                   masks.mask_email("v")) == ["pe***@x.ru", "a***@x.ru", "a@b@c", "none"]
    assert _column(spark, ["1234567890", "12345678901"],
                   masks.mask_other("v")) == ["1234567890", "1234567890..."]


def _levels(spark, counts):
    df = spark.createDataFrame(list(enumerate(counts)), "i int, c map<string, bigint>")
    return [r.x for r in df.selectExpr("i", f"{protection_level('c')} as x").orderBy("i").collect()]


def test_levels(spark):
    cases = [
        (None, NO_LEVEL),
        ({}, NO_LEVEL),
        ({"health": 1, "bank_card": 500}, LEVEL_1),
        ({"bik": 1}, LEVEL_2),
        ({"passport": 60, "inn": 40}, LEVEL_2),
        ({"passport": 6, "inn": 4}, LEVEL_3),
        ({"fio": 60, "phone": 40}, LEVEL_3),
        ({"fio": 99}, LEVEL_4),
        ({"snils": 9, "email": 1}, LEVEL_4),
        ({"snils": 9}, NO_LEVEL),
    ]
    assert _levels(spark, [c for c, _ in cases]) == [level for _, level in cases]


def test_level_never_drops_when_a_count_grows(spark):
    rng = random.Random(5)
    order = [NO_LEVEL, LEVEL_4, LEVEL_3, LEVEL_2, LEVEL_1]
    before, after = [], []
    for _ in range(400):
        names = rng.sample(SPECIAL + SENSITIVE + REGULAR, rng.randint(1, 5))
        counts = {n: rng.choice([1, 5, 9, 50, 100]) for n in names}
        more = dict(counts)
        extra = rng.choice(SPECIAL + SENSITIVE + REGULAR)
        more[extra] = more.get(extra, 0) + rng.choice([1, 10, 100])
        before.append(counts)
        after.append(more)
    pairs = zip(_levels(spark, before), _levels(spark, after))
    assert all(order.index(a) <= order.index(b) for a, b in pairs)


def test_recommendations(spark):
    df = spark.createDataFrame([("x", LEVEL_1), ("y", "?")], "path string, protection_level string")
    got = {r.path: r.recommendation for r in with_recommendations(df).collect()}
    assert got["x"].startswith("Highest") and got["y"] == ""
