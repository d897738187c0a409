"""Findings: golden lines, comparison with Python's regex engine, plans."""

from __future__ import annotations

import random
import time

import numpy as np
from plain_rules import plain_matches
from pyspark.sql import functions as F

from veilspan.functions.patterns import CATEGORIES, CONFIGURED_CATEGORIES
from veilspan.functions.sqltext import running_sums
from veilspan.operators.detect import count_matches, findings
from veilspan.operators.profile import category_counts, count_findings
from veilspan.plans.corpus import OVERLAY

# A delivery order: every common kind of value once, two numbers with wrong check digits,
# a passport with a word between its halves and an address that runs over a line end.
ORDER = """Заказ на доставку от 17.03.2031
Получатель Белкина Зоя Марковна; звонить +7 (912) 304-18-26
Копию чека выслать на z.belkina@lavka.example
Документ 52 08 выдан, код 417395
страховой 204-518-336-77, инн 530100884412
Везти: ул. Речная, д. 8,
подъезд 2"""

GOLDEN = {
    0: [
        ("fio", "Орлов Андрей Ильич", 8, "Орлов А."),
        ("phone", "+7 (903) 412-55-67", 33, "+7 ************-67"),
    ],
    1: [
        ("passport", "Паспорт 4510 654321", 0, "Пас*************321"),
        ("passport", " 4511 765432", 26, " 45******432"),
        ("driver_license", "4510 654321", 8, "4510 65432..."),
        ("driver_license", "4511 765432", 27, "4511 76543..."),
    ],
    2: [
        ("snils", "112-233-445 95", 6, "112******** 95"),
        ("inn", "ИНН: 500100732259", 22, "ИНН***********259"),
    ],
    3: [
        ("phone", "9910004312", 42, "991****312"),
        ("bank_card", "4539 1488 0343 6467", 6, "453*************467"),
        ("bank_account", "40817810099910004312", 32, "4081781009..."),
        ("bik", "БИК 044525225", 54, "БИК 044525..."),
    ],
    4: [
        ("birth_date", "05.03.1987", 8, "05.03.1987"),
        ("address", "г. Тверь, ул. Мира, д. 7", 31, "г. Тверь, ..."),
    ],
    5: [
        ("biometric", "БИОМЕТРИЯ", 20, "БИОМЕТРИЯ"),
        ("health", "Диагноз", 0, "Диагноз"),
        ("special", "религиозные", 37, "религиозны..."),
    ],
    6: [("snils", "112-233-445 95", 16 * i, "112******** 95") for i in range(10)],
    7: [
        ("address", "д. Омск", 2, "д. Омск"),
        ("address", "город Омск", 19, "город Омск"),
    ],
}


def test_golden_lines(spark):
    df = spark.createDataFrame(list(enumerate(OVERLAY)), "k int, text string")
    got = findings(df, ["k"]).orderBy("k", "ordinal", "position").collect()
    want = [(k, *row) for k, rows in GOLDEN.items() for row in rows]
    assert [(r.k, r.category, r.value, r.position, r.masked_value) for r in got] == want


def test_delivery_order(spark):
    df = spark.createDataFrame([(ORDER,)], "text string")
    counts = {r.category: r["count"] for r in findings(df, []).groupBy("category").count().collect()}
    assert counts == {"fio": 1, "phone": 1, "email": 1, "birth_date": 1, "address": 1}
    raw = {r.value for r in findings(df, [], validate=False).collect()}
    assert {"204-518-336-77", "инн 530100884412"} <= raw


def test_empty_and_null_text(spark):
    df = spark.createDataFrame([("",), (None,), (" \n",)], "text string")
    assert findings(df, []).count() == 0
    assert count_matches(df, []).count() == 0


PIECES = [
    *"0123456789", "04", "19", "1990", "20", "4539 1488 0343 6467", "112-233-445 95", "4510",
    "654321", "5001007322", "500100732259", "044525225", "+7", "8", "(903)", "412", "55", "67",
    " ", " ", " ", "\n", "\t", " ", "-", ".", "/", ":", "№", ",", "_", "|", "@", "%", "+",
    "a", "Z", "mail", "user", "site.ru", "b.co|m", "é", "ß", "中", "́", "٣", "４", "½", "😀",
    "Иван", "Петров", "Ёлкин", "ИВАН", "ван", "паспорт", "СЕРИЯ", "инн", "ИНН:", "бик", "БИК ",
    "г.", "город", "ул.", "УЛИЦА", "пр.", "д.", "дом", "Дом", "Омск", "биометр", "Диагноз", "анализы",
    "раса", "профсоюз", "группа", "здоровья", "отпечатки", "пальцев", "религия", "ᲀ", "х", "Ж",
]


LAYOUTS = [[3, 3, 2, 2], [4, 6], [2, 2, 6], [3, 3, 3, 2], [4, 4, 4, 4], [10], [12], [20], [9], [11]]
GAPS = ["", "", "", " ", "-", "\n", "№", ") ", "--", "  ", "_"]


def _number(rng: random.Random) -> str:
    """Groups of digits in one of the known layouts, or a date, often a bit off."""
    if rng.random() < 0.2:
        sep = [rng.choice("./-") for _ in range(2)]
        day, month = rng.choice(["5", "05", "31", "32", "00"]), rng.choice(["1", "12", "13", "09"])
        return f"{day}{sep[0]}{month}{sep[1]}{rng.choice(['19', '20', '21'])}{rng.randint(10, 99)}"
    groups = [
        "".join(rng.choices("0123456789", k=n)) for n in rng.choice(LAYOUTS)
    ]
    if rng.random() < 0.3:
        groups[0] = rng.choice(["04", "8", "9", "4"]) + groups[0][1:]
    if rng.random() < 0.2:
        groups.append(rng.choice("0123456789"))
    return "".join(g + rng.choice(GAPS) for g in groups)


def _random_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)

    def piece() -> str:
        return _number(rng) if rng.random() < 0.15 else rng.choice(PIECES)

    return ["".join(piece() for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_same_matches_as_python_engine(spark):
    texts = _random_texts(6000, seed=7)
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(8, "k")
    found = findings(df, ["k"], validate=False).collect()
    got: dict[int, set] = {}
    for r in found:
        got.setdefault(r.k, set()).add((r.category, r.position, r.value))
    wrong = [
        (t, sorted(got.get(k, set()) ^ plain_matches(t)))
        for k, t in enumerate(texts)
        if got.get(k, set()) != plain_matches(t)
    ]
    assert not wrong, (len(wrong), wrong[:3])
    assert {r.category for r in found} == set(CATEGORIES)


def test_counts_agree_with_findings(spark):
    texts = _random_texts(1500, seed=11) + list(OVERLAY)
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    by_count = {
        (r.k, c): r.counts[c]
        for r in count_matches(df, ["k"]).collect()
        for c in CATEGORIES
        if r.counts[c]
    }
    by_row = {
        (r.k, r.category): r["count"]
        for r in findings(df, ["k"], with_offsets=False).groupBy("k", "category").count().collect()
    }
    assert by_count == by_row
    grouped = category_counts(df.withColumnRenamed("k", "path")).collect()
    assert {(r.path, r.category): r.n for r in grouped} == by_row
    grouped = count_findings(findings(df, ["k"]), "k").collect()
    assert {(r.k, r.category): r.n for r in grouped} == by_row


def test_many_matches_in_one_row(spark):
    line = "тел. 89034125567 и 89161112233; "
    df = spark.createDataFrame([(line * 700,)], "text string")
    got = [r.position for r in findings(df, [], categories=["phone"]).collect()]
    want = [len(line) * i + at for i in range(700) for at in (5, 19)]
    assert sorted(got) == want


def test_very_long_markup_and_digits(spark):
    df = spark.createDataFrame([("1" * 300_000 + " " * 200_000 + "ё" * 100_000,)], "text string")
    assert findings(df, []).count() == 0


def test_category_subset(spark):
    df = spark.createDataFrame(list(enumerate(OVERLAY)), "k int, text string")
    found = {r.category for r in findings(df, ["k"], categories=CONFIGURED_CATEGORIES).collect()}
    assert "bik" not in found and "bank_account" in found
    only = findings(df, ["k"], categories=["special", "fio"]).orderBy("ordinal").collect()
    assert [r.category for r in only] == ["fio", "special"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_each_pattern_runs_once_and_nothing_shuffles(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    df = spark.createDataFrame(list(enumerate(OVERLAY)), "k int, text string")
    # Twelve single rules and one shared keyword pass, and the runs of numbers.
    for result, passes, runs in ((findings(df, ["k"]), "regexp_replace(_text", 13), (count_matches(df, ["k"]), "regexp_extract_all(", 14)):
        plan = _plan(result)
        assert plan.count(passes) == runs
        assert plan.count("regexp_extract_all(") == (1 if runs == 13 else 14)
        assert "Exchange" not in plan
        assert "Python" not in plan


def test_marks_in_a_text_are_not_taken_for_ours(spark):
    text = "\ufdd0a@site.org\ufdd0 \ufdd0\ufdd0b@site.org \ufdd1"
    got = findings(spark.createDataFrame([(1, text)], "k int, text string"), ["k"]).collect()
    assert [(r["position"], r["value"]) for r in got] == [(1, "a@site.org"), (15, "b@site.org")]


def test_positions_of_many_matches_take_linear_time(spark):
    def seconds(n):
        text = "".join(f"u{k}@site.org, диагноз; " for k in range(n))
        df = spark.createDataFrame([(1, text)], "k int, text string")
        started = time.perf_counter()
        got = findings(df, ["k"]).groupBy("category").agg(F.max("position"), F.count("*")).collect()
        taken = time.perf_counter() - started
        last = len(text) - len(f"u{n - 1}@site.org, диагноз; ")
        assert {tuple(r) for r in got} == {("email", last, n), ("health", last + len(f"u{n - 1}@site.org, "), n)}
        return taken

    seconds(100)
    assert seconds(100_000) < 5 * seconds(25_000) + 2


def test_running_sums(spark):
    for n in (0, 1, 2, 127, 128, 129, 16_384, 16_385, 40_000):
        got = spark.range(1).selectExpr(f"{running_sums(f'transform(slice(sequence(1, {n} + 1), 1, {n}), x -> x % 7)')} as s").first().s
        assert got == np.cumsum(np.arange(1, n + 1) % 7).tolist()


def test_only_needed_columns_are_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = _plan(count_matches(docs, ["doc_id"]).select("doc_id", F.col("counts.email")))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
