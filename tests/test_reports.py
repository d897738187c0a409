"""Report analytics and comparison against plain Python."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime

import pytest

from veilspan.operators import analytics, compare
from veilspan.sources.reports import (
    detailed_report,
    read_detailed,
    read_summary,
    summary_report,
    write_report,
)

LEVELS = ["УЗ-1", "УЗ-2", "УЗ-4", "Нет ПДн"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = []
    for i in range(300):
        cats = sorted(rng.sample(["fio", "phone", "inn", "bik"], rng.randint(1, 3)))
        suffix = rng.choice([".txt", ".CSV", ".pdf", ".xyz", ""])
        name = f'f {i}, "q"{suffix}'
        when = datetime(2024, rng.randint(1, 12), rng.randint(1, 28), 7, rng.randint(0, 59))
        out.append(
            (f"d/{name}", name, rng.choice([10, 20, rng.randint(1, 10**6)]), when, cats,
             {c: rng.randint(1, 5) for c in cats}, rng.choice(LEVELS), suffix)
        )
    return out


@pytest.fixture(scope="module")
def profile(spark, rows):
    return spark.createDataFrame(
        rows,
        "path string, name string, size bigint, mtime timestamp_ntz, pii_categories array<string>, "
        "pii_counts map<string, bigint>, protection_level string, format string",
    )


def test_reports_survive_the_disk(spark, profile, rows, tmp_path):
    for make, read in [(summary_report, read_summary), (detailed_report, read_detailed)]:
        report = make(profile)
        path = str(tmp_path / make.__name__)
        write_report(report, path)
        back = read(spark, path)
        assert back.columns == report.columns
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, report.collect()))
    first = {r.name: r.time for r in summary_report(profile).collect()}
    assert all(first[r[1]] == r[3].strftime("%b %d %H:%M").lower() for r in rows)


def test_distributions(profile, rows):
    detailed = detailed_report(profile)
    n = len(rows)
    levels = sorted(Counter(r[6] for r in rows).items())
    assert [tuple(r) for r in analytics.level_share(detailed).collect()] == [
        (k, v, round(v / n * 100, 1)) for k, v in levels
    ]
    assert [tuple(r) for r in analytics.level_counts(profile).collect()] == [
        (k, v, n) for k, v in levels
    ]
    formats = sorted(Counter(r[7] for r in rows).items(), key=lambda kv: (-kv[1], kv[0]))
    assert [(r[0], r.files) for r in analytics.format_share(detailed).collect()] == formats
    cats = sorted(Counter(c for r in rows for c in r[4]).items(), key=lambda kv: (-kv[1], kv[0]))
    assert [tuple(r) for r in analytics.top_categories(detailed, 3).collect()] == cats[:3]
    families = {r.family: r.files for r in analytics.family_share(detailed).collect()}
    by_suffix = Counter(r[7] for r in rows)
    assert families == {
        "documents": by_suffix[".pdf"],
        "structured": by_suffix[".CSV"],
        "other": by_suffix[".txt"] + by_suffix[".xyz"] + by_suffix[""],
    }


def test_sizes(profile, rows):
    sizes = [r[2] for r in rows]
    got = analytics.size_stats(profile).first()
    assert (got.files, got.total_bytes, got.min_bytes, got.max_bytes) == (
        len(sizes), sum(sizes), min(sizes), max(sizes),
    )
    assert got.mean_bytes == sum(sizes) / len(sizes)
    top = sorted(rows, key=lambda r: (-r[2], r[1]))[:10]
    assert [(r["rank"], r["name"], r["size"]) for r in analytics.top_files(profile).collect()] == [
        (i, r[1], r[2]) for i, r in enumerate(top, 1)
    ]


def test_comparison_with_a_hot_name(spark):
    rng = random.Random(4)

    def report(names, n):
        # One name holds a third of all rows.
        picked = ["hot"] * (n // 3) + [rng.choice(names) for _ in range(n - n // 3)]
        return [(name, i, rng.randint(1, 9)) for i, name in enumerate(picked)]

    a = report([f"n{i}" for i in range(40)], 600)
    b = report([f"n{i}" for i in range(25, 60)], 500)
    left = spark.createDataFrame(a, "name string, seq int, size int")
    right = spark.createDataFrame(b, "name string, seq int, size int")
    last = {name: (seq, size) for name, seq, size in a}
    assert {r.name: (r.seq, r["size"]) for r in compare.latest(left).collect()} == last
    x, y = {r[0] for r in a}, {r[0] for r in b}
    names = lambda df: sorted(r.name for r in df.collect())
    assert names(compare.common(left, right)) == sorted(x & y)
    assert names(compare.only_left(left, right)) == sorted(x - y)
    assert names(compare.only_right(left, right)) == sorted(y - x)
    assert tuple(compare.diff_counts(left, right).first()) == (
        len(x), len(y), len(x & y), len(x - y), len(y - x),
    )
    sample = [tuple(r) for r in compare.diff_sample(left, right, 5).collect()]
    assert sorted(sample) == [("left", n) for n in sorted(x - y)[:5]] + [
        ("right", n) for n in sorted(y - x)[:5]
    ]


def test_comparison_of_nothing(spark):
    empty = spark.createDataFrame([], "name string, seq int")
    assert tuple(compare.diff_counts(empty, empty).first()) == (0, 0, 0, 0, 0)
    assert analytics.size_stats(spark.createDataFrame([], "size bigint")).first().files == 0
