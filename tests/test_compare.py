"""Stored reports are compared without a shuffle of names."""

from __future__ import annotations

import random

import pytest

from veilspan.operators import compare
from veilspan.operators.compare import StoredComparison, store_report


@pytest.fixture(scope="module")
def reports(spark):
    rng = random.Random(4)
    names = [f"f{k}.txt" for k in range(400)] + [None, ""]
    out = []
    for side in ("left", "right"):
        # A third of the rows are of one name.
        rows = [("hot.txt" if rng.random() < 0.3 else rng.choice(names), k, rng.randrange(9)) for k in range(900)]
        report = spark.createDataFrame(rows, "name string, seq int, size int")
        store_report(report, f"stored_{side}", buckets=8)
        out.append(report)
    yield out
    for side in ("left", "right"):
        spark.sql(f"drop table stored_{side}")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equal_to_the_comparison_by_aggregate(spark, reports):
    stored = StoredComparison(spark, "stored_left", "stored_right")
    assert rows(stored.common()) == rows(compare.common(*reports)) and stored.common().count() > 100
    assert rows(stored.only_left()) == rows(compare.only_left(*reports))
    assert rows(stored.only_right()) == rows(compare.only_right(*reports))
    assert rows(stored.diff_counts()) == rows(compare.diff_counts(*reports))
    assert rows(stored.diff_sample(5)) == rows(compare.diff_sample(*reports, 5))


def test_the_last_row_of_a_name_is_kept(spark, reports):
    assert rows(spark.table("stored_left").select("name", "seq", "size")) == rows(compare.latest(reports[0]))


def test_names_are_not_shuffled(spark, reports):
    stored = StoredComparison(spark, "stored_left", "stored_right")
    for df, exchanges in ((stored.common(), 0), (stored.only_left(), 0), (stored.only_right(), 0), (stored.diff_counts(), 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # Counts meet in one row at the end; that is all that moves.
        assert plan.count("Exchange") == exchanges == plan.count("Exchange SinglePartition"), plan
        assert plan.count("Bucketed: true") == 2 or "SelectedBucketsCount: 8 out of 8" in plan


def test_a_sample_evaluates_each_report_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def report(low, high):
        return spark.range(low, high, 1, 2).selectExpr("nullif(concat('f', lpad(id, 3, '0')), 'f000') as name").mapInArrow(counted, "name string")

    got = [tuple(r) for r in compare.diff_sample(report(0, 60), report(40, 90), 3).collect()]
    assert got == [("left", None), ("left", "f001"), ("left", "f002"), ("right", "f060"), ("right", "f061"), ("right", "f062")]
    assert seen.value == 60 + 50


def test_empty_reports(spark):
    empty = spark.createDataFrame([], "name string, seq int")
    store_report(empty, "stored_empty", buckets=8)
    store_report(spark.createDataFrame([("a", 1)], "name string, seq int"), "stored_one", buckets=8)
    try:
        assert rows(StoredComparison(spark, "stored_empty", "stored_one").only_right()) == [("a",)]
        assert rows(StoredComparison(spark, "stored_empty", "stored_empty").diff_counts()) == [(0, 0, 0, 0, 0)]
    finally:
        for t in ("stored_empty", "stored_one"):
            spark.sql(f"drop table {t}")
