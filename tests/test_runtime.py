"""Sizing and scratch helpers, and plan shapes that matter at scale."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from veilspan.operators import compare
from veilspan.operators.profile import FILE_COLUMNS, profile_files, profile_rows
from veilspan.plans import corpus
from veilspan.plans.runtime import SPREAD, scratch_path, spread

FOLDER = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_is_dealt_out_only_on_request(spark):
    assert "Exchange" not in _plan(corpus.documents(spark, FOLDER))
    assert "Exchange" not in _plan(corpus.pages(spark, FOLDER))
    spark.conf.set(SPREAD, "24")
    try:
        assert spread(corpus.table(spark, FOLDER, "documents"), "doc_id").rdd.getNumPartitions() == 24
    finally:
        spark.conf.unset(SPREAD)


def test_scratch_is_below_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first.startswith(shared) and first != second


@pytest.mark.parametrize(
    ("master", "checkpoint", "warehouse", "good"),
    [
        ("local[4]", None, "file:/w", True), ("local", None, "file:/w", True), ("yarn", None, "file:/w", False), ("local-cluster[2,1,900]", None, "file:/w", False),
        ("yarn", None, "hdfs://h/w", True), ("yarn", "hdfs://h/c", "file:/w", True),
    ],
)
def test_a_folder_of_one_machine_is_not_shared(master, checkpoint, warehouse, good):
    known = {"spark.checkpoint.dir": checkpoint, "spark.sql.warehouse.dir": warehouse}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, *d: known[k]), sparkContext=SimpleNamespace(master=master, applicationId="app"))
    if good:
        assert scratch_path(session, "x").startswith(f"{checkpoint or warehouse}/app/x-")
    else:
        with pytest.raises(ValueError, match="checkpoint"):
            scratch_path(session, "x")


def test_file_profiles_do_not_shuffle(spark):
    docs = corpus.table(spark, FOLDER, "documents").selectExpr(
        "cast(doc_id as string) as path", "'n' as name", "n_chars as size",
        "timestamp_ntz'2024-01-01 00:00:00' as mtime", "'.txt' as format", "text",
    )
    assert "Exchange" not in _plan(profile_files(docs))


def test_a_file_with_most_of_the_rows(spark):
    text = "case when id % 3 = 0 then 'a@site.org b@site.org' when id % 3 = 1 then '' end"
    rows = spark.range(30_000, numPartitions=8).selectExpr(
        "if(id % 3 = 0, 'hot', concat('f', id % 7)) as path", "'n' as name", "1L as size",
        "timestamp_ntz'2024-01-01 00:00:00' as mtime", "'.md' as format", f"{text} as text",
    )
    assert set(FILE_COLUMNS) < set(rows.columns)
    profile = profile_rows(rows, sum_sizes=True)
    plan = _plan(profile)
    assert plan.count("Exchange") == 1 and "partial_sum" in plan
    assert [(r.path, r["size"], r.pii_counts) for r in profile.collect()] == [
        ("hot", 10_000, {"email": 20_000})
    ]


def test_comparison_takes_one_shuffle(spark):
    report = spark.range(100).selectExpr("concat('n', id) as name")
    plan = _plan(compare.presence(report, report))
    assert plan.count("Exchange") == 1 and "Join" not in plan
