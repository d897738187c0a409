"""Row numbers where the input is split anew before each scan, as when an executor is lost or comes late."""

from __future__ import annotations

import itertools
from collections import Counter

import pytest
from helpers import docs_frame
from test_jaccard_join import brute as brute_classes
from test_jaccard_join import cases
from test_run_length_index import ANCHOR, WIDTH, rows_of_all_kinds
from test_run_length_index import brute as brute_repeats

from veilspan.llm import jaccard_join, mixing, run_length_index, winnowing
from veilspan.llm.common import numbered, without

PARTS = "spark.sql.files.minPartitionNum"


@pytest.fixture
def shifting(spark, monkeypatch):
    """Each table written changes how later scans are split."""
    turns = itertools.cycle([1, 7, 2, 5, 3])

    def shifted(df, name, write=run_length_index.cut):
        spark.conf.set(PARTS, next(turns))
        out = write(df, name)
        spark.conf.set(PARTS, next(turns))
        return out

    for module in (run_length_index, jaccard_join, mixing, winnowing):
        monkeypatch.setattr(module, "cut", shifted)
    yield
    spark.conf.unset(PARTS)


def stored(spark, rows, path):
    docs_frame(spark, rows).repartition(9).write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_numbers_do_not_depend_on_splits(spark, tmp_path):
    docs, seen = stored(spark, [(k, f"text {k}") for k in range(200)], tmp_path / "d"), []
    for parts in (1, 3, 8):
        spark.conf.set(PARTS, parts)
        seen.append({(r["doc_id"], r["_row"], r["th"]) for r in numbered(docs, "text").collect()})
    spark.conf.unset(PARTS)
    assert seen[0] == seen[1] == seen[2] and len({row for _, row, _ in seen[0]}) == 200


def test_repeats_with_shifting_splits(spark, tmp_path, shifting):
    rows = rows_of_all_kinds()
    got = run_length_index.remove_repeats(stored(spark, rows, tmp_path / "d"), width=WIDTH, anchor=ANCHOR).drop("cut")
    assert Counter(tuple(r) for r in got.collect()) == brute_repeats(rows)


def test_near_duplicates_with_shifting_splits(spark, tmp_path, shifting):
    rows = cases()
    docs = stored(spark, rows, tmp_path / "d")
    got = jaccard_join.link_documents(docs).select("doc_id", "n_shingles", "component_id").collect()
    want = brute_classes(rows)
    assert sorted(map(tuple, got), key=repr) == want
    kept = jaccard_join.keep_one(docs)
    spark.conf.set(PARTS, 4)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({c if n else k for k, n, c in want if k is not None})


def test_benchmark_and_mix_with_shifting_splits(spark, tmp_path, shifting):
    passage = " ".join(f"w{k}" for k in range(20))
    docs = stored(spark, [(k, passage if k % 3 == 0 else f"own words of {k} " * 5) for k in range(60)], tmp_path / "d")
    items = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    kept = winnowing.drop_contaminated(docs, items)
    spark.conf.set(PARTS, 4)
    assert sorted(r["doc_id"] for r in kept.collect()) == [k for k in range(60) if k % 3]
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(mixing.measure(docs)).collect()}
    assert Counter(r["doc_id"] for r in mixing.draw(docs).collect()) == Counter({k: n for k, n in taken.items() if n})


def test_lost_rows_end_the_run(spark, tmp_path):
    rows = numbered(stored(spark, [(k, f"text {k}") for k in range(20)], tmp_path / "d"), "text")
    gone = rows.where("doc_id < 5").select("_row", "th")
    assert without(rows, ["doc_id"], gone).count() == 15
    with pytest.raises(RuntimeError, match="4 of 5"):
        without(rows.where("doc_id <> 3"), ["doc_id"], gone)
