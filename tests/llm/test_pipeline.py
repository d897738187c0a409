"""The pipeline's stages, each against a plain recomputation on its own input."""

from __future__ import annotations

import shutil
from collections import Counter
from pathlib import Path

import pytest
from test_jaccard_join import brute as brute_classes
from test_winnowing import brute as brute_overlaps

import corpus_pipeline
from veilspan.llm.scratch import cut

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(cut(stage(spark, seen[-1], SF), name))
    return seen


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns_and_names(stages):
    columns = stages[0].columns
    assert all(s.columns == columns for s in stages[:-1]) and set(columns) < set(stages[-1].columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_clean_documents_pass_the_toxicity_stage(spark, stages):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {k for k, _ in rows(stages[1])}
    gone = {k for k, _ in rows(stages[0])} - kept
    assert gone and sum(labels.get(k) == 0 for k in gone) <= 1


def test_one_document_of_each_class(stages):
    want = {c if n else k for k, n, c in brute_classes(rows(stages[1]))}
    assert sorted(k for k, _ in rows(stages[2])) == sorted(want)


def test_contaminated_documents_go(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    judged = brute_overlaps(rows(stages[2]), [(str(k), t) for k, t in items])
    assert sorted(k for k, _ in rows(stages[3])) == sorted(r[0] for r in judged if not r[5])


def test_mixed_rows_are_copies(stages):
    before, after = Counter(rows(stages[3])), Counter(rows(stages[4]))
    assert set(after) <= set(before) and max(after.values()) <= 3 and after
    words = lambda c: sum(len(t.split()) * n for (_, t), n in c.items())
    assert abs(words(after) - words(before)) < 0.2 * words(before)


def test_all_rows_are_sharded(stages):
    got = stages[5].collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows(stages[4]))
    slots: dict = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))


def test_run_gives_the_same_rows(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert Counter((r["doc_id"], r["shard"]) for r in got.collect()) == Counter((r["doc_id"], r["shard"]) for r in stages[5].collect())


def test_nulls_repeats_and_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path)
    odd = docs.limit(40).union(docs.limit(3)).union(spark.createDataFrame([(None, None, None, None, None), (9, "", None, None, 0), (8, "a", "en", None, 1)], docs.schema))
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    assert 20 < corpus_pipeline.run(spark, str(tmp_path)).count() < 140
    (tmp_path / "none").mkdir()
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path / "none")
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_library_imports_without_the_subpackage(tmp_path):
    import subprocess
    import sys

    root = Path(corpus_pipeline.__file__).parent
    shutil.copytree(root / "veilspan", tmp_path / "veilspan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) == 58"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, timeout=120).returncode == 0
