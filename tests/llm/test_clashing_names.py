"""Columns of the user that are named like those that operators use inside."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from helpers import word_soup

from veilspan.llm import hash_tree, jaccard_join, line_crf, mixing, winnowing
from veilspan.llm.common import free_name, set_aside, shielded

NAMES = ["th", "_row", "_file", "_index", "_place", "copies", "size", "shard", "slot", "_at", "_part", "toxicity", "n_words", "_body", "_key", "_copy"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    texts = [word_soup(rng, 40, "one two three four five six seven eight nine ten and then more words") for _ in range(40)]
    rows = [(k, texts[k % 38], "en", f"s{k % 3}", 9, *(f"{n}{k}" for n in NAMES)) for k in range(40)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in NAMES))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "nothing of this stands in any of the documents at all so none is hit")], "item_id bigint, text string")


def unchanged(df, prefix=lambda n: n):
    rows = df.collect()
    assert rows and all(r[prefix(n)] == f"{n}{r['doc_id']}" for r in rows for n in NAMES if prefix(n))
    return len(rows)


def test_stages_give_values_back(spark, docs, items):
    assert unchanged(jaccard_join.keep_one(docs)) == 38
    assert unchanged(winnowing.drop_contaminated(docs, items)) == 40
    assert unchanged(mixing.draw(docs)) > 10
    for out in (jaccard_join.keep_one(docs), winnowing.drop_contaminated(docs, items), mixing.draw(docs)):
        assert out.columns == docs.columns


def test_results_beside_columns_of_their_names(docs, items):
    aside = {"size", "shard", "slot"}
    assert unchanged(hash_tree.number(hash_tree.place(docs)), lambda n: f"input_{n}" if n in aside else n) == 40
    assert unchanged(line_crf.judge(docs, None), lambda n: "input_n_words" if n == "n_words" else n) == 40
    keep = ["doc_id", *NAMES]
    got = winnowing.find_overlaps(docs, items, keep)
    assert unchanged(got, lambda n: f"input_{n}" if n in ("n_words", "_row") else n) == 40


def test_pipeline(spark, docs, tmp_path):
    rows = docs.withColumnRenamed("doc_id", "doc_id")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality bigint, toxic bigint").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no such words")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert unchanged(out, lambda n: f"input_{n}" if n in ("size", "shard", "slot") else n) > 10


def test_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3)], "SIZE int, input_size int, x int")
    assert free_name(df, "size") == "input_input_size" and free_name(df, "y") == "y"
    assert set_aside(df, ["size", "x"], "x").columns == ["input_input_SIZE", "input_size", "x"]
    out, names = shielded(df, reserved=("x",))
    assert out.columns == ["SIZE", "input_size", "kept_x"] and out.withColumnsRenamed(names).columns == df.columns
