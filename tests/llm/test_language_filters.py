from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from helpers import docs_frame

from veilspan.llm import textkit as tk
from veilspan.llm.language_filters import LEAST_SHARE, ORDERS, LanguageFilter, _ngrams, op9_language_filters, predict, train


def trained(spark):
    rows = [(k, "the quick brown fox and the lazy dog " * 3, "en") for k in range(20)] + [(50 + k, "der schnelle braune fuchs und der faule hund " * 3, "de") for k in range(30)]
    docs = docs_frame(spark, [*rows, (99, None, "en"), (98, "no language given", None)])
    return train(docs.selectExpr("doc_id as key", "text", "lang"))


def test_predictions_and_edge_cases(spark):
    rows = [(1, "The Dog and the FOX"), (2, "der hund und der fuchs"), (3, None), (4, ""), (5, "123 ... !?"), (6, "ζζζζ"), (7, "x"), (1, "the dog " * 30_000), (None, "und der")]
    got = predict(docs_frame(spark, rows).withColumnRenamed("root", "score"), trained(spark)).collect()
    assert [r["lang_pred"] for r in got] == ["en", "de", "und", "und", "und", "de", "de", "en", "de"]
    assert all(0 <= r["score"] <= 1 for r in got) and [r["score"] for r in got[2:6]] == [0, 0, 0, 0]


def test_nothing_learned_and_empty_tables(spark):
    docs = docs_frame(spark, [(1, "text")])
    model = train(docs.where("false").selectExpr("doc_id as key", "text", "lang"))
    assert predict(docs, model).first()["lang_pred"] == "und"
    assert predict(docs.limit(0), trained(spark)).count() == 0


def test_filter_has_no_misses_and_many_languages():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 63, 400).astype(np.uint64) for _ in range(70)]
    model = LanguageFilter([f"l{k}" for k in range(70)], "l0", list(zip(sets, range(70))))
    assert (model.false_rate < 1e-3).all()
    text = pa.array(["some words of a text"])
    for _, _, data, offsets in tk.slices(text):
        grams = np.concatenate([_ngrams(data, offsets, n)[1] for n in ORDERS])
        known = LanguageFilter(["a", *[f"l{k}" for k in range(68)], "z"], "a", [(grams, 69), *zip(sets[:69], range(69))])
        share, total = known.shares(data, offsets)
        assert total[0] == len(grams) and share[0, 69] == 1.0 and share[0].argmax() == 69


def test_ngrams_stay_inside_rows():
    for _, _, data, offsets in tk.slices(pa.array(["abc", "def"])):
        assert len(_ngrams(data, offsets, 3)[0]) == 2 and len(_ngrams(data, offsets, 5)[0]) == 0


def plain_grams(text):
    """Byte n-grams of a lower-cased text in which at most one byte is not part of a letter."""
    data = re.sub(rb"[^a-z\x80-\xff]", b" ", (text or "").lower().encode())
    return [data[k : k + n] for n in ORDERS for k in range(len(data) - n + 1) if data[k : k + n].count(b" ") <= 1]


def test_predictions_equal_exact_sets(spark):
    """Sets of n-grams in place of the filter: the same language, and the same share but for false positives."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang").limit(300).collect()
    known: dict = {}
    for r in docs[:150]:
        if r["lang"] is not None:
            known.setdefault(r["lang"], []).extend(plain_grams(r["text"]))
    sets = {}
    for lang, grams in known.items():
        values, n = np.unique(np.array(grams, object), return_counts=True)
        sets[lang] = set(values[n >= LEAST_SHARE * len(grams)])
    frame = spark.createDataFrame(docs[:150], "doc_id bigint, text string, lang string")
    model = train(frame.selectExpr("doc_id as key", "text", "lang"))
    got = predict(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), model).collect()
    same = 0
    for r in got:
        grams = plain_grams(r["text"])
        shares = {lang: sum(g in s for g in grams) / max(len(grams), 1) for lang, s in sorted(sets.items())}
        best = max(shares, key=shares.get)
        same += r["lang_pred"] == best
        if r["lang_pred"] == best:
            assert abs(r["score"] - shares[best] / sum(shares.values())) < 0.02
    assert same >= 0.99 * len(got)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = op9_language_filters(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.where("held_out and lang is not null").selectExpr("avg(int(lang = lang_pred)) as a").first()["a"]
    assert right > 0.97
