from __future__ import annotations

import numpy as np
from helpers import docs_frame

from veilspan.llm.weak_toxicity import ABSTAIN, CLEAN, THRESHOLD, TOXIC, ToxicityModel, fit_linear, label_model, op5_weak_toxicity, score, train


def test_label_model_weighs_voters():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3

    def voter(right, speaks):
        vote = np.where(rng.random(4000) < right, y, ~y)
        return np.where(rng.random(4000) < speaks, np.where(vote, TOXIC, CLEAN), ABSTAIN)

    good, bad = voter(0.95, 0.9), voter(0.55, 0.9)
    v = np.stack([good, bad, bad, bad, bad, voter(0.85, 0.6), voter(0.8, 0.7)], 1)  # four copies of a poor voter
    q = label_model(v, np.where(rng.random(4000) < 0.8, y, ~y).astype(float))
    majority = (v == TOXIC).sum(1) > (v == CLEAN).sum(1)
    assert ((q > 0.5) == y).mean() > 0.93 > (majority == y).mean()


def test_linear_classifier():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 4)).astype(np.float32)
    y = (x[:, 0] - 2 * x[:, 2] > 0.5).astype(float)
    w = fit_linear(x, y)
    assert (((x @ w[:-1] + w[-1]) > 0) == y).mean() > 0.95


def labelled(spark):
    clean = [(k, f"a plain text about topic number{k} and nothing else at all") for k in range(60)]
    toxic = [(100 + k, f"you are an idiot and a moron, topic number{k} is grumblefoo{k}") for k in range(40)]
    rows = [(i, t, 0 if i < 100 else 1) for i, t in clean + toxic]
    return spark.createDataFrame(rows, "key bigint, text string, toxic bigint")


def test_learned_words_and_edge_cases(spark):
    model = train(labelled(spark))
    rows = [(1, "IDIOT! grumblefoo99 moron"), (2, "a plain text about something"), (3, None), (4, ""), (5, "word " * 50_000), (2, "a plain text about something")]
    got = score(docs_frame(spark, rows).withColumnRenamed("root", "toxicity"), model)
    assert got.columns.count("toxicity") == 1
    values = [r["toxicity"] for r in got.collect()]
    assert values[0] > 0.7 and max(values[1:]) < THRESHOLD and values[1] == values[5] and all(0 <= v <= 1 for v in values)


def test_without_labels(spark):
    model = train(labelled(spark).where("toxic = 0"))
    assert [r["toxicity"] for r in score(docs_frame(spark, [(1, "idiot")]), model).collect()] == [0.0]
    assert score(docs_frame(spark, [(1, "x")]).limit(0), ToxicityModel(np.empty(0, np.uint64), None)).count() == 0


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    got = op5_weak_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out")
    rate = {r["toxic"]: r["p"] for r in got.groupBy("toxic").agg({"predicted": "avg"}).toDF("toxic", "p").collect()}
    assert rate[1] > 0.9 and rate[0] < 0.03
