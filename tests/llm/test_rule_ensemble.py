from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import docs_frame, word_soup
from pyspark.sql import functions as F

from veilspan.llm import textkit as tk
from veilspan.llm.rule_ensemble import STATISTICS, Rule, RuleModel, described, fit, grow, lasso, op13_rule_ensemble, score, statistics, train, unscaled


def plain_statistics(text):
    """One text at a time, with regular expressions."""
    words = re.findall(r"[^ \t-\r]+", text or "")
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    chars = sum(map(len, words))
    windows = Counter(tuple(words[k : k + 5]) for k in range(n - 4))
    covered = {k + j for k in range(n - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [line for line in (re.findall(r"[^ \t-\r]+", x) for x in text.split("\n")) if line]
    spans = [re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", x) for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
    count = lambda pattern: sum(len(re.findall(pattern, w)) for w in words)
    share = lambda test: sum(map(bool, map(test, words))) / n
    return [
        math.log1p(n), chars / n, share(lambda w: len(w) > 14), share(lambda w: len(w) < 3), count(r"[#*$%&|<>]") / chars,
        share(lambda w: re.search(r"[#*$%&|<>]", w)), count("[0-9]") / chars, count("[A-Z]") / chars,
        share(lambda w: 2 * len(re.findall("[A-Z]", w)) > len(w)), count("[.,;:?!]") / n, count("!") / n, len(set(words)) / n,
        max(Counter(words).values()) / n, sum(a == b for a, b in zip(words, words[1:])) / n, len(covered) / n,
        (len(spans) - len(set(spans))) / len(spans), math.log1p(n / len(lines)),
        math.log1p(n / (1 + share(lambda w: w[-1] in ".?!") * n)), sum(line[-1][-1] in ".?!" for line in lines) / len(lines),
    ]


def test_statistics_equal_a_plain_version():
    rng = random.Random(1)
    texts = [None, "", " \n ", "One.", "a a a a a a a", "é" * 40] + [
        "".join(rng.choice(["AB", "cd", "é", "#", "!", ". ", "\n", " ", "\n\n", " x ", "12", "\t", "same words here and now "]) for _ in range(rng.randrange(120)))
        for _ in range(300)
    ]
    got = np.concatenate([statistics(data, offsets) for _, _, data, offsets in tk.slices(pa.array(texts, pa.string()), 500)])
    np.testing.assert_allclose(got, [plain_statistics(t) for t in texts], rtol=1e-12)


def test_a_conjunction_is_found_and_few_rules_stay():
    rng = np.random.default_rng(3)
    x = rng.random((3000, len(STATISTICS)))
    truth = (x[:, 4] > 0.6) & (x[:, 9] <= 0.5)
    y = (truth ^ (rng.random(3000) < 0.02)).astype(float)
    model = fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == truth[2000:]).mean() > 0.97
    assert len(model.rules) < 0.4 * len(grow(x[:2000], y[:2000]))
    strongest = model.rules[int(np.argmax(np.abs(model.weights)))]
    assert {k for k, _ in strongest.lows + strongest.highs} >= {4, 9}


def test_lasso_meets_its_conditions():
    """At the optimum the gradient is the penalty where a weight is not zero and no larger elsewhere."""
    rng = np.random.default_rng(4)
    z = (rng.random((800, 30)) < 0.3).astype(np.float32)
    y = (z[:, 0] + z[:, 1] + rng.normal(size=800) * 0.5 > 0.8).astype(float)
    w = lasso(z, y, 0.01, rounds=4000)
    a = (z - z.mean(0)) / z.std(0)
    p = 1 / (1 + np.exp(-(a @ w[:-1] + w[-1])))
    g = a.T @ (p - y) / len(y)
    on = np.abs(w[:-1]) > 1e-4
    assert 0 < on.sum() < 30 and abs((p - y).mean()) < 1e-3
    np.testing.assert_allclose(g[on], -0.01 * np.sign(w[:-1][on]), atol=1e-3)
    assert (np.abs(g[~on]) < 0.011).all()
    u = unscaled(w, z)
    np.testing.assert_allclose(z @ u[:-1] + u[-1], a @ w[:-1] + w[-1], rtol=1e-4, atol=1e-4)


def test_rules_narrow_and_compile(spark):
    rule = Rule().narrowed(0, 0.2, True).narrowed(0, 0.4, True).narrowed(0, 0.9, False).narrowed(3, 0.5, False).narrowed(3, 0.7, False)
    assert rule == Rule(((0, 0.4),), ((0, 0.9), (3, 0.5)))
    rng = np.random.default_rng(5)
    rules = [Rule().narrowed(int(rng.integers(19)), float(rng.random()), bool(k % 2)).narrowed(int(rng.integers(19)), float(rng.random()), bool(k % 3)) for k in range(250)]
    model = RuleModel(-0.3, rules, rng.normal(size=250).tolist())
    texts = [(k, word_soup(random.Random(k), k % 90, "Ab c# 12 why? so. long-long-long-words")) for k in range(200)]
    told = described(docs_frame(spark, texts).select("doc_id", "text"), "text", "t")
    got = told.select("t.*", model.column(lambda s: F.col(f"t.{s}")).alias("p")).collect()
    x = np.array([r[:-1] for r in got])
    np.testing.assert_allclose([r["p"] for r in got], model.score(x), rtol=1e-9)


def labelled(spark):
    rng = random.Random(6)
    good = [(k, word_soup(rng, 40, "many different words that stand in plain lines of some text and never come again so soon").capitalize() + ".") for k in range(150)]
    bad = [(1000 + k, "buy| now| " * rng.randrange(5, 30)) for k in range(80)]
    return spark.createDataFrame([(i, t, int(i < 1000)) for i, t in good + bad], "key bigint, text string, quality bigint")


def test_edge_cases(spark):
    model = train(labelled(spark))
    rows = [(1, "buy| now| " * 12), (2, None), (3, ""), (4, word_soup(random.Random(9), 40, "many different words that stand in plain lines of some text and never come again so soon").capitalize() + "."), (5, "word " * 300_000), (None, "buy| now| " * 12)]
    docs = docs_frame(spark, rows).withColumnsRenamed({"size": "quality_score", "lang": "statistics"})
    out = score(docs, model)
    assert out.columns == ["doc_id", "statistics", "source", "n_chars", "input_quality_score", "root", "quality_score"]
    got = {r["doc_id"]: r["quality_score"] for r in out.collect()}
    assert got[1] == got[None] < 0.3 < got[4] and got[2] == got[3] and all(0 <= v <= 1 for v in got.values())
    assert score(docs.limit(0), model).count() == 0


def test_ties_and_order_do_not_matter(spark):
    rows = labelled(spark)
    one, other = train(rows), train(rows.orderBy(F.desc("key")).repartition(5))
    assert one == other


def test_labels_of_one_kind(spark):
    model = train(labelled(spark).where("quality = 1"))
    assert not model.rules
    assert [round(r["quality_score"], 4) for r in score(docs_frame(spark, [(1, "x")]), model).collect()] == [round(150.5 / 151, 4)]
    assert train(labelled(spark).limit(0)).score(np.zeros((1, len(STATISTICS)))).tolist() == [0.5]


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    got = op13_rule_ensemble(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out")
    rate = {r["quality"]: r["p"] for r in got.groupBy("quality").agg(F.avg("predicted").alias("p")).collect()}
    assert rate[1] > 0.97 and rate[0] < 0.05
