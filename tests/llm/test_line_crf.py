"""Plain measures against brute force; the random field against enumeration."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import docs_frame

from veilspan.llm import textkit as tk
from veilspan.llm.line_crf import FEATURES, Crf, fit, judge, measure, train, viterbi

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words, seen, repeats = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), repeats, len(covered)


def texts():
    rng = random.Random(1)
    fixed = [None, "", " \n", "a", "a\na", "a\n\na\n a", "\n\na b\na b\n", "é ü|<\n" * 4, "x " * 30, "a b c d e a b c d e", "a\r\na\n", "word " * 5000]
    return fixed + ["".join(rng.choice("ab \n\té|") for _ in range(rng.randint(0, 60))) for _ in range(300)]


def test_measures():
    for limit in (50, 1 << 20):
        got = []
        for _, _, data, offsets in tk.slices(pa.array(texts()), limit):
            m = measure(data, offsets)
            got += zip(*(v.tolist() for v in (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)))
            assert m.x.shape == (len(m.line_row), len(FEATURES)) and np.isfinite(m.x).all()
        assert got == [brute(t) for t in texts()]


def best_labels(scores, steps):
    ways = itertools.product((0, 1), repeat=len(scores))
    total = lambda w: sum(scores[i, a] for i, a in enumerate(w)) + sum(steps[a, b] for a, b in zip(w, w[1:]))
    return list(max(ways, key=total))


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(2)
    length = np.array([1, 6, 0, 3, 9])
    start = np.cumsum(length) - length
    scores, steps = rng.normal(size=(length.sum(), 2)), rng.normal(size=(2, 2))
    got = viterbi(scores, start, length, steps)
    for a, n in zip(start, length):
        assert got[a : a + n].tolist() == best_labels(scores[a : a + n], steps)


def test_fit_learns_labels_and_their_order():
    rng = np.random.default_rng(3)
    length = rng.integers(1, 12, 200)
    start = np.cumsum(length) - length
    y = np.concatenate([np.repeat(rng.integers(0, 2), n) for n in length])
    x = np.stack([np.ones(len(y)), y + rng.normal(size=len(y))], 1)
    model = fit(x, y, start, length)
    assert model.steps[0, 0] > model.steps[0, 1] and model.steps[1, 1] > model.steps[1, 0]
    assert (viterbi(x @ model.weights.T, start, length, model.steps) == y).mean() > 0.9 > ((x[:, 1] > 0.5) == y).mean()


def test_rules_and_nulls(spark):
    good = " ".join(f"word{k}" for k in range(40))
    rows = [(1, good), (1, good), (2, "few words here"), (3, "the same five words again " * 9), (None, None), (5, ""), (6, good + "\n" + "x" * 100_000)]
    got = {(r["doc_id"], r["base_failed"], r["kept"]) for r in judge(docs_frame(spark, rows).select("doc_id", "text"), None).collect()}
    assert got == {(1, False, True), (2, True, False), (3, True, False), (None, True, False), (5, True, False), (6, False, True)}
    assert judge(docs_frame(spark, rows).limit(0), None).count() == 0


def test_all_boilerplate_is_not_kept(spark):
    weights = np.zeros((2, len(FEATURES)))
    weights[0, 0] = 1.0
    text = " ".join(f"word{k}" for k in range(40))
    row = judge(docs_frame(spark, [(1, text)]).select("doc_id", "text"), Crf(weights, np.zeros((2, 2)))).first()
    assert not row["kept"] and not row["base_failed"] and row["content_share"] == 0.0 and row["n_boilerplate_lines"] == 1


def test_trained_verdicts(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    rows = docs.join(labels, "doc_id")
    model = train(rows.withColumnRenamed("doc_id", "key"))
    got = judge(rows, model).where("not base_failed").groupBy("quality").agg({"kept": "count", "content_share": "avg"}).collect()
    kept = {r["quality"]: r for r in judge(rows, model).where("not base_failed").selectExpr("quality", "int(kept) as k").groupBy("quality").avg("k").collect()}
    assert len(got) == 2 and kept[1]["avg(k)"] > 0.97 and kept[0]["avg(k)"] < 0.2
    assert train(rows.where("quality = 1").withColumnRenamed("doc_id", "key")) is None
