"""Targets against repeated resharing, and the mix's promises."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from helpers import docs_frame, word_soup

from veilspan.llm.mixing import draw, measure, mix, targets


def reshared(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    out, full, left = {}, set(), float(sum(sizes.values()))
    while True:
        open_ = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            full.add(s)
            left -= out[s]


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{k}": rng.choice([0, 1, 5, 40, 1000, 90000]) for k in range(7)} | {None: rng.randint(0, 50)}
    got = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint"))
    want = reshared(sizes)
    assert {r["source"]: r["target"] for r in got.collect()} == pytest.approx(want)


def documents():
    rng = random.Random(2)
    rows = [(k, word_soup(rng, rng.randint(1, 9))) for k in range(900)] + [(k, word_soup(rng, 90)) for k in range(1, 400, 3)]
    return rows + [(2000, None), (2001, ""), (None, "a b"), (7, "twice"), (7, "twice"), (2003, " ### 123 %% ")]


def test_mix(spark):
    docs = docs_frame(spark, documents())
    rows = mix(measure(docs)).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, len((t or "").split())) for i, t in documents())
    largest = max(r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert {r["source_size"] for r in own} == {sum(r["size"] for r in own)}
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= largest
        # Complete epochs first: the numbers of copies differ by one at most.
        copies = {r["taken"] // r["size"] for r in own if r["size"]}
        assert max(copies) - min(copies) <= 1 and max(copies) <= 3
    assert sorted(map(str, mix(measure(docs)).collect())) == sorted(map(str, rows))


def test_better_prose_is_drawn_more_often(spark):
    rows = [(3 * k, "plain words only " * 3 if k % 2 else "9$ 8% 7# 6& 5* " * 2) for k in range(800)] + [(3 * k + 1, "other text") for k in range(800)]
    got = [r for r in mix(measure(docs_frame(spark, rows))).collect() if r["source"] == "src0" and r["size"]]
    taken = Counter((r["size"] == 9, r["taken"] > 0) for r in got)
    assert taken[True, True] / 400 > 1.5 * taken[False, True] / 400


def test_draw_repeats_rows(spark):
    docs = docs_frame(spark, documents())
    want = Counter()
    for r in mix(measure(docs)).collect():
        want[r["doc_id"], r["size"]] += r["copies"]
    drawn = draw(docs)
    assert drawn.columns == docs.columns
    assert Counter((r["doc_id"], len((r["text"] or "").split())) for r in drawn.collect()) == +want


def test_empty_table(spark):
    assert mix(measure(docs_frame(spark, [(1, "a")]).limit(0))).count() == 0
