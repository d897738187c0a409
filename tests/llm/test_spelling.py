from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import docs_frame
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspan.llm import textkit as tk
from veilspan.llm.spelling import SortedBlocks, crc32, forms, near_words, slice_words, vocabulary


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_words(rows, least=7, times=2, noise=31):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += len(run) >= least
    return {w: n for w, n in total.items() if n >= times}


def plain_forms(words, ratio=10):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def test_crc_of_ranges():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 5000, 400)
    end = np.minimum(start + rng.integers(0, 200, 400), 5000)
    begun = np.array([zlib.crc32(str(k).encode()) for k in range(400)], np.uint32)
    want = [zlib.crc32(str(k).encode() + data[a:b].tobytes()) for k, (a, b) in enumerate(zip(start, end))]
    assert crc32(data, start, end, begun).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abAZé×ÿÞß€ 1x𝄞", max_size=40), min_size=1, max_size=8), st.sampled_from([1, 2, 3, None]))
def test_runs_with_noise(texts, noise):
    rows = list(enumerate(texts))
    begun = np.array([zlib.crc32(f"{k}:".encode()) for k, _ in rows], np.uint32)
    got = Counter()
    for first, end, data, offsets in tk.slices(pa.array(texts), 30):
        got.update(slice_words(data, offsets, begun[first:end], 3, noise).to_pylist())
    assert got == {w: n for w, n in plain_words(rows, 3, 1, noise).items()}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.text("abé", max_size=6), min_size=1, max_size=25), min_size=1, max_size=4), st.sampled_from([3, 50, 10_000]))
def test_blocks_equal_brute_force(blocks, limit):
    words = [w for b in blocks for w in sorted(b)]
    block = np.repeat(np.arange(len(blocks)), [len(b) for b in blocks])
    got = sorted((i, j) for x, y in SortedBlocks(pa.array(words, pa.string()), block).near(limit) for i, j in zip(x.tolist(), y.tolist()))
    assert got == [(i, j) for i in range(len(words)) for j in range(len(words)) if block[i] == block[j] and one_edit(words[i], words[j])]


def frame(spark, words):
    return spark.createDataFrame(sorted(words.items()), "word string, n bigint")


def variants(rng, n, letters="abcde", least=7, most=10):
    words = {}
    while len(words) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(least, most))) if rng.random() < 0.2 or not words else rng.choice(sorted(words))
        k = rng.randrange(len(w) + 1)
        w = w[:k] + rng.choice(["", rng.choice(letters)]) + w[k + rng.randrange(2) :]
        if len(w) >= least:
            words[w] = int(2 * 10 ** rng.uniform(0, 5))
    return words


def test_forms_equal_brute_force(spark):
    words = variants(random.Random(3), 700)
    want = plain_forms(words)
    assert len({r for _, f, r, *_ in want if f is not None and f != r}) > 10  # chains
    for most in (2_000, 40, 3):  # small limits: crowded blocks are halved down to one place
        got = forms(frame(spark, words), most=most)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(words)


def test_words_of_any_length(spark):
    long = "x" * 3000
    words = {"a": 3, "b": 40, "": 5, "ab": 2, long: 2, long + "y": 90, "y" + long: 900, long[1:]: 4, "z" * 70: 8, "z" * 71: 80}
    assert {tuple(r) for r in forms(frame(spark, words)).collect()} == plain_forms(words)


def test_a_crowded_prefix(spark):
    """A third of the words and more share all but their last code points."""
    rng = random.Random(4)
    words = {"commonbeginning" + "".join(rng.choice("abcdefgh") for _ in range(4)): rng.randrange(2, 90) for _ in range(1500)}
    words |= variants(rng, 300)
    got = near_words(frame(spark, words), most=100).collect()
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    assert {r["word"]: r["n_near"] for r in got} == {w: len(v) for w, v in near.items()}
    assert all(r["near"] == min(near[r["word"]], key=lambda v: (-words[v], v), default=None) for r in got)


def test_vocabulary_of_documents(spark):
    rng = random.Random(5)
    base = ["Recherche", "décembre", "SCHÖNHEIT", "attionble", "abcdefg", "abcdefgh", "ÀÉÎõü×÷ÿ", "short"]
    rows = [(k, " ".join(rng.choice(base) for _ in range(60))) for k in range(60)]
    rows += [(None, "Recherche recherche"), (None, "Recherche"), (7, None), (8, ""), (9, "abcdefgh" * 40_000), (9, "abcdefgh" * 40_000), (3, rows[3][1])]
    docs = docs_frame(spark, rows).withColumnsRenamed({"lang": "word", "size": "n"})
    got = vocabulary(docs, "doc_id")
    want = plain_words(rows)
    assert {r["word"]: r["n"] for r in got.collect()} == want and len(want) > 15
    assert {tuple(r) for r in forms(got).collect()} == plain_forms(want)
    assert {r["word"]: r["n"] for r in vocabulary(docs, "doc_id", noise=None, least=3, times=1).collect()} == plain_words(rows, 3, 1, None)


def test_a_word_given_twice(spark):
    words = spark.createDataFrame([("", 1), ("", 2), ("abcdefg", 3), ("abcdefg", 4), ("abcdefgh", 90)], "word string, n bigint")
    assert {(r["word"], r["n"], r["near"]) for r in near_words(words).collect()} == {("", 3, None), ("abcdefg", 7, "abcdefgh"), ("abcdefgh", 90, "abcdefg")}


def test_empty_tables(spark):
    assert vocabulary(docs_frame(spark, []), "doc_id").count() == 0
    assert forms(spark.createDataFrame([], "word string, n bigint")).count() == 0
    one = forms(spark.createDataFrame([("lonely", 2)], "word string, n bigint")).collect()
    assert [tuple(r) for r in one] == [("lonely", None, "lonely", 2, 0, None)]
