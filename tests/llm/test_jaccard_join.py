"""Near-duplicate classes against brute force, and components on hard shapes."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs_frame, word_soup

from veilspan.llm import common, jaccard_join
from veilspan.llm import textkit as tk
from veilspan.llm.components import components
from veilspan.llm.jaccard_join import keep_one, link_documents, shingle_sets
from veilspan.llm.scratch import cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((key, len(s), least.get(find(i)) if s else key) for i, ((key, _), s) in enumerate(zip(rows, sets))), key=repr)


def cases():
    rng = random.Random(9)
    vocabulary = " ".join(f"w{k}" for k in range(400))
    rows = []
    for base in range(6):
        text = word_soup(rng, 60, vocabulary).split()
        for copy in range(14):
            edited = [rng.choice(vocabulary.split()) if rng.random() < 0.02 else w for w in text]
            rows.append((100 * base + copy, " ".join(edited)))
    passage = word_soup(rng, 40, vocabulary)
    rows += [(1000 + k, word_soup(rng, 12, vocabulary) + " " + passage + " " + word_soup(rng, 12, vocabulary)) for k in range(30)]
    chain = [f"c{k}" for k in range(60)]
    rows += [(2000 + k, " ".join(chain[k : k + 40])) for k in range(0, 20, 2)]  # neighbours link, ends do not
    rows += [(3000, "One two"), (3001, "one  TWO"), (3002, "one two three"), (3003, None), (3004, ""), (3005, " "), (None, "one two"), (3006, "É x y z w"), (3007, "é x y z w")]
    rows += [(3008, "a b c d e"), (3008, "a b c d e"), (3009, "A b c\nd e"), (3010, "word " * 5000), (3011, "word " * 9)]
    return rows


@pytest.mark.parametrize("few", [2, 24])
def test_against_brute_force(spark, few):
    rows = cases()
    got = link_documents(docs_frame(spark, rows), few=few).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_one_of_each_class_stays(spark):
    rows = cases()
    kept = keep_one(docs_frame(spark, rows))
    want = sorted({c for k, n, c in brute(rows) if n and c is not None} | {k for k, n, _ in brute(rows) if not n}, key=repr)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == want
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "root"]


def test_small_inputs_ask_little_of_the_driver(spark, monkeypatch):
    """Bitmaps follow the number of values sought, and crowded shingles of one share have one round."""
    tables, sought = [], []

    def kept_cut(df, name):
        tables.append(name)
        return cut(df, name)

    def kept_bitmap(*args):
        sought.append(common_bitmap(*args))
        return sought[-1]

    common_bitmap = common.bitmap
    monkeypatch.setattr(jaccard_join, "cut", kept_cut)
    monkeypatch.setattr(common, "bitmap", kept_bitmap)  # the one that sieves use
    rows = cases()
    kept = keep_one(docs_frame(spark, rows)).count()
    assert kept == len({c for k, n, c in brute(rows) if n and c is not None} | {k for k, n, _ in brute(rows) if not n})
    assert sought and sum(b.nbytes for b in sought) < 1 << 20
    assert tables.count("neighbours") == 1 and tables.count("open") <= 2


def test_two_rounds_for_shingles_of_several_shares(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHARE", 4)
    rows = cases()
    got = link_documents(docs_frame(spark, rows), few=2).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_empty_table(spark):
    assert link_documents(docs_frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_shingle_sets():
    texts = [t for _, t in cases()]
    for _, _, data, offsets in tk.slices(pa.array(texts)):
        rows, hashes, counts = shingle_sets(data, offsets)
        assert counts.tolist() == [len(shingles(t)) for t in texts]
        assert (np.diff(rows) >= 0).all()


def test_components(spark):
    rng = random.Random(1)
    path = [(k, k + 1) for k in range(40)]
    star = [(100, 101 + k) for k in range(30)]
    loops = [(rng.randint(200, 240), rng.randint(200, 240)) for _ in range(40)]
    links = path + [(b, a) for a, b in star] + [(a, b) for a, b in loops if a != b]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    parent = {x: x for e in links for x in e}
    for _ in range(60):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent
    assert components(spark.createDataFrame(links, "a bigint, b bigint").limit(0)).count() == 0
