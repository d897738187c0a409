"""Long repeats against brute force, and the index against plain suffix sorting."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import docs_frame

from veilspan.llm import run_length_index
from veilspan.llm.run_length_index import long_matches, remove_repeats, run_samples, suffix_array
from veilspan.llm.scratch import cut

WIDTH, ANCHOR = 24, 6


def brute(rows):
    bodies = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + WIDTH] for b in bodies for k in range(len(b) - WIDTH + 1))
    out = []
    for (key, _), b in zip(rows, bodies):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - WIDTH + 1):
            if seen[b[k : k + WIDTH]] > 1:
                gone[k : k + WIDTH] = True
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((key, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def soup(rng, n):
    return "".join(rng.choice("abcdé \n") for _ in range(n))


def rows_of_all_kinds():
    rng = random.Random(3)
    passages = [soup(rng, n) for n in (20, 24, 30, 60, 200)]
    rows = [(k, soup(rng, rng.randint(0, 60)) + rng.choice(passages) + soup(rng, rng.randint(0, 60)) + rng.choice(passages)) for k in range(60)]
    rows += [(100 + k, soup(rng, 3) + passages[2] + soup(rng, 9)) for k in range(40)]  # a crowded passage
    rows += [(200, "a" * 300), (201, "ab" * 70), (202, "a" * 24), (203, "a" * 23), (204, "same " * 4), (204, "same " * 4)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (None, None), (302, None), (303, ""), (304, rows[5][1] + "!")]
    return rows


@pytest.mark.parametrize("few", [2, 1000])
def test_against_brute_force(spark, few):
    rows = rows_of_all_kinds()
    got = remove_repeats(docs_frame(spark, rows), width=WIDTH, anchor=ANCHOR, few=few).drop("cut")
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_spans_give_the_removed_bytes(spark):
    rows = [(1, "x" * 5 + "0123456789" * 3 + "q"), (2, "0123456789" * 3 + "zz"), (3, "clean")]
    got = {r["doc_id"]: r for r in remove_repeats(docs_frame(spark, rows), width=WIDTH, anchor=ANCHOR).collect()}
    assert [tuple(s) for s in got[1]["cut"]] == [(5, 35)] and [tuple(s) for s in got[2]["cut"]] == [(0, 30)] and got[3]["cut"] == []


def test_marks_do_not_grow_with_windows_or_copies(spark, monkeypatch):
    """A crowded passage: neighbouring windows are one mark, and copies of a piece do not meet its runs."""
    rng = random.Random(8)
    passage, shared = soup(rng, 300), soup(rng, 80)
    rows = [(k, soup(rng, 40) + passage + soup(rng, 40)) for k in range(20)]
    rows += [(100 + k, soup(rng, 40) + "|" + shared + passage + soup(rng, 40)) for k in range(20)]
    kept = {}

    def kept_cut(df, name):
        kept[name] = cut(df, name)
        return kept[name]

    monkeypatch.setattr(run_length_index, "cut", kept_cut)
    got = remove_repeats(docs_frame(spark, rows), width=WIDTH, anchor=ANCHOR, few=2).drop("cut")
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)
    pieces, contents = kept["pieces"].count(), kept["contents"].count()
    assert sum(len(r["spans"]) for r in kept["spans"].collect()) <= pieces
    assert kept["runs"].count() <= contents


def test_empty_table(spark):
    assert remove_repeats(docs_frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_suffix_order_and_samples():
    rng = random.Random(4)
    bodies = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(12)]
    symbols = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.int16) + 1
    ends = np.cumsum([len(b) + 1 for b in bodies]) - 1
    symbols[ends] = 0
    sa = suffix_array(symbols, ends)
    mark = {int(e): k for k, e in enumerate(ends)}
    tail = [tuple(mark[j] - 1000 if j in mark else int(symbols[j]) for j in range(i, len(symbols))) for i in range(len(symbols))]
    assert sa.tolist() == sorted(range(len(symbols)), key=tail.__getitem__)
    p, q = run_samples(symbols, ends, sa)
    assert 0 < len(p) < len(symbols) and all(tail[b] < tail[a] for a, b in zip(p, q))


def test_long_matches():
    assert long_matches([b"xxabcdefyy", b"abcdef", b"zz"], 5) == [[(2, 3)], [(0, 1)], []]
    assert long_matches([b"aaaaaaa"], 5) == [[(0, 2)]]
    assert long_matches([b"abcd"], 5) == [[]]
