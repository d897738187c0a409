from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from helpers import docs_frame
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspan.llm import boundaries
from veilspan.llm.boundaries import _ARRAY, _BITMAP, _RUNS, BoundarySet, restored, transform


def test_containers_of_each_kind():
    rng = np.random.default_rng(1)
    few = np.sort(rng.choice(1 << 16, 900, replace=False))
    many = (1 << 16) + np.sort(rng.choice(1 << 16, 30_000, replace=False))
    runs = (5 << 16) + np.concatenate([np.arange(100, 9000), np.arange(20_000, 65_536)])
    whole = (6 << 16) + np.arange(1 << 16)
    positions = np.concatenate([few, many, runs, whole])
    found = BoundarySet(positions)
    assert [c.kind for c in found.containers] == [_ARRAY, _BITMAP, _RUNS, _RUNS]
    assert (found.select(np.arange(len(positions))) == positions).all()
    some = rng.integers(0, len(positions), 5000)
    assert (found.select(some) == positions[some]).all()


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 1 << 18), min_size=1, max_size=300), st.integers(0, 1 << 18), st.integers(1, 9000))
def test_select_equals_sorted_members(points, start, length):
    members = np.array(sorted(points | set(range(start, start + length))))
    assert (BoundarySet(members).select(np.arange(len(members))) == members).all()


def plain_result(key, text):
    """The contract, one text at a time."""
    text = text or ""
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or re.search("<[PSM]>", text):
        return len(lines), "plain", None, None, text
    if h4 % 100 < 50:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_equals_a_plain_version(spark):
    rng = random.Random(2)
    rows = [(k, "".join(rng.choice(["\n", "a", "é", "€", "𝄞", "\r", " ", " <", "P>", "\x00"]) for _ in range(rng.randrange(60)))) for k in range(400)]
    rows += [(1000, None), (1001, ""), (None, "a\nb\nc"), (1002, "\n" * 70_000), (1003, "x\n" * 90_000 + "y" * 200_000), (1004, "a<M>b"), (5, "tie\ntie"), (5, "tie\ntie")]
    rows += [(2000 + k, "line\n" * rng.randrange(4000)) for k in range(60)]
    docs = docs_frame(spark, rows)
    out = transform(docs, "doc_id")
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "size", "root", "n_lines", "form", "prefix_chars", "middle_chars", "output"]
    got = out.select("doc_id", "n_lines", "form", "prefix_chars", "middle_chars", "output", restored(out.form, out.output).alias("back")).collect()
    want = [(k, *plain_result(k, t), t or "") for k, t, *_ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_rate_and_clashing_names(spark):
    docs = docs_frame(spark, [(k, "one\ntwo\nthree") for k in range(300)])
    plain = transform(docs, "doc_id", rate=30).where("form = 'plain'").count()
    assert 180 < plain < 240
    clash = docs.withColumnsRenamed({"lang": "form", "source": "draws", "size": "OUTPUT"})
    got = transform(clash, "doc_id")
    assert got.columns[:6] == ["doc_id", "input_form", "draws", "n_chars", "input_OUTPUT", "root"]
    assert got.where("draws = 'src' || doc_id % 3 and input_OUTPUT = 'x' and length(output) > 10").count() == 300


def test_empty_table(spark):
    assert transform(docs_frame(spark, []), "doc_id").count() == 0
    assert isinstance(boundaries.OP12_SQL, str)
