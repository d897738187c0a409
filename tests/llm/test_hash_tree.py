from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

from helpers import docs_frame
from pyspark.sql import functions as F

from veilspan.llm.hash_tree import Shard, layout, number, place, shard_of


def test_contract(spark):
    rows = [(k, f"text {k}" if k % 7 else None) for k in range(6000)] + [(5, "text 5"), (5, "text 5"), (None, "x"), (None, "é")]
    got = number(place(docs_frame(spark, rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        body = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(body) + 8, zlib.crc32(body), "key")
        assert r["grown_shard"] in (r["shard"], 24)
    slots: dict = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(24))
    assert max(map(len, slots.values())) < 2 * min(map(len, slots.values()))
    assert len({r["shard"] for r in got if r["doc_id"] == 5}) == len({r["shard"] for r in got if r["doc_id"] is None}) == 1
    assert 100 < sum(r["grown_shard"] == 24 for r in got) < 500


def test_weights_and_confined_movement(spark):
    tree = [Shard(0, 0, 0, 1), Shard(0, 0, 1, 3), Shard(0, 1, 2, 2), Shard(1, 2, 3, 2), Shard(1, 3, 4, 0), Shard(2, 4, 5, 4)]
    heavier = [Shard(0, 0, 0, 1), Shard(0, 0, 1, 9), *tree[2:]]
    keys = spark.range(20000).select(shard_of(F.col("id"), tree).alias("a"), shard_of(F.col("id"), heavier).alias("b")).collect()
    counts = Counter(r["a"] for r in keys)
    assert 4 not in counts
    for leaf in tree:
        assert abs(counts[leaf.shard] - 20000 * leaf.weight / 12) < 500
    region = {0: 0, 1: 0, 2: 0, 3: 1, 5: 2}
    # Nothing moves between regions whose weights stay.
    assert all(region[r["a"]] == region[r["b"]] or region[r["b"]] == 0 for r in keys)


def test_layout_grows_by_a_region():
    assert layout(25)[:24] == layout(24) and layout(25)[24].region == 3
    assert [s.shard for s in layout(31)] == list(range(31)) and len({s.region for s in layout(31)}) == 10
    assert len({(s.region, s.rack) for s in layout(24)}) == 6


def test_empty_table_and_tree(spark):
    assert number(place(docs_frame(spark, [(1, "a")]).limit(0))).count() == 0
    assert spark.range(1).select(shard_of(F.col("id"), []).alias("s")).first()["s"] is None


def plain_shard(key, tree):
    """The descent for one key: the child of the least draw, level by level."""
    leaves = [x for x in tree if x.weight > 0]
    names = [lambda x: f"r{x.region}", lambda x: f"r{x.region}/k{x.rack}", lambda x: f"{x.shard}"]
    for name in names:
        weights: dict = {}
        for x in leaves:
            weights[name(x)] = weights.get(name(x), 0.0) + x.weight
        text = "null" if key is None else str(key)
        draws = {}
        for child, weight in weights.items():
            bits = int(hashlib.md5(f"{text}:{child}".encode()).hexdigest()[:13], 16)
            draws[child] = -math.log((bits + 0.5) / 2**52) / weight
        chosen = min(draws, key=lambda c: (draws[c], c))
        leaves = [x for x in leaves if name(x) == chosen]
    return leaves[0].shard


def test_descent_equals_a_plain_version(spark):
    keys = [*range(500), 10**15, -7, None]
    trees = [layout(24), layout(25), layout(40), [Shard(0, 0, 0, 1), Shard(0, 1, 1, 3.5), Shard(1, 2, 2, 0), Shard(1, 2, 3, 2), Shard(4, 9, 7, 0.25)]]
    for tree in trees:
        got = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", shard_of(F.col("k"), tree).alias("s")).collect()
        assert [r["s"] for r in got] == [plain_shard(r["k"], tree) for r in got]
