"""Suffix-array dedup with a run-length index: long repeats are found and cut out.

Every WIDTH-byte string (window) picks the least hash of its ANCHOR-byte strings.  Neighbouring
windows that pick the same place form a piece, so equal windows lie in pieces with equal anchors.
Pieces of repeated anchors are dealt by anchor; equal pieces are counted as one beforehand.

In a bucket the different pieces are laid end to end, each with an end mark of its own, and their
suffixes are sorted.  The Burrows-Wheeler transform is reduced to its runs.  Only the suffixes at
which a run begins are kept, each with the suffix before it in order and the length they share:
from there on along the text these matching statistics just fall by one a byte, so streaming over
the samples gives the longest match of every position.  Matches of WIDTH bytes or more are marked.

An anchor with more than FEW different pieces would not fit a bucket; its windows are counted one
by one by hash instead, which any number of tasks can share.  Texts that occur more than once are
removed whole and take part once.

Defined results: null texts are empty; texts below WIDTH bytes are never touched;
repeated rows are copies of one another; nothing ever crosses documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm import textkit as tk
from veilspan.llm.common import all_met, map_batches, maybe_in, numbered, table
from veilspan.llm.scratch import cut, shuffle_partitions

WIDTH = 400
ANCHOR = 96
FEW = 1024
CHUNK = 1 << 21
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def pieces(data: np.ndarray, offsets: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, anchor's hash, content's hash) of every piece; places by row."""
    if len(data) < width:
        return tuple(np.empty(0, np.int64) for _ in range(3)) + tuple(np.empty(0, np.uint64) for _ in range(2))
    prefix = tk.Prefix(data)
    grams = prefix.windows(anchor)
    pick = tk.window_minima(grams, width - anchor + 1)[: len(data) - width + 1]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[: len(pick)] == row[width - 1 :]
    start = np.flatnonzero(inside & np.concatenate([[True], (pick[1:] != pick[:-1]) | ~inside[:-1]]))
    end = np.flatnonzero(inside & np.concatenate([(pick[1:] != pick[:-1]) | ~inside[1:], [True]]))
    rows = row[start]
    return rows, start - offsets[rows], end - offsets[rows], grams[pick[start]], prefix.ranges(start, end + width)


def suffix_array(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorted suffixes of pieces laid end to end; symbols are 1 to 256, and 0 at each end mark.

    End marks count as different symbols in page order.  Prefix doubling over the suffixes
    that are not yet in a place of their own.
    """
    n, first = len(symbols), 7
    padded = np.concatenate([symbols, np.zeros(first, symbols.dtype)]).astype(np.int64)
    to_end = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # symbols before the end mark
    key = np.zeros(n, np.int64)
    for k in range(first):
        key = (key << 9) | np.where(to_end >= k, padded[k : k + n], 0)
    sa = np.argsort(key, kind="stable")
    ended = to_end[sa] < first
    ordered = key[sa]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]) | ended[1:] | ended[:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
    h = first
    while len(slots):
        at = sa[slots]
        left, right = rank[at], rank[at + h]
        order = np.lexsort((right, left))
        at, left, right = at[order], left[order], right[order]
        sa[slots] = at
        new = np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        slots = slots[~(new & np.concatenate([new[1:], [True]]))]
        h *= 2
    return sa


def run_samples(symbols: np.ndarray, ends: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, the one before it in order) at the beginning of each run of the transform."""
    before = symbols[sa - 1].astype(np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    at_start = np.isin(sa, starts)
    before[at_start] = -1 - np.arange(at_start.sum())  # what precedes a piece is never the same
    head = np.flatnonzero(before[1:] != before[:-1]) + 1
    return sa[head], sa[head - 1]


def long_matches(bodies: list[bytes], width: int) -> list[list[tuple[int, int]]]:
    """Per piece, the runs (first, last) of window places that occur elsewhere in the pieces."""
    symbols = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.int16) + 1
    size = np.array([len(b) for b in bodies])
    ends = np.cumsum(size + 1) - 1
    symbols[ends] = 0
    p, q = run_samples(symbols, ends, suffix_array(symbols, ends))
    # Long matches first by hash, then byte by byte.
    data = np.where(symbols > 0, symbols - 1, 0).astype(np.uint8)
    room = np.minimum(ends[np.searchsorted(ends, p)] - p, ends[np.searchsorted(ends, q)] - q)
    p, q, room = p[room >= width], q[room >= width], room[room >= width]
    prefix = tk.Prefix(data)
    same = prefix.ranges(p, p + width) == prefix.ranges(q, q + width)
    p, q, room = p[same], q[same], room[same]
    diff = np.zeros(len(data) + 1, np.int64)
    for a in range(0, len(p), 2048):
        x, y, most = p[a : a + 2048], q[a : a + 2048], room[a : a + 2048]
        step = np.arange(int(most.max()))
        inside = step[None, :] < most[:, None]
        equal = inside & (data[np.minimum(x[:, None] + step, len(data) - 1)] == data[np.minimum(y[:, None] + step, len(data) - 1)])
        length = np.where(equal.all(1), equal.shape[1], equal.argmin(1))
        x, y, length = x[length >= width], y[length >= width], length[length >= width]
        for place in (x, y):
            np.add.at(diff, place, 1)
            np.add.at(diff, place + length - width + 1, -1)
    marked = np.concatenate([[False], np.cumsum(diff[:-1]) > 0, [False]])
    edge = np.diff(marked.astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    owner = np.searchsorted(ends, first)
    base = ends - size
    out: list[list[tuple[int, int]]] = [[] for _ in bodies]
    for k, a, b in zip(owner.tolist(), first.tolist(), last.tolist()):
        out[k].append((a - int(base[k]), b - int(base[k])))
    return out


def _indexed(width: int):
    def run(bucket: pa.Table) -> pa.Table:
        order = pc.sort_indices(bucket, [("anchor", "ascending"), ("content", "ascending")])
        bucket = bucket.take(order)
        anchors, contents, bodies = (bucket.column(c).to_pylist() for c in ("anchor", "content", "body"))
        out: list[tuple] = []
        begin = 0
        while begin < len(anchors):
            end, total = begin, 0
            while end < len(anchors) and (total < CHUNK or anchors[end] == anchors[end - 1]):
                total += len(bodies[end])
                end += 1
            for k, runs in enumerate(long_matches(bodies[begin:end], width), begin):
                out += [(anchors[k], contents[k], a, b) for a, b in runs]
            begin = end
        columns = list(zip(*out)) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=_RUN)

    return run


_RUN = ["anchor", "content", "first", "last"]
_RUN_SQL = "anchor bigint, content bigint, first int, last int"


def _scanned(width: int, anchor: int):
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for first, end, data, offsets in tk.slices(batch.column("_body")):
                th = batch.column("th").slice(first, end - first).to_numpy()
                row, a, b, gram, content = pieces(data, offsets, width, anchor)
                new = np.array([not (x in seen or seen.add(x)) for x in th.tolist()], bool)[row]
                row, a, b, gram, content = (v[new] for v in (row, a, b, gram, content))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(content.view(np.int64)), pa.array(th[row]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))],
                    names=["anchor", "content", "th", "a", "b"],
                )

    return run


def _cut_out(width: int):
    """Bytes of the asked pieces of each text."""

    def run(batch):
        for k in range(batch.num_rows):
            body = (batch.column("_body")[k].as_py() or "").encode()
            asked = batch.column("asked")[k].as_py()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x["anchor"] for x in asked], pa.int64()), pa.array([x["content"] for x in asked], pa.int64()),
                    pa.array([body[x["a"] : x["b"] + width] for x in asked], pa.binary()),
                ],
                names=["anchor", "content", "body"],
            )

    return run


def _window_hashes(width: int):
    def run(batch):
        for anchor, content, body in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "body"))):
            data = np.frombuffer(body, np.uint8)
            h = tk.Prefix(data).windows(width)
            n = len(h)
            again = tk.Prefix(data[::-1]).windows(width)[::-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([anchor] * n, pa.int64()), pa.array([content] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)),
                 pa.array(h.view(np.int64)), pa.array(again.view(np.int64))],
                names=["anchor", "content", "at", "h1", "h2"],
            )

    return run


def neighbours(windows: DataFrame) -> DataFrame:
    """Runs (anchor, content, first, last) of windows of a piece that lie next to each other."""
    order = Window.partitionBy("anchor", "content").orderBy("at")
    runs = windows.select("anchor", "content", "at", (F.col("at") - F.row_number().over(order)).alias("run"))
    return runs.groupBy("anchor", "content", "run").agg(F.min("at").alias("first"), F.max("at").alias("last")).drop("run")


def _removed(batch):
    """n_removed, n_spans and kept_sha256 of texts with their marked intervals."""
    out = []
    for row, th, body, spans in zip(*(batch.column(c).to_pylist() for c in ("_row", "th", "_body", "spans"))):
        body, reach, merged = (body or "").encode(), -1, []
        for s in sorted(spans, key=lambda s: (s["a"], s["b"])):
            if merged and s["a"] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s["b"])
            else:
                merged.append([s["a"], s["b"]])
        left, digest = 0, hashlib.sha256()
        for a, b in merged:
            digest.update(body[left:a])
            left = b
        digest.update(body[left:])
        out.append((row, th, sum(b - a for a, b in merged), len(merged), digest.hexdigest(), [{"a": a, "b": b} for a, b in merged]))
    columns = list(zip(*out)) or [[]] * 6
    span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["_row", "th", "cut_bytes", "cut_spans", "cut_sha", "cut"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, anchor: int = ANCHOR, few: int = FEW) -> DataFrame:
    """One row per document: the key, n_bytes, n_removed, n_spans, kept_sha256 and the cut spans."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    texts = numbered(docs.select(F.col(key).alias("_key"), body.alias("_body")), "_body")
    rows = cut(
        texts.select("_row", "_key", "th", F.octet_length("_body").cast("long").alias("n_bytes"), F.sha2(F.col("_body").cast("binary"), 256).alias("sha")),
        "rows",
    )
    found = cut(texts.select("_body", "th").mapInArrow(_scanned(width, anchor), "anchor bigint, content bigint, th bigint, a int, b int").distinct(), "pieces")
    repeated = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("content").alias("c1"), F.max("content").alias("c2")).where("n > 1")
    # Written first, so that the join is a plain one, of which a hot anchor's part can be split.
    repeated = cut(repeated.select("anchor", (F.col("c1") != F.col("c2")).alias("mixed")), "repeated")
    places = cut(found.join(repeated, "anchor"), "places")
    contents = cut(
        places.groupBy("anchor", "content", "mixed").agg(F.count("*").alias("n"), F.min(F.struct("th", "a", "b")).alias("p")), "contents"
    )
    # Different pieces of one anchor: fetch one copy of each.
    asked = contents.where("mixed").groupBy("p.th").agg(F.collect_list(F.struct("anchor", "content", "p.a", "p.b")).alias("asked"))
    stand = rows.groupBy("th").agg(F.min("_row").alias("_row"))
    asked = cut(asked.join(stand, "th"), "asked")
    crowded = contents.where("mixed").groupBy("anchor").agg(F.count("*").alias("d")).where(F.col("d") > few).select("anchor", F.lit(True).alias("crowded"))
    bodies = cut(
        map_batches(
            maybe_in(texts.select("_body", "_row", "th"), asked).join(asked, ["_row", "th"]).select("_body", "asked"),
            _cut_out(width), "anchor bigint, content bigint, body binary",
        ).join(crowded, "anchor", "left"),
        "bodies",
    )
    all_met(bodies.count(), contents.where("mixed").count(), "pieces of repeated anchors")
    buckets = 4 * shuffle_partitions(spark)
    runs = (
        bodies.where("crowded is null").select("anchor", "content", "body", F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("k"))
        .groupBy("k").applyInArrow(_indexed(width), _RUN_SQL)
    )
    hashes = map_batches(bodies.where("crowded").select("anchor", "content", "body"), _window_hashes(width), "anchor bigint, content bigint, at int, h1 bigint, h2 bigint")
    hashes = cut(hashes, "windows")
    twice = hashes.groupBy("anchor", "h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    runs = cut(runs.union(neighbours(hashes.join(twice, ["anchor", "h1", "h2"]))), "runs")
    # A piece with copies is marked whole at each place; the runs are asked only of those with one place.
    whole = contents.where("n > 1").select("anchor", "content")
    once = contents.where("n = 1").select("anchor", "content", "p.th", "p.a")
    marks = (
        places.join(whole, ["anchor", "content"]).select("th", "a", (F.col("b") + width).alias("b"))
        .union(once.join(runs, ["anchor", "content"]).select("th", F.col("a") + F.col("first"), F.col("a") + F.col("last") + width))
    )
    spans = cut(marks.distinct().groupBy("th").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")
    # Texts that occur twice go whole; of the others, those with marks are cut.
    copies = rows.groupBy("sha").agg(F.count("*").alias("copies")).where("copies > 1")
    rows = rows.join(copies, "sha", "left").withColumn("whole", F.col("copies").isNotNull() & (F.col("n_bytes") >= width))
    wanted = cut(rows.where("not whole").select("_row", "th").join(spans, "th"), "wanted")
    done = map_batches(
        maybe_in(texts.select("_body", "_row", "th"), wanted).join(wanted, ["_row", "th"]).select("_row", "th", "_body", "spans"),
        _removed, "_row bigint, th bigint, cut_bytes bigint, cut_spans bigint, cut_sha string, cut array<struct<a:int,b:int>>",
    )
    done = cut(done, "done")
    all_met(done.count(), wanted.count(), "texts with repeats")
    return rows.join(done, ["_row", "th"], "left").select(
        F.col("_key").alias(key),
        "n_bytes",
        F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.coalesce("cut_bytes", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("whole"), F.lit(1)).otherwise(F.coalesce("cut_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("whole"), F.lit(EMPTY_SHA)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.when(F.col("whole"), F.array(F.struct(F.lit(0).alias("a"), F.col("n_bytes").cast("int").alias("b"))))
        .otherwise(F.coalesce("cut", F.array().cast("array<struct<a:int,b:int>>")))
        .alias("cut"),
    )


def op2_run_length_index(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("cut")
