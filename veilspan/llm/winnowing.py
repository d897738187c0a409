"""Benchmark decontamination by winnowing.

Of every SPAN - GRAM + 1 neighbouring GRAM-word hashes the least is kept, so any SPAN words that a
document shares with an item share a kept hash at the same place.  Fingerprints of both sides are
joined, and each hit is extended word by word, as text; a run of SPAN equal words is a match.
Items of fewer than SPAN words have one fingerprint, the whole item, looked up at every position.

A bitmap of BITMAP_BITS bits over the benchmark's fingerprints, 8 MB whatever the benchmark's
size, keeps fingerprints that cannot match from leaving the task that made them.

Defined results: null texts have no words, items without words match nothing; repeated items with
one item_id count once, a null item_id is listed as the empty string; repeated document rows are
judged one by one; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import textkit as tk
from veilspan.llm.common import bitmap, free_name, in_bitmap, listed, numbered, set_aside, shielded, table, without
from veilspan.llm.scratch import cut

SPAN = 13
GRAM = 7
LEFT = SPAN - GRAM

_CANDIDATE = pa.struct([("fp", pa.int64()), ("pos", pa.int32()), ("width", pa.int32()), ("lo", pa.int32()), ("ctx", pa.string())])
_CANDIDATES_SQL = "array<struct<fp:bigint,pos:int,width:int,lo:int,ctx:string>>"


def _fingerprints(hashes: np.ndarray, row: np.ndarray, widths: list[int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(width in words, first word, fingerprint): the kept grams, then all runs of the short widths."""
    found = []
    at, h = tk.grams(hashes, row, GRAM)
    if len(h) >= LEFT + 1:
        # Minima that straddle rows are kept as well: more than needed, never less.
        kept = np.unique(tk.window_minima(h, LEFT + 1))
        found.append((GRAM, at[kept], tk.mix(h[kept])))
    for width in widths:
        at, h = tk.grams(hashes, row, width)
        found.append((width, at, tk.mix(h + np.uint64(width * 2 + 1))))
    return found


def _scan(batches, others: list[str], text: str, widths: list[int], bits: np.ndarray | None, items: bool):
    """Rows with n_words and fingerprints with up to LEFT words of context on either side."""
    for batch in batches:
        for first, end, data, offsets in tk.slices(batch.column(text)):
            low = tk.LOWER[data]
            starts, ends, row = tk.words(low, offsets, tk.ALNUM)
            n_rows = end - first
            n_words = tk.per_row(row, n_rows)
            hashes = tk.Prefix(low).ranges(starts, ends)
            first_word = np.concatenate([[0], np.cumsum(n_words)])
            rows, cells = [], []
            for width, at, fp in _fingerprints(hashes, row, widths):
                if items:  # short items have their own width only, longer ones only kept grams
                    n = n_words[row[at]]
                    own = n >= SPAN if width == GRAM and not len(widths) else n == width
                    at, fp = at[own], fp[own]
                elif bits is not None:
                    hit = in_bitmap(bits, fp)
                    at, fp = at[hit], fp[hit]
                reach = LEFT if width == GRAM and (not items or not len(widths)) else 0
                for w, f in zip(at.tolist(), fp.view(np.int64).tolist()):
                    r = int(row[w])
                    lo, hi = max(w - reach, int(first_word[r])), min(w + width + reach, int(first_word[r + 1]))
                    ctx = b" ".join(low[a:b].tobytes() for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist()))
                    rows.append(r)
                    cells.append({"fp": f, "pos": w - int(first_word[r]), "width": width, "lo": w - lo, "ctx": ctx.decode("utf-8", "replace")})
            order = np.argsort(np.asarray(rows, np.int64), kind="stable").tolist()
            part = batch.slice(first, n_rows)
            counts = tk.per_row(np.asarray(rows, np.int64), n_rows) if rows else np.zeros(n_rows, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in others), pa.array(n_words, pa.int64()), listed([cells[i] for i in order], counts, _CANDIDATE)],
                names=[*others, "n_words", "cands"],
            )


def _extended(batches):
    """Of joined fingerprints, the runs of equal words that are whole matches."""
    for batch in batches:
        c = {n: batch.column(n).to_pylist() for n in ("_row", "pos", "width", "lo", "ctx", "b_lo", "b_ctx", "ctx_id", "whole")}
        out: list[tuple] = []
        for row, pos, width, lo, ctx, b_lo, b_ctx, ctx_id, whole in zip(*c.values()):
            a, b = ctx.split(" "), b_ctx.split(" ")
            if a[lo : lo + width] != b[b_lo : b_lo + width]:
                continue
            left = 0
            while left < min(lo, b_lo) and a[lo - left - 1] == b[b_lo - left - 1]:
                left += 1
            i, j, right = lo + width, b_lo + width, 0
            while i + right < len(a) and j + right < len(b) and a[i + right] == b[j + right]:
                right += 1
            if whole:
                left = right = 0
            if whole or left + width + right >= SPAN:
                out.append((row, pos - left, pos + width + right, ctx_id))
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64())],
            names=["_row", "start", "end", "ctx_id"],
        )


def _item_windows(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item_id, fp, width, lo, ctx, whole) of all items."""
    items = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item_id"), F.col(text).alias("_body"))
    schema = f"item_id string, n_words bigint, cands {_CANDIDATES_SQL}"
    long = items.mapInArrow(lambda b: _scan(b, ["item_id"], "_body", [], None, True), schema)
    short = items.mapInArrow(lambda b: _scan(b, ["item_id"], "_body", list(range(1, SPAN)), None, True), schema)
    both = long.withColumn("whole", F.lit(False)).unionByName(short.where(f"n_words < {SPAN}").withColumn("whole", F.lit(True)))
    return both.select("item_id", "whole", F.explode("cands").alias("c")).select("item_id", "whole", "c.fp", "c.width", F.col("c.lo").alias("b_lo"), F.col("c.ctx").alias("b_ctx"))


_RESULTS = ["_row", "cands", "n_words", "n_hit", "items", "n_items", "items_sha256", "contaminated"]


def find_overlaps(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: the kept columns, n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    windows = cut(_item_windows(items, item, item_text), "windows").withColumn("ctx_id", F.xxhash64("fp", "b_lo", "b_ctx", "whole"))
    widths = [r[0] for r in windows.where("whole").select("width").distinct().collect()]  # at most 12
    shared = spark.sparkContext.broadcast(bitmap(windows, "fp"))
    # Kept columns that are named like results come back as ``input_<name>``.
    body = free_name(docs, "_body")
    rows = set_aside(docs.select(*keep, F.col(text).alias(body)), _RESULTS, body)
    columns = [c for c in rows.columns if c != body]

    def scan(batches):
        yield from _scan(batches, [*columns, "_row"], body, widths, shared.value, False)

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*columns).schema)
    bodies = rows.withColumn("_row", F.monotonically_increasing_id())
    scanned = cut(bodies.mapInArrow(scan, f"{kept}_row bigint, n_words bigint, cands {_CANDIDATES_SQL}"), "scanned")
    shared.destroy()
    return summed(scanned, windows)


def summed(scanned: DataFrame, windows: DataFrame) -> DataFrame:
    found = scanned.where("size(cands) > 0").select("_row", F.explode("cands").alias("c")).select("_row", "c.*")
    # Items that share a stretch of text are compared once.
    stretches = windows.select("fp", "width", "whole", "b_lo", "b_ctx", "ctx_id").distinct()
    runs = cut(
        found.join(stretches, ["fp", "width"]).mapInArrow(_extended, "_row bigint, start int, end int, ctx_id bigint"), "runs"
    )
    covered = (
        runs.groupBy("_row")
        .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("r"))
        .select(
            "_row",
            F.expr(
                "aggregate(r, named_struct('n', 0L, 'reach', 0), (s, x) -> named_struct("
                "'n', s.n + greatest(0, x.end - greatest(s.reach, x.start)), 'reach', greatest(s.reach, x.end)), s -> s.n)"
            ).alias("n_hit"),
        )
    )
    named = (
        runs.select("_row", "ctx_id").distinct()
        .join(windows.select("ctx_id", "item_id").distinct(), "ctx_id")
        .groupBy("_row")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return (
        scanned.drop("cands")
        .join(covered, "_row", "left")
        .join(named, "_row", "left")
        .withColumns(
            {
                "n_hit": n_hit,
                "n_items": F.size(items).cast("long"),
                "items_sha256": F.sha2(F.array_join(items, ",").cast("binary"), 256),
                "contaminated": (n_hit > 0) & (20 * n_hit >= F.col("n_words")),
            }
        )
        .drop("items")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    docs, names = shielded(docs, text)
    rows = numbered(docs, text)
    judged = find_overlaps(rows.select(F.col(text).alias("text"), F.col("_row").alias("_at"), "th"), items, ["_at", "th"])
    gone = judged.where("contaminated").select(F.col("_at").alias("_row"), "th")
    return without(rows, docs.columns, cut(gone, "gone")).withColumnsRenamed(names)


def op4_winnowing(spark, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return find_overlaps(docs, items, ["doc_id"]).drop("_row")


OP4_SQL = r"""
with words as (
  select 'd' as side, doc_id::varchar as id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all
  select 'b', item_id::varchar, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
item_windows as (
  select distinct id as item_id, least(len(w), 13) as k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as g
  from words, unnest(range(1, len(w) - least(len(w), 13) + 2)) as t(i) where side = 'b' and len(w) > 0),
widths as (select distinct k from item_windows),
doc_windows as (
  select id, i, k, array_to_string(w[i:i + k - 1], ' ') as g
  from words, widths, unnest(range(1, greatest(len(w) - k + 2, 1))) as t(i) where side = 'd' and len(w) >= k),
found as (select id, i, d.k, item_id from doc_windows d join item_windows b on d.k = b.k and d.g = b.g),
hit as (select id, count(distinct j)::bigint as n from found, unnest(range(i, i + k)) as t(j) group by id),
listed as (select id, count(distinct item_id)::bigint as n,
  string_agg(distinct item_id, ',' order by item_id) as s from found group by id)
select doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(l.n, 0)::bigint as n_items,
  sha256(coalesce(l.s, '')) as items_sha256, coalesce(h.n, 0) > 0 and 20 * coalesce(h.n, 0) >= len(w) as contaminated
from documents join words on side = 'd' and id = doc_id::varchar left join hit h using (id) left join listed l using (id)
"""
