"""Grouping of spelling variants: words one inserted, deleted or replaced code point apart.

Two such words share all but a small part around the edit.  Each word therefore joins blocks of words
that agree outside a region: first the two halves, by the shorter length of a pair; blocks of more
than MOST_IN_BLOCK words are dealt anew by halves of their region, until blocks are small or the region is
one code point wide, where the alphabet bounds them.  A pair is found in the one block whose region
holds the first place where both differ, so none is lost and none is met twice.

In a block the sorted words are scanned as a tree of shared prefixes, which the longest common prefixes of
neighbours describe.  For a word that is looked up, the row of its edit matrix, a band of three cells, is worked
out once a prefix and reused by every word below it; a prefix whose row is above one edit everywhere
is left with its whole range of words.  All words of some blocks are looked up together.

Forms: a word's form is its near word of the largest count (ties: the least in code-point order) if that is at
least RATIO times the word's own; following forms to the end gives the root.  Counts grow at each step, so
chains are short and have no rings.

Defined results: null and empty texts have no words; a null key is an empty text inside the hash; repeated
rows count repeatedly; a vocabulary of one word has no near words; a word is not near itself, also where a
given vocabulary holds it twice, and its counts are added up.  Words may be of any length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import textkit as tk
from veilspan.llm.common import table
from veilspan.llm.scratch import cut, shuffle_partitions

LEAST_CHARS = 7
LEAST_COUNT = 2
RATIO = 10
NOISE = 31
MOST_IN_BLOCK = 2_000
MOST_BROADCAST = 500_000  # keys of 8 bytes
ROWS_A_TASK = 200_000
CHUNK = 20_000
FRONTIER = 2_000_000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LEAD = 0xC3  # U+00C0 to U+00FF are this byte and one more
_IN_RUN = np.array([False, True])
_LONG = 64


def _crc_table() -> np.ndarray:
    """One step of CRC-32 for each byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return t


_CRC = _crc_table()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of each range of bytes, going on from the CRC-32 of what stands before it."""
    out = begun.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(start - end, kind="stable")  # longest first
    length = (end - start)[order]
    less = -length
    long = int(np.searchsorted(less, -_LONG, "left"))  # a loop over bytes is for the many short ones
    state, at = out[order], start[order]
    for k in range(int(length[long]) if long < len(length) else 0):
        n = int(np.searchsorted(less, -k, "left"))
        state[long:n] = _CRC[(state[long:n] ^ data[at[long:n] + k]) & np.uint32(255)] ^ (state[long:n] >> np.uint32(8))
    for k in range(long):
        a = int(at[k])
        state[k] = zlib.crc32(data[a : a + int(length[k])], int(state[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out[order] = state
    return out ^ np.uint32(0xFFFFFFFF)


def slice_words(data: np.ndarray, offsets: np.ndarray, begun: np.ndarray, least: int, noise: int | None) -> pa.Array:
    """Runs of letters of a slice, lower-cased, with the noise of their row, of at least so many code points."""
    lead = data == _LEAD
    after = np.concatenate([[False], lead[:-1]])
    start, end, row = tk.words((_LETTER[data] | lead | after).astype(np.uint8), offsets, _IN_RUN)
    points = np.concatenate([[0], np.cumsum(~after)])
    length = points[end] - points[start]
    enough = length >= least
    start, end, row, length = start[enough], end[enough], row[enough], length[enough]
    low = tk.LOWER[data]
    gone = np.zeros(len(data) + 1, bool)
    size = end - start
    if noise:
        h = crc32(low, start, end, begun[row]).astype(np.int64)
        hit = np.flatnonzero(h % noise == 0)
        byte = np.flatnonzero(~after)[points[start[hit]] + h[hit] % length[hit]]
        gone[byte] = True
        gone[byte[lead[byte]] + 1] = True
        size[hit] -= 1 + lead[byte]
        length[hit] -= 1
        enough = length >= least
        start, end, size = start[enough], end[enough], size[enough]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    keep = (np.cumsum(edge[:-1], dtype=np.int8) > 0) & ~gone[:-1]
    ends = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=ends[1:])
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(low[keep].tobytes()))


def vocabulary(docs: DataFrame, key: str, text: str = "text", least: int = LEAST_CHARS, times: int = LEAST_COUNT, noise: int | None = NOISE) -> DataFrame:
    """(word, n) of all texts.

    With noise, a run whose crc32 after ``key:`` it divides loses the code point that the same number chooses.
    """

    def counted(batches):
        for batch in batches:
            keys = batch.column(0).fill_null("").to_pylist()
            begun = np.array([zlib.crc32(f"{k}:".encode()) for k in keys], np.uint32)
            parts = []
            for first, end, data, offsets in tk.slices(batch.column(1)):
                found = pc.value_counts(slice_words(data, offsets, begun[first:end], least, noise))
                parts.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
            if parts:
                total = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")])
                yield from total.select(["word", "n_sum"]).rename_columns(["word", "n"]).combine_chunks().to_batches()

    rows = docs.select(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`"))
    return rows.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


_KEY = "xxhash64(c, a, b, substring(word, 1, a), substring(word, char_length(word) - c + b + 1, c - b))"


def _regions(words: DataFrame, shortest: int) -> DataFrame:
    """(word, n, c, a, b, key): the word among those that differ from it in [a, b) at most, c being the shorter length."""
    whole, first = "named_struct('c', c, 'a', 0, 'b', c)", "named_struct('c', c, 'a', 0, 'b', cast(c div 2 as int))"
    halves = f"if(c < 2, array({whole}), array({first}, named_struct('c', c, 'a', cast(c div 2 as int), 'b', c)))"
    lengths = f"filter(array(char_length(word), char_length(word) - 1), c -> c >= {shortest})"
    told = words.selectExpr("word", "n", f"inline(flatten(transform({lengths}, c -> {halves})))")
    return told.selectExpr("word", "n", "cast(c as int) c", "cast(a as int) a", "cast(b as int) b").selectExpr("*", f"{_KEY} as key")


def _blocks(words: DataFrame, shortest: int, most: int) -> DataFrame:
    """Rows of _regions whose blocks hold at most ``most`` words, or differ in one place only."""
    rows, done = _regions(words, shortest), []
    while True:
        crowded = cut(rows.where("b - a > 1").groupBy("key").count().where(F.col("count") > most).select("key"), "crowded")
        n = crowded.count()
        if not n:
            done.append(rows)
            break
        crowded = F.broadcast(crowded) if n <= MOST_BROADCAST else crowded
        done.append(rows.join(crowded, "key", "left_anti").select(rows.columns))
        halves = "array(named_struct('a', a, 'b', (a + b) div 2), named_struct('a', (a + b) div 2, 'b', b))"
        parts = rows.join(crowded, "key", "left_semi").selectExpr("word", "n", "c", f"inline({halves})")
        rows = parts.selectExpr("word", "n", "c", "cast(a as int) a", "cast(b as int) b").selectExpr("*", f"{_KEY} as key")
        rows = cut(rows, "halved")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


class SortedBlocks:
    """Sorted words of some blocks laid end to end: their code points and common prefixes with the word before."""

    def __init__(self, words: pa.Array, block: np.ndarray) -> None:
        self.length = pc.utf8_length(words).to_numpy().astype(np.int64)
        self.codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le") + bytes(4), np.uint32) + np.uint32(1)
        self.start = np.cumsum(self.length) - self.length
        n = len(words)
        self.lcp = np.full(n, -1, np.int64)
        inner = np.flatnonzero(block[1:] == block[:-1]) + 1
        self.lcp[inner] = 0
        depth, alive = 0, inner
        while len(alive):
            alive = alive[np.minimum(self.length[alive], self.length[alive - 1]) > depth]
            alive = alive[self.codes[self.start[alive] + depth] == self.codes[self.start[alive - 1] + depth]]
            depth += 1
            self.lcp[alive] = depth
        self.begin = np.append(np.flatnonzero(self.lcp < 0), n)
        self.of = np.cumsum(self.lcp < 0) - 1

    def code(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code point of each word at a place; 0 outside."""
        inside = (at >= 0) & (at < self.length[word])
        out = self.codes[np.where(inside, self.start[word] + at, 0)]
        return np.where(inside, out, 0)

    def near(self, limit: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, other) of one block that are exactly one edit apart, each pair in both directions."""
        n = len(self.length)
        if not n:
            return
        sizes = np.diff(self.begin)
        # Words of a block go on together from what all of them share.
        shared = np.minimum.reduceat(np.where(self.lcp < 0, np.iinfo(np.int64).max, self.lcp), self.begin[:-1])
        asked = np.flatnonzero(sizes[self.of] > 1)
        depth0 = shared[self.of[asked]]
        for depth in np.unique(depth0):
            word = asked[depth0 == depth]
            one = np.ones(len(word), np.int8)
            below = one if depth else 2 * one
            above = np.where(self.length[word] > depth, 1, 2).astype(np.int8)
            stack = [(int(depth), word, self.begin[self.of[word]], self.begin[self.of[word] + 1], below, 0 * one, above)]
            known, first, rank = -1, None, None
            while stack:
                depth, word, lo, hi, below, same, above = stack.pop()
                # The first word of a range may end here: the prefix is the whole word.
                ended = self.length[lo] == depth
                if ended.any():
                    rest = (self.length[word] - depth)[ended]
                    cost = np.where(rest == 0, same[ended], np.where(rest == 1, above[ended], np.where(rest == -1, below[ended], 2)))
                    if (cost == 1).any():
                        yield word[ended][cost == 1], lo[ended][cost == 1]
                    lo = lo + ended
                    some = lo < hi
                    word, lo, hi, below, same, above = (x[some] for x in (word, lo, hi, below, same, above))
                if not len(word):
                    continue
                if known != depth:  # ranges one code point further down
                    starts = self.lcp <= depth
                    first, rank = np.append(np.flatnonzero(starts), n), np.cumsum(starts) - 1
                    known = depth
                a, b = rank[lo], rank[hi - 1] + 1
                children = b - a
                if children.sum() > limit and len(word) > 1:
                    half = len(word) // 2
                    stack += [(depth, *(x[:half] for x in (word, lo, hi, below, same, above))), (depth, *(x[half:] for x in (word, lo, hi, below, same, above)))]
                    continue
                up = np.repeat(np.arange(len(word)), children)
                child = np.arange(len(up)) - np.repeat(np.cumsum(children) - children, children) + a[up]
                lo, hi = first[child], first[child + 1]
                word, below, same, above = word[up], below[up], same[up], above[up]
                letter = self.code(lo, np.full(len(lo), depth))
                # Cells of the next row at one less, as many and one more code points of the word.
                new_below = np.minimum(same + 1, below + (letter != self.code(word, np.full(len(word), depth - 1))))
                new_same = np.minimum(np.minimum(above, new_below) + 1, same + (letter != self.code(word, np.full(len(word), depth))))
                new_same[self.length[word] < depth + 1] = 2
                new_above = np.minimum(new_same + 1, above + (letter != self.code(word, np.full(len(word), depth + 1))))
                new_above[self.length[word] < depth + 2] = 2
                alive = (np.minimum(np.minimum(new_below, new_same), new_above) < 2) & (letter > 0) & ~((hi - lo == 1) & (lo == word))
                stack.append(
                    (depth + 1, word[alive], lo[alive], hi[alive], *(np.minimum(x, 2).astype(np.int8)[alive] for x in (new_below, new_same, new_above)))
                )


def _common(blocks: SortedBlocks, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefix of words x and y."""
    out, alive, depth = np.zeros(len(x), np.int64), np.arange(len(x)), 0
    while len(alive):
        a, b = x[alive], y[alive]
        alive = alive[(np.minimum(blocks.length[a], blocks.length[b]) > depth) & (blocks.code(a, np.full(len(a), depth)) == blocks.code(b, np.full(len(b), depth)))]
        depth += 1
        out[alive] = depth
    return out


def scan_blocks(part: pa.Table) -> pa.RecordBatch:
    """(word, n_near, near_n, near) of the words of whole, sorted blocks that have near words there."""
    columns = {c: part.column(c).to_numpy() for c in ("key", "c", "a", "b", "n")}
    words = part.column("word").combine_chunks()
    new = np.ones(part.num_rows, bool)
    new[1:] = np.any([columns[c][1:] != columns[c][:-1] for c in ("key", "c", "a", "b")], 0)
    block = np.cumsum(new) - 1
    size = np.bincount(block, minlength=1)[block]
    several = np.flatnonzero(size > 1)
    words, block = words.take(pa.array(several)), block[several]
    c, a, b, n = (columns[k][several] for k in ("c", "a", "b", "n"))
    blocks = SortedBlocks(words, block)
    pairs = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for x, y in blocks.near():
        both_longer = (blocks.length[x] > c[x]) & (blocks.length[y] > c[x])  # met among words of that length
        x, y = x[~both_longer], y[~both_longer]
        at = _common(blocks, x, y)
        mine = (a[x] <= at) & ((at < b[x]) | ((b[x] == c[x]) & (at == c[x])))
        pairs.append((x[mine], y[mine]))
    x, y = (np.concatenate(p) for p in zip(*pairs))
    order = np.lexsort((y, -n[y], x))  # words of a block are in order, so the least index is the least word
    x, y = x[order], y[order]
    asked, first, count = np.unique(x, return_index=True, return_counts=True)
    best = y[first]
    return pa.RecordBatch.from_arrays(
        [words.take(pa.array(asked)), pa.array(count, pa.int64()), pa.array(n[best], pa.int64()), words.take(pa.array(best))],
        names=["word", "n_near", "near_n", "near"],
    )


def _scan(batches):
    """Whole blocks of a sorted partition, some thousand words at a time."""
    held = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if held.num_rows < CHUNK:
            continue
        keys = held.column("key").to_numpy()
        last = int(np.searchsorted(keys, keys[-1], "left"))
        if last:
            yield scan_blocks(held.slice(0, last))
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield scan_blocks(held)


def near_words(words: DataFrame, most: int = MOST_IN_BLOCK) -> DataFrame:
    """Every (word, n) of distinct words with n_near, and the count and name of its most frequent near word."""
    words = words.select("word", "n")
    told = words.agg(F.min(F.char_length("word")).alias("shortest"), F.count("*").alias("rows")).first()  # two numbers
    if not told["rows"]:
        return words.selectExpr("word", "n", "0L as n_near", "cast(null as bigint) as near_n", "cast(null as string) as near")
    rows = _blocks(words, told["shortest"], most)
    parts = max(shuffle_partitions(words.sparkSession), 4 * told["rows"] // ROWS_A_TASK)
    dealt = rows.repartition(parts, "key").sortWithinPartitions("key", "c", "a", "b", "word")
    found = dealt.mapInArrow(_scan, "word string, n_near bigint, near_n bigint, near string")
    # One grouping instead of a join: a word's own row and what its blocks found.
    union = words.selectExpr("word", "n", "0L as n_near", "cast(null as struct<less: bigint, near: string>) as best").unionByName(
        found.selectExpr("word", "cast(null as bigint) as n", "n_near", "named_struct('less', -near_n, 'near', near) as best")
    )
    grouped = union.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return grouped.selectExpr("word", "n", "n_near", "-best.less as near_n", "best.near as near")


def forms(words: DataFrame, ratio: int = RATIO, most: int = MOST_IN_BLOCK) -> DataFrame:
    """Every (word, n) of distinct words with form, root, n_near and form_n."""
    near = near_words(words, most)
    found = cut(near.selectExpr("word", "n", "n_near", f"if(near_n >= {ratio} * n, near, null) as form", f"if(near_n >= {ratio} * n, near_n, null) as form_n"), "forms")
    ends = found.agg(F.max("form_n").alias("most"), F.min(F.when(F.col("form").isNotNull(), F.col("n"))).alias("least")).first()  # two numbers
    led = found.where("form is not null").withColumn("root", F.col("form"))
    if ratio <= 1:
        raise ValueError("counts must grow along forms")
    if ends["most"]:
        # Each step multiplies the count by the ratio at least; each round doubles the steps.
        steps = max(1, math.floor(math.log(ends["most"] / ends["least"], ratio) + 1e-9))
        for _ in range(math.ceil(math.log2(steps))):
            next_ = led.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
            led = cut(led.join(next_, "root", "left").withColumn("root", F.coalesce("beyond", "root")).select(led.columns), "roots")
    alone = found.where("form is null").withColumn("root", F.col("word"))
    return alone.unionByName(led).select("word", "form", "root", "n", "n_near", "form_n")


def op11_sorted_variants(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return forms(cut(vocabulary(docs, "doc_id"), "vocabulary"))


# CRC-32 is worked out byte by byte: the engine that runs this has no such function.
OP11_SQL = r"""
with steps as (
  select list(list_reduce(list_prepend(i, [1, 2, 3, 4, 5, 6, 7, 8]),
              lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end) order by i) as t
  from range(256) r(i)
), runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[A-Za-z\x{C0}-\x{FF}]+')) as run
  from documents
), each_run as (
  select doc_id, run, count(*) as n, encode(concat(cast(doc_id as varchar), ':', run)) as b from runs where length(run) >= 7 group by 1, 2
), hashed as (
  select run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(b)), lambda k: ('0x' || hex(b[k + 1:k + 1]))::bigint)),
                     lambda crc, byte: xor(crc // 256, t[xor(crc, byte) % 256 + 1])), 4294967295) as h
  from each_run, steps
), spelled as (
  select case when h % 31 = 0 then concat(left(run, cast(h % length(run) as bigint)), substr(run, cast(h % length(run) as bigint) + 2)) else run end as word, n
  from hashed
), vocabulary as (
  select word, cast(sum(n) as bigint) as n from spelled where length(word) >= 7 group by 1 having sum(n) >= 2
), less as (
  select word, n, k, concat(left(word, k - 1), substr(word, k + 1)) as rest
  from (select word, n, unnest(range(1, length(word) + 1)) as k from vocabulary)
), near as (
  select a.word, b.word as other, b.n from less a join less b on a.rest = b.rest and a.k = b.k and a.word <> b.word
  union
  select a.word, b.word, b.n from less a join vocabulary b on a.rest = b.word
  union
  select b.word, a.word, a.n from less a join vocabulary b on a.rest = b.word
), best as (
  select word, count(*) as n_near, max(n) as most, arg_min(other, struct_pack(a := -n, b := other)) as other from near group by 1
), formed as (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when most >= 10 * v.n then other end as form, case when most >= 10 * v.n then most end as form_n
  from vocabulary v left join best using (word)
), way as (
  with recursive w(word, here) as (
    select word, word from formed union all select w.word, f.form from w join formed f on f.word = w.here where f.form is not null
  ) select w.word, w.here as root from w join formed f on f.word = w.here where f.form is null
)
select f.word, form, root, n, cast(n_near as bigint) as n_near, form_n from formed f join way using (word)
"""
