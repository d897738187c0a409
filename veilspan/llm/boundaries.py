"""Fill-in-middle: cut texts at line ends and put the middle last.

The line ends of a slice of texts are one sorted set of byte positions in containers of 65,536
positions each: a sorted array while there are few, a bitmap of 64-bit words where there are many, runs
where they are next to each other.  Cumulative cardinalities of the containers, and of the words or
runs inside, answer select(k) without unpacking: a search over containers, then one inside.  A text
owns a range of ranks of the set, so its two cuts are two selects.

A text of n lines gets its cuts from the SHA-256 of ``seed:key``: four 32-bit numbers choose both
cuts, whether it is transformed, and the order of the parts.

Defined results: null texts are empty; empty texts, and texts that hold a marker, stay plain; a null key
hashes as ``seed:``; equal cuts give an empty middle; repeated rows get the same cuts.  One text may be
as long as Spark's strings are.  Input columns with the names of result columns come back as
``input_<name>``.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm import textkit as tk
from veilspan.llm.common import free_name, map_batches, set_aside, table

SEED = 7
RATE = 100  # percent of texts that are transformed
SPM = 50  # percent of the transformed whose suffix comes first


class Markers(NamedTuple):
    """What stands before the prefix, the suffix and the middle; distinct, of one letter between < and >."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


MARKERS = Markers()
CONTAINER_BITS = 16
_SPAN = 1 << CONTAINER_BITS
_ARRAY, _BITMAP, _RUNS = 0, 1, 2
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)


@dataclass
class _Container:
    kind: int
    values: np.ndarray  # positions, words, or starts of runs
    before: np.ndarray  # members before each word or run


def _container(low: np.ndarray) -> _Container:
    """The smallest of the three forms for the sorted members of one container."""
    breaks = np.flatnonzero(np.diff(low) != 1) + 1
    starts = np.concatenate([[0], breaks])
    sizes = {_ARRAY: 2 * len(low), _BITMAP: _SPAN // 8, _RUNS: 4 * len(starts)}
    kind = min(sizes, key=sizes.get)
    if kind == _ARRAY:
        return _Container(kind, low.astype(np.uint16), np.empty(0, np.int64))
    if kind == _RUNS:
        return _Container(kind, low[starts], starts)
    words = np.zeros(_SPAN // 64, np.uint64)
    np.bitwise_or.at(words, low >> 6, _BIT[low & 63])
    counts = np.bitwise_count(words).astype(np.int64)
    return _Container(kind, words, np.cumsum(counts) - counts)


def _select(c: _Container, k: np.ndarray) -> np.ndarray:
    """The k-th members (from 0) of a container."""
    if c.kind == _ARRAY:
        return c.values[k].astype(np.int64)
    at = np.searchsorted(c.before, k, "right") - 1
    if c.kind == _RUNS:
        return c.values[at] + k - c.before[at]
    # Empty words share their neighbour's count; "right" finds the last word that starts at or below k, which holds it.
    rest = k - c.before[at]
    bits = (c.values[at][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    return at * 64 + (np.cumsum(bits, 1) == (rest + 1)[:, None].astype(np.uint64)).argmax(1)


class BoundarySet:
    """A sorted set of positions with select."""

    def __init__(self, positions: np.ndarray) -> None:
        high = positions >> CONTAINER_BITS
        self.keys, first = np.unique(high, return_index=True)
        self.before = first.astype(np.int64)  # cumulative cardinalities
        ends = np.append(first[1:], len(positions))
        self.containers = [_container(positions[a:b] & (_SPAN - 1)) for a, b in zip(first, ends)]

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """Members of the given ranks, each from 0 to the cardinality, without it."""
        out = np.empty(len(ranks), np.int64)
        of = np.searchsorted(self.before, ranks, "right") - 1
        order = np.argsort(of, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else ():
            c = of[part[0]]
            out[part] = (self.keys[c] << CONTAINER_BITS) + _select(self.containers[c], ranks[part] - self.before[c])
        return out


def line_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions after each line of rows laid end to end, and lines by row; a row's last line may lack its line feed."""
    feeds = np.flatnonzero(data == 0x0A) + 1
    ends = offsets[1:][np.diff(offsets) > 0]
    found = np.union1d(feeds, ends)
    return found, np.diff(np.searchsorted(found, offsets, "right"))


def cut_offsets(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, end of the prefix, end of the middle) by row; draws holds two numbers a row, the ends are bytes of the slice."""
    positions, n = line_ends(data, offsets)
    units = np.sort(draws % (n[:, None] + 1), axis=1)
    cuts = np.repeat(offsets[:-1, None], 2, 1)
    base = (np.cumsum(n) - n)[:, None]
    some = units > 0
    if some.any():
        cuts[some] = BoundarySet(positions).select((base + units - 1)[some])
    return n, cuts[:, 0], cuts[:, 1]


def draws(key: Column, seed: int = SEED) -> Column:
    """Four numbers of 32 bits for a key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)))


def transform(docs: DataFrame, key: str, text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM, markers: Markers = MARKERS) -> DataFrame:
    """Every row with n_lines, form, prefix_chars, middle_chars and output in place of its text."""
    docs = set_aside(docs, ["n_lines", "form", "prefix_chars", "middle_chars", "output"], key, text)
    others, drawn_name = [c for c in docs.columns if c != text], free_name(docs, "draws")
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*(F.col(f"`{c}`") for c in others)).schema)
    p, s, m = (x.encode() for x in markers)
    holds_marker = "|".join(markers)

    def run(batch):
        texts = batch.column(text).fill_null("")
        marked = pc.match_substring_regex(texts, holds_marker).to_numpy(zero_copy_only=False)
        drawn = np.asarray(batch.column(drawn_name).flatten(), np.int64).reshape(-1, 4)
        for first, end, data, offsets in tk.slices(texts):
            n, a, b = cut_offsets(data, offsets, drawn[first:end, :2])
            plain = marked[first:end] | (np.diff(offsets) == 0) | (drawn[first:end, 2] % 100 >= rate)
            suffix_first = drawn[first:end, 3] % 100 < spm
            # Code points begin at bytes other than 10xxxxxx.
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            raw, out = data.tobytes(), []
            for k, (lo, x, y, hi) in enumerate(zip(offsets[:-1].tolist(), a.tolist(), b.tolist(), offsets[1:].tolist())):
                if plain[k]:
                    out.append(raw[lo:hi])
                elif suffix_first[k]:
                    out.append(b"".join((s, raw[y:hi], p, raw[lo:x], m, raw[x:y])))
                else:
                    out.append(b"".join((p, raw[lo:x], s, raw[y:hi], m, raw[x:y])))
            form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
            part = batch.slice(first, end - first)
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in others),
                    pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()),
                    pa.array(chars[a] - chars[offsets[:-1]], pa.int64(), mask=plain), pa.array(chars[b] - chars[a], pa.int64(), mask=plain),
                    pa.array(out, pa.binary()).view(pa.string()),
                ],
                names=[*others, "n_lines", "form", "prefix_chars", "middle_chars", "output"],
            )

    rows = docs.select(*(F.col(f"`{c}`") for c in [*others, text]), draws(F.col(f"`{key}`"), seed).alias(drawn_name))
    return map_batches(rows, run, f"{kept}n_lines bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(form: Column, output: Column, markers: Markers = MARKERS) -> Column:
    """The text that a form and an output came from."""
    part = F.split(output, "|".join(markers), -1)
    return (
        F.when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(output)
    )


def op12_boundary_set(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = transform(docs, "doc_id")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", F.col("n_lines").alias("n"), "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("form"), F.col("output"))).alias("restored_sha256"),
    )


OP12_SQL = r"""
with cut as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as lines,
         sha256(concat('7:', cast(doc_id as varchar))) as h
  from documents
), drawn as (
  select *, len(lines) as n, cast(concat('0x', substr(h, 1, 8)) as bigint) % (len(lines) + 1) as u1,
         cast(concat('0x', substr(h, 9, 8)) as bigint) % (len(lines) + 1) as u2,
         cast(concat('0x', substr(h, 25, 8)) as bigint) % 100 as h4
  from cut
), parts as (
  select *, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain'
                 when h4 < 50 then 'spm' else 'psm' end as form,
         array_to_string(lines[1:least(u1, u2)], '') as p,
         array_to_string(lines[least(u1, u2) + 1:greatest(u1, u2)], '') as m,
         array_to_string(lines[greatest(u1, u2) + 1:], '') as s
  from drawn
)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(p) end as prefix_chars,
       case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then concat('<P>', p, '<S>', s, '<M>', m)
              else concat('<S>', s, '<P>', p, '<M>', m) end) as output_sha256,
       sha256(t) as restored_sha256
from parts
"""
