"""Long files in pieces that are read by many tasks and give what the whole file would give.

A file longer than a split is looked at range by range: each range tells, for every state that its first
byte may be in, what state follows its last byte and where the first place is at which the file may be
cut.  Prefix sums over a file's ranges then settle the state of each range, its cut and the encoding of
the file.  What lies between two cuts is a piece; a range without a cut belongs to the piece before it.

Where a file may be cut:

* text: where no match of any rule can cross, before a mark that no rule accepts and between two
  words of ASCII letters;
* CSV: after a line end outside quotes; ranges carry whether a quoted cell is open;
* JSON: after a comma between elements of the array that is the whole file, or else between values at
  the top; ranges carry whether a string is open and how deep brackets are nested.

Bytes that decide are ASCII in each encoding that is tried, so cuts do not depend on it.
"""

from __future__ import annotations

import re
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veilspan.sources.store import OTHERS_MAY_WORK, read_range

#: Families that are read in pieces; the others are one value a file, or are split by their own format.
CUT = ("text", "csv", "json")
#: CSV ranges are no longer than this, whatever the splits: marks of every quote and line end are kept in memory.
CSV_BYTES = 8 << 20
_CONTEXT = 64
_BLANK = 1 << 16  # blanks after the end of an array
# Marks that stand in no pattern and are not letters, digits or underscores, and a blank between two
# words of ASCII letters: a match that ends before it or starts after it sees the same neighbours.
SAFE = re.compile(rb"""[;!?"<>{}\[\]=*&^$#~`\\']|(?<=[A-Za-z])[ \t\n](?=[A-Za-z])""")
_QUOTE, _BACKSLASH, _FEED, _RETURN, _COMMA = 0x22, 0x5C, 0x0A, 0x0D, 0x2C
_PIECE = ["path", "size", "mtime", "family", "begin", "end", "encoding", "before", "inside", "error"]


def split_bytes(spark: SparkSession) -> int:
    """Length of a range: that of Spark's own splits."""
    told = str(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m")).strip().lower()
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", told).groups()
    return max(16, int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit])


# --- one range ---------------------------------------------------------------
@dataclass
class Told:
    """What a range tells; lists hold a value for each state of its first byte (outside, inside of quotes)."""

    utf8: bool = True
    undefined: bool = False  # a byte that cp1251 does not know
    chars: int = 0  # code points that begin here, as UTF-8
    pairs: int = 0  # carriage returns before a line feed
    cut: list[int | None] | None = None  # first place to cut at
    cut_chars: int = 0  # code points, pairs before the cut
    cut_pairs: int = 0
    flips: int = 0  # quotes, modulo 2, after the last place that closes them in any state
    settles: bool = False  # there is such a place
    depth: list[int] | None = None  # change of depth
    least: list[int] | None = None  # least depth after a bracket, the last one of the file apart
    cut_depth: list[int | None] | None = None  # depth at the cut, from that of the first byte
    opening: str = ""  # first byte that is not blank


TOLD = (
    "utf8 boolean, undefined boolean, chars bigint, pairs bigint, cut array<bigint>, cut_chars bigint, cut_pairs bigint, flips int, settles boolean, "
    "depth array<bigint>, least array<bigint>, cut_depth array<bigint>, opening string"
)


def _window(path: str, begin: int, end: int, size: int, context: int) -> tuple[bytes, int, int]:
    """(bytes, place of begin, place of end) with some bytes on both sides."""
    a, b = max(begin - context, 0), min(end + context, size)
    data = read_range(path, a, b)
    return data, begin - a, min(end - a, len(data))


def _continues(byte: int) -> bool:
    return byte & 0xC0 == 0x80


def _encoding(told: Told, data: bytes, raw: np.ndarray, lo: int, hi: int, begin: int) -> None:
    a, b = lo, hi
    while begin and a < len(data) and a < lo + 3 and _continues(data[a]):
        a += 1
    while b < len(data) and b < hi + 3 and _continues(data[b]):
        b += 1
    try:
        data[a:b].decode("utf-8")
    except UnicodeDecodeError:
        told.utf8 = False
    told.undefined = 0x98 in data[lo:hi]
    told.chars, told.pairs = _lengths(raw, lo, hi)


def _lengths(raw: np.ndarray, lo: int, hi: int) -> tuple[int, int]:
    """Code points, and carriage returns before a line feed, that begin in a part."""
    part = raw[lo:hi]
    after = raw[lo + 1 : hi + 1]
    return int(((part & 0xC0) != 0x80).sum()), int(((part[: len(after)] == _RETURN) & (after == _FEED)).sum())


def text_told(data: bytes, lo: int, hi: int, begin: int) -> Told:
    told, raw = Told(), np.frombuffer(data, np.uint8)
    _encoding(told, data, raw, lo, hi, begin)
    if begin:
        # A look-behind needs the byte before; a match at or after the end belongs to the next range.
        found = next((m.start() for m in SAFE.finditer(data, lo) if m.start() >= lo), None)
        at = found if found is not None and found < hi else None
        told.cut = [None if at is None else begin + at - lo] * 2
        if at is not None:
            told.cut_chars, told.cut_pairs = _lengths(raw, lo, at)
    return told


def quote_runs(raw: np.ndarray, lo: int, hi: int, at_start: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of quotes that begin in a part: (place, flips, settles).

    A run of odd length at the start of a cell opens or closes it; elsewhere it closes what is open and
    stands for itself outside quotes, so it settles the state; pairs change nothing.
    """
    marks = raw == _QUOTE
    step = np.diff(np.concatenate([[0], marks.view(np.int8), [0]]))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    mine = (start >= lo) & (start < hi)
    start, end = start[mine], end[mine]
    odd = (end - start) % 2 == 1
    before = raw[np.maximum(start - 1, 0)]
    opens = (before == _COMMA) | (before == _FEED) | (before == _RETURN)
    if at_start:
        opens |= start == 0
    return start, odd & opens, odd & ~opens


def line_ends(raw: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Places of the last byte of each line end in a part."""
    part = raw[lo:hi]
    after = np.zeros(len(part), np.uint8)
    rest = raw[lo + 1 : hi + 1]
    after[: len(rest)] = rest
    return lo + np.flatnonzero((part == _FEED) | ((part == _RETURN) & (after != _FEED)))


def open_at(place: np.ndarray, runs: tuple[np.ndarray, np.ndarray, np.ndarray], entry: int) -> np.ndarray:
    """Whether quotes are open at each place, if they are, or are not, at the start of the part."""
    start, flips, settles = runs
    total = np.concatenate([[entry], entry + np.cumsum(flips)])
    settled = np.concatenate([[0], np.where(settles, total[1:], 0)])
    last = np.maximum.accumulate(np.concatenate([[0], np.where(settles, np.arange(1, len(start) + 1), 0)]))
    state = (total - np.where(last > 0, settled[last], 0)) % 2
    return state[np.searchsorted(start, place, "left")] == 1


def csv_told(data: bytes, lo: int, hi: int, begin: int) -> Told:
    told, raw = Told(), np.frombuffer(data, np.uint8)
    runs = quote_runs(raw, lo, hi, begin == lo)
    _, flips, settles = runs
    last = np.flatnonzero(settles)
    told.settles = bool(len(last))
    told.flips = int(flips[last[-1] + 1 if len(last) else 0 :].sum() % 2)
    if begin:
        ends = line_ends(raw, lo - 1, hi - 1)
        told.cut = []
        for entry in (0, 1):
            free = ends[~open_at(ends, runs, entry)]
            told.cut.append(begin + int(free[0]) + 1 - lo if len(free) else None)
    return told


def json_marks(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes, and places of the quotes that a backslash does not hide."""
    raw = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(raw == _QUOTE)
    slashes = np.flatnonzero(raw == _BACKSLASH)
    if not len(slashes) or not len(quotes):
        return raw, quotes
    new = np.concatenate([[True], np.diff(slashes) != 1])
    first = slashes[np.maximum.accumulate(np.where(new, np.arange(len(slashes)), 0))]
    at = np.searchsorted(slashes, quotes - 1, "left")
    held = (at < len(slashes)) & (slashes[np.minimum(at, len(slashes) - 1)] == quotes - 1)
    run = np.where(held, quotes - first[np.minimum(at, len(slashes) - 1)], 0)
    return raw, quotes[run % 2 == 0]


def json_told(data: bytes, lo: int, hi: int, begin: int, last: bool) -> Told:
    told = Told()
    raw, quotes = json_marks(data)
    _encoding(told, data, raw, lo, hi, begin)
    quotes = quotes[(quotes >= lo) & (quotes < hi)]
    told.flips = len(quotes) % 2
    part = raw[lo:hi]
    opening, closing = (part == 0x5B) | (part == 0x7B), (part == 0x5D) | (part == 0x7D)
    place = lo + np.flatnonzero(opening | closing | (part == _COMMA) | (part == _FEED))
    kind = raw[place]
    outside = np.searchsorted(quotes, place, "left") % 2
    step = np.where((kind == 0x5B) | (kind == 0x7B), 1, np.where((kind == 0x5D) | (kind == 0x7D), -1, 0))
    told.cut, told.depth, told.least, told.cut_depth = [], [], [], []
    trimmed = data[lo:hi].rstrip(b" \t\r\n") if last else b""
    for entry in (0, 1):
        free = outside == entry
        at, now, what = place[free], np.cumsum(step[free]), kind[free]
        told.depth.append(int(now[-1]) if len(now) else 0)
        brackets = step[free] != 0
        if last and len(at) and at[-1] == lo + len(trimmed) - 1 and step[free][-1] < 0:
            brackets[-1] = False  # the one that closes the file
        told.least.append(int(now[brackets].min()) if brackets.any() else _NO_BRACKET)
        low = min(0, told.least[-1])
        # A comma at the least depth here lies between elements if that is inside the one array; a bracket
        # or a line end there lies between values if that is the top.  Which of both, the whole file tells.
        commas, rest = at[(what == _COMMA) & (now == low)], at[(what != _COMMA) & (now == low)]
        for found in (commas, rest):
            told.cut.append(begin + int(found[0]) + 1 - lo if begin and len(found) else None)
        told.cut_depth.append(low)
    if not begin:
        told.opening = data.removeprefix(b"\xef\xbb\xbf").lstrip()[:1].decode("latin-1")
    return told


_NO_BRACKET = 1 << 40


def range_told(path: str, family: str, begin: int, end: int, size: int) -> Told:
    """What a range of a file tells; runs of quotes or backslashes that cross its borders are read whole."""
    context = _CONTEXT
    while True:
        data, lo, hi = _window(path, begin, end, size, context)
        mark = {"csv": b'"', "json": b"\\"}.get(family)
        left = mark and lo and data[:lo] == mark * lo and begin > lo
        right = mark and hi < len(data) and data[hi:] == mark * (len(data) - hi) and end + len(data) - hi < size
        if not left and not right:
            break
        context *= 16
    if family == "text":
        return text_told(data, lo, hi, begin)
    if family == "csv":
        return csv_told(data, lo, hi, begin)
    blank_rest = end >= size or (size - end <= _BLANK and not read_range(path, end, size).strip())
    return json_told(data, lo, hi, begin, blank_rest)


# --- all ranges of all files -------------------------------------------------
def _tell(batches):
    fields = [x.split(" ")[0] for x in TOLD.split(", ")]
    kinds = {"boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
    types = [kinds[x.split(" ")[1]] for x in TOLD.split(", ")]
    for batch in batches:
        rows, errors = [], []
        for path, family, begin, end, size in zip(*(batch.column(c).to_pylist() for c in ("path", "family", "begin", "end", "size"))):
            error = None
            try:
                told = range_told(path, family, begin, end, size)
            except OTHERS_MAY_WORK as e:
                told, error = Told(), f"{type(e).__name__}: {e}"
            rows.append(astuple(told))
            errors.append(error)
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(errors, pa.string())], names=[*batch.schema.names, *fields, "error"])


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """Narrow rows dealt evenly to n tasks."""
    return rows.repartition(max(1, n))


def _settled(told: DataFrame) -> DataFrame:
    """Pieces of long files from what their ranges tell."""
    before = "over (partition by path order by k rows between unbounded preceding and 1 preceding)"
    whole = "over (partition by path)"
    states = told.selectExpr(
        "*",
        f"min(utf8) {whole} as all_utf8", f"max(undefined) {whole} as any_undefined", f"max(error) {whole} as any_error",
        "first(opening) over (partition by path order by k) as first_byte",
        f"coalesce(sum(flips) {before}, 0) as flips_before",
    ).selectExpr(
        "*", f"cast((flips_before - coalesce(last(case when settles then flips_before end, true) {before}, 0)) % 2 as int) as entry"
    ).selectExpr("*", f"coalesce(sum(get(depth, entry)) {before}, 0) as deep")
    settled = states.selectExpr(
        "*",
        "case when all_utf8 then 'utf-8' when any_undefined then 'latin-1' else 'cp1251' end as encoding",
        f"first_byte = '[' and min(deep + get(least, entry)) {whole} >= 1 as one_array",
    )
    comma, value = "case when deep + get(cut_depth, entry) = 1 then get(cut, 2 * entry) end", "case when deep + get(cut_depth, entry) = 0 then get(cut, 2 * entry + 1) end"
    cut = f"case when k = 0 then 0 when family = 'json' then case when one_array then {comma} else {value} end else get(cut, entry) end"
    lengths = "case when all_utf8 then {0} else {1} end - {2}"
    places = settled.selectExpr(
        "*", f"{cut} as cut_at",
        f"coalesce(sum({lengths.format('chars', 'end - begin', 'pairs')}) {before}, 0) as chars_before",
    )
    at = f"chars_before + case when k = 0 then 0 else {lengths.format('cut_chars', 'cut_at - begin', 'cut_pairs')} end"
    # A file that could not be looked at everywhere is one row that says so.
    return places.where("cut_at is not null and (any_error is null or k = 0)").selectExpr(
        "path", "size", "mtime", "family", "cut_at as begin",
        "coalesce(lead(cut_at) over (partition by path order by k), size) as end",
        "encoding", f"case when family = 'text' then {at} else 0 end as before", "family = 'json' and one_array and k > 0 as inside", "any_error as error",
    )


def pieces(files: DataFrame, width: int | None = None) -> DataFrame:
    """What to read: path, size, mtime, family, begin, end, encoding, code points before, inside an array, error.

    Short files, and families that are not cut, are one piece with its encoding left open.
    """
    spark = files.sparkSession
    width = width or split_bytes(spark)
    step = f"if(family = 'csv', {min(width, CSV_BYTES)}L, {width}L)"
    cuttable = f"family in ({', '.join(map(repr, CUT))}) and size > {step}"
    short = files.where(f"not ({cuttable})").selectExpr(
        "path", "size", "mtime", "family", "0L as begin", "size as end", "cast(null as string) as encoding", "0L as before", "false as inside", "cast(null as string) as error"
    )
    long = files.where(cuttable)
    n = tasks_for(long, split_bytes(spark))
    if not n:
        return short
    ranges = long.selectExpr(
        "path", "size", "mtime", "family", f"posexplode(sequence(0L, size - 1, {step})) as (k, begin)"
    ).selectExpr("path", "size", "mtime", "family", "k", "begin", f"least(begin + {step}, size) as end")
    kept = "path string, size bigint, mtime timestamp_ntz, family string, k int, begin bigint, end bigint"
    told = dealt(ranges, n).mapInArrow(_tell, f"{kept}, {TOLD}, error string")
    return short.unionByName(_settled(told).select(*_PIECE))


def tasks_for(files: DataFrame, width: int) -> int:
    """So many tasks that each reads about ``width`` bytes of the files."""
    total, n = files.selectExpr("coalesce(sum(size), 0)", "count(*)").first()  # two numbers
    return max(min(n, files.sparkSession.sparkContext.defaultParallelism), -(-total // width))


def to_read(files: DataFrame, width: int | None = None) -> DataFrame:
    """pieces, dealt so that every task reads about as many bytes."""
    return dealt(pieces(files, width), tasks_for(files, split_bytes(files.sparkSession)))
