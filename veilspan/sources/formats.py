"""Bytes of table formats to record texts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from veilspan.functions.sqltext import let, quoted
from veilspan.functions.text import decode_text
from veilspan.sources.ranges import line_ends, open_at, quote_runs


def csv_records(body: bytes) -> pa.BinaryArray:
    """Records of CSV text that begins with one: cut at line ends outside quotes, which they keep."""
    raw = np.frombuffer(body, np.uint8)
    ends = line_ends(raw, 0, len(raw))
    ends = ends[~open_at(ends, quote_runs(raw, 0, len(raw), True), 0)] + 1
    offsets = np.concatenate([[0], ends, [len(raw)] if not len(ends) or ends[-1] < len(raw) else []]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(body)])


def csv_text(record: str) -> str:
    """Text of a CSV record in bytes: cells without their quotes, blanks between, empty ones skipped.

    Bytes are read as Latin-1, which keeps each of them, and the record is then decoded by the usual
    order of encodings.
    """
    # A cell starts at a separator: a quoted part and what follows it, or no quote at the start.
    cell = r'(?:^|,)("(?:[^"]++|"")*+"[^,]*+|[^,]*+)'
    plain = (
        "case when startswith(x, '\"') then replace(regexp_replace(x, '(?s)^\"(.*)\"([^\"]*)$', '$1$2'), '\"\"', '\"') "
        "else x end"
    )
    latin = f"rtrim('\\r\\n', decode({record}, 'ISO-8859-1'))"
    cells = f"transform(regexp_extract_all({latin}, {quoted(cell)}, 1), x -> {plain})"
    joined = f"array_join(filter({cells}, x -> x <> ''), ' ')"
    return let("b", f"encode({joined}, 'ISO-8859-1')", decode_text("b"))


class _Written(str):
    """A number or constant as it stands in the document."""


def _cell(value) -> str:
    """A JSON value as cell text: scalars as written, null empty, the rest as JSON."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return value if isinstance(value, str) else _json(value)


def _json(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_json(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_json, value)) + "]"
    if isinstance(value, str):
        return str(value) if isinstance(value, _Written) else json.dumps(value, ensure_ascii=False)
    return json.dumps(value)


def _record_texts(record) -> list[str]:
    """A record's own cells, then one text for each object inside an array of it."""
    if not isinstance(record, dict):
        return [_cell(record)]
    inner = [x for v in record.values() if isinstance(v, list) for x in v if isinstance(x, dict)]
    own = [v for v in record.values() if not (isinstance(v, list) and any(isinstance(x, dict) for x in v))]
    return [" ".join(c for c in map(_cell, own) if c), *(" ".join(c for c in map(_cell, x.values()) if c) for x in inner)]


_DECODER = json.JSONDecoder(parse_float=_Written, parse_int=_Written, parse_constant=_Written, strict=False)
_BLANK = re.compile(r"[ \t\n\r\ufeff]*")


def json_texts(body: str, inside: bool = False) -> Iterator[str]:
    """Texts of a document's records: an array's elements, or values one after another.

    ``inside`` says that the text begins between two elements of an array.

    Values are parsed one by one.  What does not parse, to the next line that does, is a text
    as it stands, so nothing is lost to a bad token.  Of equal keys the last counts, and NaN and
    infinities are accepted.
    """
    at, end = _BLANK.match(body).end(), len(body)
    if not inside and body.startswith("[", at):
        at, inside = _BLANK.match(body, at + 1).end(), True
    while at < end:
        if inside and body[at] in ",]":
            inside = body[at] == ","
            at = _BLANK.match(body, at + 1).end()
            continue
        value = None
        try:
            value, stop = _DECODER.raw_decode(body, at)
            texts = _record_texts(value)
        except (ValueError, RecursionError):
            stop = body.find("\n", at)
            stop = end if stop < 0 else stop + 1
            texts = [body[at:stop].strip()]
        if not inside and isinstance(value, list) and texts:
            texts = [t for x in value for t in _record_texts(x)]
        yield from (t for t in texts if t)
        at = _BLANK.match(body, stop).end()



def decoded(value: bytes) -> str:
    """UTF-8, else cp1251, else Latin-1."""
    for encoding in ("utf-8", "cp1251"):
        try:
            return value.decode(encoding)
        except UnicodeDecodeError:
            continue
    return value.decode("latin-1")


def _cells(column: pa.Array) -> pa.Array:
    """Cells of a Parquet column as text, in one form whatever the file: nulls stay null."""
    kind = column.type
    if pa.types.is_dictionary(kind):
        return _cells(column.dictionary_decode())
    if pa.types.is_null(kind):
        return pa.nulls(len(column), pa.string())
    if pa.types.is_floating(kind):
        wide = column.cast(pa.float32()) if pa.types.is_float16(kind) else column
        # The shortest digits that read back as the number; no exponent below 10^16.
        written = wide.fill_null(0).to_numpy(zero_copy_only=False).astype(str)
        return pc.if_else(column.is_valid(), pa.array(written.tolist(), pa.string()), pa.scalar(None, pa.string()))
    if pa.types.is_timestamp(kind):
        naive = column.cast(pa.timestamp(kind.unit)) if kind.tz else column
        return pc.replace_substring_regex(pc.replace_substring_regex(naive.cast(pa.string()), r"(\.\d*[1-9])0+$", r"\1"), r"\.0+$", "")
    if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) or pa.types.is_fixed_size_binary(kind):
        try:
            return column.cast(pa.binary()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([None if v is None else decoded(v) for v in column.to_pylist()], pa.string())
    if pa.types.is_nested(kind):
        return pa.array([None if v is None else json.dumps(_plain(v), ensure_ascii=False, default=str, separators=(",", ":")) for v in column.to_pylist()], pa.string())
    return column.cast(pa.string())


def _plain(value):
    """A nested Parquet value as JSON can hold it; absent fields are left out, so files with and without them agree."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items() if v is not None}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return decoded(value) if isinstance(value, bytes) else value


def row_texts(batch: pa.RecordBatch) -> pa.Array:
    """Texts of table rows: cells in column order, blanks between, nulls skipped."""
    if not batch.num_columns:
        return pa.array([""] * batch.num_rows, pa.string())
    # Joining with skipped nulls drops rows of nulls only, so each cell brings its own blank.
    cells = [pc.fill_null(pc.binary_join_element_wise(" ", c, ""), "") for c in map(_cells, batch.columns)]
    return pc.utf8_slice_codeunits(pc.binary_join_element_wise(*cells, ""), 1)
