"""Pieces of files to texts, inside the tasks that open them.

A file that cannot be opened or read gives one row with the reason in ``error`` in place of its
rows, so it does not end the scan of the others.  Failures of the store itself, which another attempt may
not meet, still fail the task.
"""

from __future__ import annotations

from itertools import islice

import pyarrow as pa
from pyarrow.parquet import ParquetFile
from pyspark.sql import DataFrame

from veilspan.sources.formats import csv_records, decoded, json_texts, row_texts
from veilspan.sources.ranges import dealt, tasks_for
from veilspan.sources.store import OTHERS_MAY_WORK, opened, read_range

#: The longest value of a column: HTML, and text without a place to cut at, ends here.
LONGEST_VALUE = (1 << 31) - 1
ROWS_A_BATCH = 4096
_SCHEMA = "path string, size bigint, mtime timestamp_ntz, family string, at bigint, text string, record binary, error string"
_NAMES = ["path", "size", "mtime", "family", "at", "text", "record", "error"]
#: What is wrong with a file and not with the store.
_BAD_FILE = (*OTHERS_MAY_WORK, ValueError, RecursionError, NotImplementedError)


def text_of(body: bytes, encoding: str | None) -> str:
    """Text with line feeds for line ends."""
    text = body.decode(encoding) if encoding else decoded(body)
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def _told(meta: dict, n: int, texts=None, records=None, error: str | None = None) -> pa.RecordBatch:
    def same(value, kind):
        return pa.repeat(pa.scalar(value, kind), n)

    return pa.RecordBatch.from_arrays(
        [
            same(meta["path"], pa.string()), same(meta["size"], pa.int64()), same(meta["mtime"], pa.timestamp("us")), same(meta["family"], pa.string()),
            same(meta["before"], pa.int64()), pa.nulls(n, pa.string()) if texts is None else texts,
            pa.nulls(n, pa.binary()) if records is None else records, same(error, pa.string()),
        ],
        names=_NAMES,
    )


def _reason(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def _piece(meta: dict):
    body, family = meta["content"], meta["family"]
    if body is None:
        if family != "csv" and meta["end"] - meta["begin"] > LONGEST_VALUE:
            raise ValueError(f"{meta['end'] - meta['begin']} bytes without a place to cut at are longer than a value")
        body = read_range(meta["path"], meta["begin"], meta["end"])
    if family == "csv":
        records = csv_records(body)
        for at in range(0, len(records), ROWS_A_BATCH):
            part = records.slice(at, ROWS_A_BATCH)
            yield _told(meta, len(part), records=pa.concat_arrays([part]))
    elif family == "json":
        texts = json_texts(text_of(body, meta["encoding"]), meta["inside"])
        while part := list(islice(texts, ROWS_A_BATCH)):
            yield _told(meta, len(part), pa.array(part, pa.string()))
    else:
        text = body.decode("utf-8", "ignore") if family == "html" else text_of(body, meta["encoding"])
        yield _told(meta, 1, pa.array([text], pa.string()))


def _read(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            meta = batch.slice(k, 1).to_pylist()[0]
            if meta["error"] is not None:
                yield _told(meta, 1, error=meta["error"])
                continue
            try:
                yield from _piece(meta)
            except _BAD_FILE as error:
                yield _told(meta, 1, error=_reason(error))


def contents(pieces: DataFrame) -> DataFrame:
    """Rows (path, size, mtime, family, at, text, record, error) of text, HTML, CSV and JSON pieces.

    CSV rows are records in bytes; the others are texts.  ``at`` counts the code points before a piece of text.
    """
    return pieces.mapInArrow(_read, _SCHEMA)


def _footers(batches):
    kinds = (pa.string(), pa.int64(), pa.timestamp("us"), pa.int32(), pa.int64(), pa.string())
    for batch in batches:
        rows = []
        for meta in batch.to_pylist():
            known = (meta["path"], meta["size"], meta["mtime"])
            try:
                with opened(meta["path"]) as f:
                    footer = ParquetFile(f).metadata
                    rows += [(*known, g, footer.row_group(g).total_byte_size, None) for g in range(footer.num_row_groups)]
            except _BAD_FILE as error:
                rows.append((*known, None, 0, _reason(error)))
        columns = list(zip(*rows)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["path", "size", "mtime", "row_group", "bytes", "error"])


def _row_groups(batches):
    for batch in batches:
        for row in batch.to_pylist():
            meta = row | {"family": "parquet", "before": 0}
            if meta["error"] is not None:
                yield _told(meta, 1, error=meta["error"])
                continue
            try:
                with opened(meta["path"]) as f:
                    for part in ParquetFile(f).iter_batches(ROWS_A_BATCH, row_groups=[meta["row_group"]]):
                        yield _told(meta, part.num_rows, row_texts(part))
            except (*_BAD_FILE, OSError) as error:
                if not isinstance(error, _BAD_FILE) and not _still_read(meta):
                    raise
                yield _told(meta, 1, error=_reason(error))


def _still_read(meta: dict) -> bool:
    """Whether the store gives the bytes: then it was their meaning that failed."""
    with opened(meta["path"]) as f:
        return len(f.read(meta["size"])) == meta["size"] if meta["size"] < 1 << 20 else bool(f.read(1 << 20))


def parquet_contents(files: DataFrame, width: int) -> DataFrame:
    """The same rows of Parquet files: footers are read by tasks, and row groups dealt out, whatever their schemas."""
    n = tasks_for(files, width)
    groups = dealt(files.select("path", "size", "mtime"), n).mapInArrow(
        _footers, "path string, size bigint, mtime timestamp_ntz, row_group int, bytes bigint, error string"
    )
    return dealt(groups, n).mapInArrow(_row_groups, _SCHEMA)
