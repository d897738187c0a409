"""Table formats to row texts: one output row per record, not one per file.

A record is scanned on its own, so a match cannot run from one record into the
next.  Files are read in pieces by many tasks, whatever their length and names; see ranges.
"""

from __future__ import annotations

from fnmatch import translate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veilspan.functions.sqltext import quoted
from veilspan.functions.text import row_text
from veilspan.sources.contents import contents, parquet_contents
from veilspan.sources.formats import csv_text, json_texts, row_texts  # noqa: F401
from veilspan.sources.listing import family, file_columns, list_files
from veilspan.sources.ranges import split_bytes, to_read
from veilspan.sources.store import reachable

_COLUMNS = ["path", "size", "mtime", "at", "text", "error"]


def any_case(*suffixes: str) -> str:
    """Glob for names ending in one of the suffixes, in any case."""
    def letters(s: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s)

    return "*{" + ",".join(letters(s) for s in suffixes) + "}"


def _named(files: DataFrame, glob: str | None) -> DataFrame:
    """The files whose names match a glob; all without one."""
    if not glob:
        return files
    start, _, rest = glob.partition("{")
    choices, _, end = rest.partition("}")
    tests = [translate(start + c + end).removesuffix(r"\Z").removesuffix(r"\z") for c in choices.split(",")]
    return files.where(f"rlike(name, {quoted('^(?:' + '|'.join(tests) + ')$')})")


def opened_by_spark(spark: SparkSession, paths: str | list[str], families: tuple[str, ...]) -> DataFrame:
    """What to read of a store that only Spark opens: whole files with their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    kept = ", ".join(map(repr, families))
    return files.selectExpr(
        "path", "length as size", "cast(modificationTime as timestamp_ntz) as mtime", f"{family('path')} as family", "regexp_extract(path, '[^/]*$', 0) as name", "0L as begin",
        "length as end", "cast(null as string) as encoding", "0L as before", "false as inside", "cast(null as string) as error", "content",
    ).where(f"family in ({kept})")


def _read(spark: SparkSession, paths: str | list[str], glob: str | None, kind: str) -> DataFrame:
    """Contents of the files that have the name, or without one of those of the family, all read as one family."""
    if all(reachable(p) for p in ([paths] if isinstance(paths, str) else paths)):
        files = _named(list_files(spark, paths), glob).selectExpr("path", "size", "mtime", f"'{kind}' as family")
        rows = to_read(files).selectExpr("*", "cast(null as binary) as content")
    else:
        rows = _named(opened_by_spark(spark, paths, (kind,)), glob).drop("name")
    return contents(rows)


def record_texts(rows: DataFrame) -> DataFrame:
    """Contents with the text of every row: path, size, mtime, at, text, error; records without any are left out."""
    text = f"case when family = 'csv' then {csv_text('record')} else text end"
    return rows.selectExpr("path", "size", "mtime", "at", f"{text} as text", "error", "family").where(
        "error is not null or family <> 'csv' or text <> ''"
    ).select(_COLUMNS)


def csv_rows(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """Rows (path, size, mtime, at, text, error) of CSV files with any mix of headers, widths and line ends.

    The first line of a file is a row like any other, and line breaks inside quotes belong to their
    record.  Each record is decoded by itself.
    """
    return record_texts(_read(spark, paths, glob, "csv"))


def csv_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Row texts of CSV files that share one header; cells stay strings."""
    table = (
        spark.read.option("header", "true").option("escape", '"').csv(path)
    )
    return table.selectExpr(*file_columns(), f"{row_text(table, columns)} as text")


def json_records(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """Rows (path, size, mtime, at, text, error) of JSON documents, one per record; see json_texts.

    Arrays and values one after another are cut into pieces; a value that is longer than a piece is read
    whole.  A document whose quotes or brackets do not pair may be cut elsewhere; all of it is read.
    """
    return record_texts(_read(spark, paths, glob, "json"))


def json_table(
    spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False
) -> DataFrame:
    """Row texts of JSON tables with one schema; line-delimited files are splittable.

    A schema of string columns fixes the cell order and saves the pass over the
    data that inference takes; inferred columns come in alphabetical order.
    """
    reader = spark.read.option("multiLine", str(multi_line).lower())
    reader = reader.schema(schema) if schema else reader.option("primitivesAsString", "true")
    table = reader.json(path)
    return table.selectExpr(*file_columns(), f"{row_text(table)} as text")


def parquet_rows(
    spark: SparkSession, path: str, columns: list[str] | None = None, glob: str | None = None
) -> DataFrame:
    """Row texts of Parquet files of one table; name the columns to read only those."""
    reader = spark.read.option("recursiveFileLookup", "true")
    table = (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)
    return table.selectExpr(*file_columns(), f"{row_text(table, columns)} as text")


def parquet_texts(spark: SparkSession, paths: str | list[str], files: DataFrame | None) -> DataFrame | None:
    """Contents of Parquet files of any mix of schemas; None where a store that only Spark opens has none.

    Cells are written in the same way for every file.  Row groups are dealt to tasks, so neither the number
    of files and schemas nor the length of one matters.
    """
    if files is not None:
        return parquet_contents(files, split_bytes(spark))
    reader = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").option("ignoreCorruptFiles", "true")
    try:
        found = reader.option("pathGlobFilter", any_case(".parquet")).parquet(*([paths] if isinstance(paths, str) else paths))
    except Exception as error:
        if "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise
    meta = ["_path", "_size", "_mtime"]
    given = found.selectExpr(*(f"{c.rpartition(' as ')[0]} as {m}" for c, m in zip(file_columns(), meta)), "*")

    def written(batches):
        for batch in batches:
            rest = pa.RecordBatch.from_arrays(batch.columns[3:], names=batch.schema.names[3:])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.repeat(pa.scalar("parquet"), n), pa.repeat(pa.scalar(0, pa.int64()), n), row_texts(rest), pa.nulls(n, pa.binary()), pa.nulls(n, pa.string())],
                names=["path", "size", "mtime", "family", "at", "text", "record", "error"],
            )

    return given.mapInArrow(written, "path string, size bigint, mtime timestamp_ntz, family string, at bigint, text string, record binary, error string")


def parquet_rows_any_schema(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame | None:
    """Row texts (path, size, mtime, at, text, error) of all Parquet files, whatever their schemas."""
    files = None
    if all(reachable(p) for p in ([paths] if isinstance(paths, str) else paths)):
        files = _named(list_files(spark, paths), glob)
    found = parquet_texts(spark, paths, files)
    return None if found is None else record_texts(found)
