"""The data folder's tables as corpora and identifier columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.sqltext import quoted
from veilspan.functions.text import html_text
from veilspan.operators.profile import FILE_COLUMNS, profile_files, profile_rows
from veilspan.plans.runtime import spread
from veilspan.sources.listing import with_metadata

# --- fixed values: lines that bring Cyrillic data into documents ----------
OVERLAY = [
    "Клиент: Орлов Андрей Ильич, тел. +7 (903) 412-55-67.",
    "Паспорт 4510 654321; номер 4511 765432.",
    "СНИЛС 112-233-445 95, ИНН: 500100732259.",
    "Карта 4539 1488 0343 6467, счет 40817810099910004312, БИК 044525225.",
    "Родился 05.03.1987; проживает: г. Тверь, ул. Мира, д. 7; звонить",
    "Диагноз уточняется; БИОМЕТРИЯ сдана; религиозные взгляды.",
    "112-233-445 95; " * 10,
    "год. Омск; г.Омск; город Омск",
]
OVERLAY_PERIOD = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mtime(key: str) -> str:
    return f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast({key} as int), 0)"


def overlaid(key: str, text: str) -> str:
    """Append the overlay line of a row, if it has one."""
    arms = " ".join(f"when {k} then {quoted(chr(10) + line)}" for k, line in enumerate(OVERLAY))
    return f"concat({text}, case pmod({key}, {OVERLAY_PERIOD}) {arms} else '' end)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its overlay line."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    return with_metadata(
        rows.selectExpr(
            "doc_id",
            "concat('documents/', source, '/', doc_id, '.txt') as path",
            f"{overlaid('doc_id', 'text')} as text",
            f"{_mtime('doc_id')} as mtime",
        ).selectExpr("*", "cast(octet_length(text) as bigint) as size")
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: its visible text."""
    rows = spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    return with_metadata(
        rows.selectExpr(
            "page_id",
            "concat('pages/', page_id, '.html') as path",
            f"{html_text('html')} as text",
            f"{_mtime('page_id')} as mtime",
            "cast(octet_length(html) as bigint) as size",
        )
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per turn; a conversation is a file of many rows.

    Turns are scanned one by one and summed per file, so a conversation of any
    length is never gathered in one place.
    """
    rows = spread(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return with_metadata(
        rows.selectExpr(
            "concat('conversations/', conv_id, '.md') as path",
            "text",
            f"{_mtime('conv_id')} as mtime",
            "cast(octet_length(text) as bigint) as size",
        )
    )


def corpus_profile(spark: SparkSession, sf_dir: str, categories=None) -> DataFrame:
    """Profiles of documents, pages and conversations."""
    columns = [*FILE_COLUMNS, "text"]
    whole = documents(spark, sf_dir).select(columns).unionByName(
        pages(spark, sf_dir).select(columns)
    )
    return profile_files(whole, categories=categories).unionByName(
        conversation_profile(spark, sf_dir, categories)
    )


def conversation_profile(spark: SparkSession, sf_dir: str, categories=None) -> DataFrame:
    return profile_rows(turns(spark, sf_dir), categories=categories, sum_sizes=True)


def corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the whole corpus to scan: path, text."""
    parts = [documents(spark, sf_dir), pages(spark, sf_dir), turns(spark, sf_dir)]
    return reduce(DataFrame.unionByName, [p.select("path", "text") for p in parts])


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File metadata of the whole corpus."""
    columns = ["path", "name", "format", "size", "mtime"]
    conversations = (
        turns(spark, sf_dir)
        .groupBy("path", "name", "format")
        .agg(F.sum("size").alias("size"), F.max("mtime").alias("mtime"))
    )
    parts = [documents(spark, sf_dir), pages(spark, sf_dir), conversations]
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier columns derived from the customer key, valid and invalid."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "c_name",
        "lpad(cast(4000000000000000 + c_custkey * 7919 as string), 16, '0') as card",
        "lpad(cast(c_custkey * 10000019 % 100000000000 as string), 11, '0') as snils",
        "lpad(cast(7700000000 + c_custkey * 104729 as string), 10, '0') as inn10",
        "lpad(cast(500000000000 + c_custkey * 15485863 as string), 12, '0') as inn12",
    )
