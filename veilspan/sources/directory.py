"""A directory of mixed files as corpus rows.

Text and HTML files are one row each, because a match may run over line ends; text longer than a
split is several rows, cut where no match can cross.  Tables are one row per record.  Every row has
the number of code points before it in ``at``, and a file that cannot be read is one row with the
reason in ``error``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from veilspan.functions.text import html_text
from veilspan.plans.runtime import scratch_path
from veilspan.sources.contents import contents
from veilspan.sources.listing import family, list_files, with_metadata
from veilspan.sources.ranges import dealt, pieces, split_bytes, tasks_for
from veilspan.sources.store import reachable
from veilspan.sources.tables import opened_by_spark, parquet_texts, record_texts

_READ = ("text", "html", "csv", "json")


class Directory:
    """Files below folders, or the named files: listed once, cut once, read as often as asked."""

    def __init__(self, spark: SparkSession, paths: str | list[str], width: int | None = None) -> None:
        """Files longer than ``width`` are cut, by default those that Spark would split."""
        self.spark, self.paths = spark, paths
        self.files = list_files(spark, paths).selectExpr("*", f"{family('path')} as family")
        self._open = all(reachable(p) for p in ([paths] if isinstance(paths, str) else paths))
        if self._open:
            at = scratch_path(spark, "pieces")
            files = self.files.where(f"family in ({', '.join(map(repr, _READ))})").select("path", "size", "mtime", "family")
            found = pieces(files, width)
            found.write.parquet(at)
            kept = spark.read.schema(found.schema).parquet(at).selectExpr("*", "cast(null as binary) as content")
            self._pieces = dealt(kept, tasks_for(files, split_bytes(spark)))
        else:
            self._pieces = opened_by_spark(spark, paths, _READ).drop("name")

    def whole(self) -> DataFrame:
        """Text and HTML files that are one piece: path, size, mtime, at, text, error, name, format."""
        rows = contents(self._pieces.where("family in ('text', 'html') and begin = 0 and end = size"))
        text = f"case when family = 'html' then {html_text('text')} else text end"
        return with_metadata(rows.selectExpr("path", "size", "mtime", "at", f"{text} as text", "error"))

    def parts(self) -> DataFrame:
        """Pieces of longer text, and records of CSV, JSON and Parquet files, in the same columns."""
        rows = contents(self._pieces.where("family not in ('text', 'html') or begin > 0 or end < size"))
        parquet = parquet_texts(self.spark, self.paths, self.files.where("family = 'parquet'") if self._open else None)
        found = [record_texts(r) for r in (rows, parquet) if r is not None]
        return with_metadata(reduce(DataFrame.unionByName, found))

    def rows(self) -> DataFrame:
        return self.whole().unionByName(self.parts())


def whole_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text and HTML files of at most a split, one row each."""
    return Directory(spark, paths).whole()


def table_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of CSV, JSON and Parquet files, and pieces of longer text."""
    return Directory(spark, paths).parts()
