"""One scan of a directory for all its outputs.

Content is read once into a small table with a row per file; profile, status, errors and both
reports are read from there.  A marker is written last, so the table of a run that failed is never
taken for a whole one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from veilspan.functions.patterns import CATEGORIES, select_rules
from veilspan.operators.profile import FILE_COLUMNS, counts_of_files, finish_profile, found_any
from veilspan.sources.directory import Directory
from veilspan.sources.listing import status, visible
from veilspan.sources.reports import detailed_report, summary_report, write_report

_FILES, _CONTENT, _DONE = "files", "content", "done"


class NotStaged(RuntimeError):
    """The folder holds no finished scan."""


@dataclass(frozen=True)
class StagedScan:
    """Outputs of a finished scan; none of them reads content."""

    spark: SparkSession
    folder: str
    categories: tuple[str, ...]

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def profile(self) -> DataFrame:
        """Profiles of the files that hold personal data."""
        return finish_profile(self._table(_CONTENT).where(found_any(self.categories)), self.categories)

    def status(self) -> DataFrame:
        """Every listed file with its family, why it has, or has not, text, and what went wrong."""
        known = self._table(_CONTENT).selectExpr("path", "if(seen, 'x', '') as seen", "error")
        return self._table(_FILES).join(known, "path", "left").selectExpr(
            "path", "name", "size", "format", "family",
            f"case when error is not null then 'failed' else {status('family', 'seen')} end as status", "error",
        )

    def errors(self) -> DataFrame:
        return self._table(_CONTENT).where("error is not null").select("path", "name", "error")

    def write_reports(self, summary_path: str, detailed_path: str) -> None:
        write_report(summary_report(self.profile()), summary_path)
        write_report(detailed_report(self.profile()), detailed_path)


def stage_scan(spark: SparkSession, root: str | list[str], folder: str, categories=None) -> StagedScan:
    """Scan a directory, or the named files, into a folder; what an earlier run left there is replaced."""
    names = tuple(r.category for r in select_rules(categories))
    mark = spark.createDataFrame([(list(names),)], "categories array<string>")
    mark.limit(0).write.mode("overwrite").parquet(f"{folder}/{_DONE}")  # not finished from here on
    found = Directory(spark, root)
    found.files.write.mode("overwrite").parquet(f"{folder}/{_FILES}")
    content = counts_of_files(found.whole(), found.parts(), visible("text"), categories)
    content.select(*FILE_COLUMNS, "counts", "seen", "error").write.mode("overwrite").parquet(f"{folder}/{_CONTENT}")
    mark.write.mode("overwrite").parquet(f"{folder}/{_DONE}")
    return staged_scan(spark, folder)


def staged_scan(spark: SparkSession, folder: str) -> StagedScan:
    """A finished scan of any session."""
    try:
        mark = spark.read.parquet(f"{folder}/{_DONE}").first()
    except AnalysisException:
        mark = None
    if mark is None:
        raise NotStaged(folder)
    return StagedScan(spark, folder, tuple(c for c in CATEGORIES if c in mark["categories"]))
