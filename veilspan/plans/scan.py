"""Directory scan: files to profiles, findings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.operators.detect import findings
from veilspan.operators.profile import profile_files, profile_rows
from veilspan.sources.directory import Directory
from veilspan.sources.listing import status, visible
from veilspan.sources.reports import detailed_report, summary_report, write_report


def scan_directory(spark: SparkSession, root: str | list[str], categories=None) -> DataFrame:
    """Profile of every file below a directory, or of the named files, that holds personal data.

    Files that cannot be read are left out; scan_errors names them.
    """
    found = Directory(spark, root)
    return profile_files(found.whole(), categories=categories).unionByName(profile_rows(found.parts(), categories=categories))


def scan_findings(spark: SparkSession, root: str | list[str], categories=None) -> DataFrame:
    """Every match below a directory; positions count from the start of the file
    or, in a table, of the record."""
    return findings_of(Directory(spark, root), categories)


def findings_of(directory: Directory, categories=None) -> DataFrame:
    found = findings(directory.rows(), ["path", "name", "at"], categories=categories)
    return found.withColumn("position", found["position"] + found["at"]).drop("at")


def scan_errors(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """Files that cannot be read, with the reason: path, name, error."""
    failed = Directory(spark, root).rows().where("error is not null")
    return failed.groupBy("path", "name").agg(F.min("error").alias("error"))


def scan_status(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """Every listed file with its family, why it has, or has not, text, and what went wrong (status ``failed``)."""
    found = Directory(spark, root)
    # Keep a short witness of visible text per row, never the text itself.
    witness = (
        found.rows()
        .selectExpr("path", f"case when {visible('text')} then 'x' else '' end as seen", "error")
        .groupBy("path")
        .agg(F.max("seen").alias("seen"), F.min("error").alias("error"))
    )
    return found.files.join(witness, "path", "left").selectExpr(
        "path", "name", "size", "format", "family",
        f"case when error is not null then 'failed' else {status('family', 'seen')} end as status", "error",
    )


def write_reports(profile: DataFrame, summary_path: str, detailed_path: str) -> None:
    """Both reports of a scan.

    Each sink evaluates the plan; store the profile as a table first when the
    corpus is large.
    """
    write_report(summary_report(profile), summary_path)
    write_report(detailed_report(profile), detailed_path)
