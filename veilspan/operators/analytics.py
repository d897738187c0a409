"""Figures over reports.

Every operator reduces to small groups (levels, suffixes, categories) with
partial aggregation before its shuffle.  The share columns use a window over
the grouped rows only, of which there are as many as labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.sources.listing import suffix_group


def level_counts(profile: DataFrame, level: str = "protection_level") -> DataFrame:
    """Files per protection level with the total, sorted by label."""
    return _with_total(profile.groupBy(level).agg(F.count("*").alias("files"))).orderBy(level)


def size_stats(report: DataFrame, size: str = "size") -> DataFrame:
    """Rows, total, mean, smallest and largest size, with unit conversions."""
    return report.agg(
        F.count("*").alias("files"),
        F.sum(size).alias("total_bytes"),
        F.avg(size).alias("mean_bytes"),
        F.min(size).alias("min_bytes"),
        F.max(size).alias("max_bytes"),
    ).selectExpr(
        "*", "total_bytes / 1024 / 1024 as total_mb", "mean_bytes / 1024 as mean_kb"
    )


def top_files(report: DataFrame, n: int = 10, size: str = "size", name: str = "name") -> DataFrame:
    """The n largest files with rank; equal sizes are ordered by name."""
    largest = report.select(size, name).orderBy(F.desc(size), name).limit(n)
    # The window sees n rows, whatever the size of the report.
    order = Window.orderBy(F.desc(size), name)
    return largest.select(
        F.row_number().over(order).alias("rank"),
        name,
        size,
        (F.col(size) / 1024 / 1024).alias("size_mb"),
    )


def _with_total(grouped: DataFrame) -> DataFrame:
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return grouped.withColumn("total", F.sum("files").over(everything.partitionBy(F.lit(1))))


def share(report: DataFrame, column: str) -> DataFrame:
    """Files per label and their percentage of all files."""
    grouped = report.groupBy(column).agg(F.count("*").alias("files"))
    return _with_total(grouped).selectExpr(
        f"`{column}`", "files", "round(files * 100.0D / total, 1) as percent"
    )


def level_share(report: DataFrame, level: str = "УЗ") -> DataFrame:
    return share(report, level).orderBy(level)


def format_share(report: DataFrame, suffix: str = "формат_файла") -> DataFrame:
    return share(report, suffix).orderBy(F.desc("files"), suffix)


def top_categories(report: DataFrame, n: int = 10, categories: str = "категории_ПДн") -> DataFrame:
    """Categories by the number of files they occur in."""
    return (
        report.select(F.explode(F.split(categories, ", ")).alias("category"))
        .groupBy("category")
        .agg(F.count("*").alias("files"))
        .orderBy(F.desc("files"), "category")
        .limit(n)
    )


def family_share(report: DataFrame, suffix: str = "формат_файла") -> DataFrame:
    """Files per suffix group; the group is a projection, so no join is needed."""
    grouped = report.selectExpr(f"{suffix_group(f'`{suffix}`')} as family")
    return share(grouped, "family").orderBy("family")
