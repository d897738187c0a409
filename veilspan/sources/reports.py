"""Report projections, CSV sinks and the matching readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: report headers -----------------------------------------
DETAILED_HEADERS = [
    "путь",
    "имя_файла",
    "размер",
    "время_изменения",
    "категории_ПДн",
    "количество_находок",
    "УЗ",
    "формат_файла",
]
SUMMARY_SCHEMA = "size bigint, time string, name string"
DETAILED_SCHEMA = ", ".join(
    f"`{h}` {'bigint' if h == 'размер' else 'string'}" for h in DETAILED_HEADERS
)


def summary_report(profile: DataFrame) -> DataFrame:
    """size, time like 'sep 26 18:31', name."""
    return profile.selectExpr(
        "size", "lower(date_format(mtime, 'MMM dd HH:mm')) as time", "name"
    )


def detailed_report(profile: DataFrame) -> DataFrame:
    """Eight columns; categories and counts as comma-separated lists in rule order."""
    pairs = "transform(map_entries(pii_counts), e -> concat(e.key, ':', e.value))"
    values = [
        "path",
        "name",
        "size",
        "date_format(mtime, 'yyyy-MM-dd HH:mm:ss')",
        "array_join(pii_categories, ', ')",
        f"array_join({pairs}, ', ')",
        "protection_level",
        "format",
    ]
    return profile.selectExpr(*[f"{v} as `{h}`" for v, h in zip(values, DETAILED_HEADERS)])


def write_report(report: DataFrame, path: str) -> None:
    """CSV directory with a header in every part file; quotes are doubled."""
    (
        report.write.mode("errorifexists")
        .option("header", "true")
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A saved report with typed columns; an empty cell is an empty string."""
    report = (
        spark.read.schema(schema).option("header", "true").option("escape", '"').csv(path)
    )
    return report.na.fill("")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return read_report(spark, path, SUMMARY_SCHEMA)


def read_detailed(spark: SparkSession, path: str) -> DataFrame:
    return read_report(spark, path, DETAILED_SCHEMA)
