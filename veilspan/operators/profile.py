"""Per-file profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.functions.patterns import select_rules
from veilspan.operators.detect import count_matches
from veilspan.operators.levels import protection_level

FILE_COLUMNS = ["path", "name", "size", "mtime", "format"]
PROFILE_COLUMNS = [
    "path",
    "name",
    "size",
    "mtime",
    "pii_categories",
    "pii_counts",
    "protection_level",
    "format",
]


def finish_profile(counted: DataFrame, categories) -> DataFrame:
    """Profiles from a row per file with its counts struct: the ordered map, category list and level."""
    names = [r.category for r in select_rules(categories)]
    pairs = ", ".join(f"'{n}', counts.{n}" for n in names)
    mapped = counted.selectExpr(
        *FILE_COLUMNS, f"map_filter(map({pairs}), (k, v) -> v > 0) as pii_counts"
    )
    return mapped.selectExpr(
        *FILE_COLUMNS,
        "map_keys(pii_counts) as pii_categories",
        "pii_counts",
        f"{protection_level('pii_counts')} as protection_level",
    ).select(*PROFILE_COLUMNS)


def profile_files(corpus: DataFrame, text: str = "text", categories=None) -> DataFrame:
    """Profiles of a corpus with one row per file: a narrow job, no shuffle.

    Files without text or without findings are dropped.
    """
    return finish_profile(count_matches(corpus, FILE_COLUMNS, text, categories), categories)


def profile_rows(
    corpus: DataFrame, text: str = "text", categories=None, sum_sizes: bool = False
) -> DataFrame:
    """Profiles of a corpus with several rows per file.

    ``size`` is the size of the file on every row, or with ``sum_sizes`` the
    size of the row.  Counts are summed before the shuffle, so a file that owns
    a large share of the rows sends one partial row per task.
    """
    names = [r.category for r in select_rules(categories)]
    sums = ", ".join(f"'{n}', sum(counts.{n})" for n in names)
    counted = count_matches(corpus, FILE_COLUMNS, text, categories, drop_empty=not sum_sizes)
    grouped = counted.groupBy("path", "name", "format").agg(
        (F.sum if sum_sizes else F.max)("size").alias("size"),
        F.max("mtime").alias("mtime"),
        F.expr(f"named_struct({sums})").alias("counts"),
    )
    any_match = " + ".join(f"counts.{n}" for n in names)
    return finish_profile(grouped.where(f"{any_match} > 0"), categories)


def counts_of_files(whole: DataFrame, parts: DataFrame, seen: str, categories=None) -> DataFrame:
    """FILE_COLUMNS, counts, seen and error of every file that has rows, with or without findings.

    ``whole`` has one row a file and is not shuffled; counts of ``parts`` are summed before their shuffle.
    ``seen`` tells whether a row's text counts as text.
    """
    names = [r.category for r in select_rules(categories)]
    keep = [*FILE_COLUMNS, "seen", "error"]

    def counted(rows: DataFrame) -> DataFrame:
        return count_matches(rows.selectExpr("*", f"coalesce({seen}, false) as seen"), keep, "text", categories, drop_empty=False)

    sums = ", ".join(f"'{n}', sum(counts.{n})" for n in names)
    grouped = counted(parts).groupBy("path", "name", "format").agg(
        F.max("size").alias("size"),
        F.max("mtime").alias("mtime"),
        F.max("seen").alias("seen"),
        F.min("error").alias("error"),
        F.expr(f"named_struct({sums})").alias("counts"),
    )
    return counted(whole).unionByName(grouped)


def found_any(categories=None) -> str:
    """Whether a counts struct holds a finding."""
    return " + ".join(f"counts.{r.category}" for r in select_rules(categories)) + " > 0"


def category_counts(corpus: DataFrame, text: str = "text", categories=None) -> DataFrame:
    """Matches per file and category: path, category, n.

    Rows are counted where they are; only partial sums per file and category
    are shuffled, never single matches.
    """
    names = [r.category for r in select_rules(categories)]
    pairs = ", ".join(
        f"named_struct('category', '{n}', 'n', counts.{n})" for n in names
    )
    counted = count_matches(corpus, ["path"], text, categories)
    return (
        counted.selectExpr("path", f"inline(array({pairs}))")
        .where("n > 0")
        .groupBy("path", "category")
        .agg(F.sum("n").alias("n"))
    )


def count_findings(found: DataFrame, key: str = "path") -> DataFrame:
    """The same from a findings table."""
    return found.groupBy(key, "category").agg(F.count("*").alias("n"))
