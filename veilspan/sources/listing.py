"""File listing, metadata, routing by suffix and extraction status."""

from __future__ import annotations

from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veilspan.functions.patterns import SPACE
from veilspan.functions.sqltext import quoted
from veilspan.plans.runtime import scratch_path
from veilspan.sources.store import entries, reachable

# --- fixed values: file families, first match wins ------------------------
FAMILIES = [
    ("pdf", [".pdf"]),
    ("docx", [".docx", ".doc"]),
    ("text", [".txt", ".md"]),
    ("csv", [".csv"]),
    ("json", [".json"]),
    ("parquet", [".parquet"]),
    ("html", [".html", ".htm"]),
    ("image", [".tif", ".tiff", ".jpg", ".jpeg", ".png", ".gif"]),
    ("video", [".mp4", ".avi", ".mov"]),
]
# Families whose text Spark extracts; the others are listed but not read.
EXTRACTED = ("text", "csv", "json", "parquet", "html")
# --- fixed values: suffix groups of the report dimension ------------------
SUFFIX_GROUPS = [
    ("documents", [".pdf", ".doc", ".docx", ".rtf", ".xls", ".xlsx"]),
    ("structured", [".csv", ".json", ".parquet"]),
    ("images", [".tif", ".tiff", ".jpg", ".jpeg", ".png", ".gif"]),
    ("web", [".html", ".htm"]),
    ("video", [".mp4", ".avi", ".mov"]),
]


def base_name(path: str) -> str:
    return f"regexp_extract({path}, '[^/]*$', 0)"


def suffix(name: str) -> str:
    """Last dot part with its case; none for a leading-dot or trailing-dot name."""
    return f"regexp_extract({name}, '^.+(\\\\.[^.]+)$', 1)"


def family(path: str) -> str:
    """Family of a path by its lower-cased ending, null when unsupported."""
    arms = []
    for name, endings in FAMILIES:
        tests = " or ".join(f"endswith(lower({path}), '{e}')" for e in endings)
        arms.append(f"when {tests} then '{name}'")
    return f"case {' '.join(arms)} end"


def suffix_group(suffix_column: str) -> str:
    """Report dimension of a suffix; suffixes outside the groups are 'other'."""
    arms = []
    for name, endings in SUFFIX_GROUPS:
        listed = ", ".join(f"'{e}'" for e in endings)
        arms.append(f"when lower({suffix_column}) in ({listed}) then '{name}'")
    return f"case {' '.join(arms)} else 'other' end"


def status(family_column: str, text: str) -> str:
    """Why a file has, or has not, text to scan."""
    return (
        f"case when {family_column} is null then 'unsupported' "
        f"when {family_column} not in ({', '.join(repr(f) for f in EXTRACTED)}) "
        "then 'skipped_media' "
        f"when not coalesce({visible(text)}, false) then 'blank' else 'ok' end"
    )


def visible(text: str) -> str:
    """Whether a text holds anything but white space, of any kind that Unicode knows."""
    return f"rlike({text}, {quoted(f'[^{SPACE}]')})"


def with_metadata(df: DataFrame) -> DataFrame:
    """Add name and format to rows with a path."""
    named = df.selectExpr("*", f"{base_name('path')} as name")
    return named.selectExpr("*", f"{suffix('name')} as format")


def file_columns() -> list[str]:
    """Path, size and local modification time from a file source's metadata.

    The path in the metadata is percent-encoded; a plus sign is literal there.
    """
    return [
        "url_decode(replace(_metadata.file_path, '+', '%2B')) as path",
        "_metadata.file_size as size",
        "cast(_metadata.file_modification_time as timestamp_ntz) as mtime",
    ]


_FOUND = "path string, folder boolean, size bigint, mtime timestamp"
#: Folders that one task expands at most before more tasks share a level.
FOLDERS_A_TASK = 256


def _expand(batches):
    for batch in batches:
        for path in batch.column("path").to_pylist():
            found = iter(entries(path))
            while part := list(islice(found, 10_000)):
                columns = zip(*part)
                kinds = (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "folder", "size", "mtime"])


def expanded(folders: DataFrame, n: int) -> DataFrame:
    """What n folders hold, expanded by tasks that get an equal number of them."""
    cores = folders.sparkSession.sparkContext.defaultParallelism
    return folders.select("path").repartition(max(1, min(n, max(cores, n // FOLDERS_A_TASK)))).mapInArrow(_expand, _FOUND)


def list_files(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """Every file below folders, or the named files, whatever their names: path, size, mtime, name, format.

    Folders are expanded level by level, one Spark job a level with its folders dealt out evenly, so
    no task holds a whole subtree.  The list is kept in the shared scratch folder.  Only metadata is read, never
    content.  Stores that only Spark opens are listed by its file source, which passes over names that
    begin with an underscore or a dot.
    """
    roots = [root] if isinstance(root, str) else list(root)
    if not all(reachable(r) for r in roots):
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
        return with_metadata(listed.selectExpr("path", "length as size", "cast(modificationTime as timestamp_ntz) as mtime"))
    levels, n = [], len(roots)
    folders = spark.createDataFrame(pa.table({"path": pa.array(roots, pa.string())}))
    while n:
        at = scratch_path(spark, "listing")
        expanded(folders, n).write.parquet(at)
        found = spark.read.schema(_FOUND).parquet(at)
        levels.append(found.where("not folder"))
        folders = found.where("folder")
        n = folders.count()
    files = reduce(DataFrame.unionByName, levels)
    return with_metadata(files.selectExpr("path", "size", "cast(mtime as timestamp_ntz) as mtime"))
