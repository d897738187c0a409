"""Scan only the files that arrived since the last run.

A file stream hands over the names of new files, and each batch of names goes
through the batch scan, so every kind of file gives the same profiles either
way.  The checkpoint remembers which files were scanned.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from veilspan.plans.scan import scan_directory

# Fixed by the file source; a stream has to be told.
_BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def scan_new_files(
    spark: SparkSession, root: str, output: str, checkpoint: str, categories=None, files_a_batch: int = 1000
) -> StreamingQuery:
    """Write profiles of new files to Parquet folders ``output``/batch=N, then stop.

    At most ``files_a_batch`` names are on the driver at once.  A batch that is run again after a
    failure overwrites its own folder.
    """
    names = (
        spark.readStream.schema(_BINARY_SCHEMA)
        .format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_a_batch)
        .load(root)
        .select("path")
    )

    def scan(batch, number: int) -> None:
        paths = [r["path"] for r in batch.collect()]
        if paths:
            scan_directory(batch.sparkSession, paths, categories).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return (
        names.writeStream.foreachBatch(scan)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
