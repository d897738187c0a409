"""Parallelism and scratch space, both stated by the session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Number of partitions to deal small inputs out to; by default inputs stay as they are split.
SPREAD = "spark.veilspan.spread"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out by their unique keys, if the session asks for it.

    A scan cannot cut a Parquet row group, so a small table may keep one core busy; a shuffle of
    its text is worth while on one machine and is not on large data, so only the user can tell.
    """
    n = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(n), *keys) if n else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """New path in the folder that all executors share, or in the warehouse.

    On a cluster a folder of one machine is none that all share, so the warehouse then must be elsewhere.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir")
        if shared.startswith("file:") and spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
