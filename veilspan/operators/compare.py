"""Comparison of two reports by file name.

All operators start from one aggregate per name, which is combined before the
shuffle: a name that fills a large part of a report sends one partial row per
task.  Reports that are compared often are stored by name and merged without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(report: DataFrame, key: str = "name", order: str = "seq") -> DataFrame:
    """One row per name: the one that comes last in ``order``.

    The remaining columns break ties, so the result does not depend on task order.
    """
    rest = [c for c in report.columns if c not in (key, order)]
    last = F.max(F.struct(order, *rest)).alias("last")
    return report.groupBy(key).agg(last).select(
        key, *[F.col(f"last.{c}").alias(c) for c in (order, *rest)]
    )


def presence(left: DataFrame, right: DataFrame, key: str = "name") -> DataFrame:
    """One row per name with two flags, from one shuffle of both reports."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    return sides.groupBy(key).agg(F.max("l").alias("in_left"), F.max("r").alias("in_right"))


def _in_both(flags: DataFrame, key: str) -> DataFrame:
    return flags.where("in_left = 1 and in_right = 1").select(key)


def _in_left_only(flags: DataFrame, key: str) -> DataFrame:
    return flags.where("in_right = 0").select(key)


def _in_right_only(flags: DataFrame, key: str) -> DataFrame:
    return flags.where("in_left = 0").select(key)


def _counts(flags: DataFrame) -> DataFrame:
    return flags.agg(
        *[
            F.coalesce(F.sum(F.expr(e).cast("bigint")), F.lit(0)).alias(n)
            for n, e in [
                ("left_files", "in_left"),
                ("right_files", "in_right"),
                ("common_files", "in_left * in_right"),
                ("only_left", "1 - in_right"),
                ("only_right", "1 - in_left"),
            ]
        ]
    )


def _sample(flags: DataFrame, n: int, key: str) -> DataFrame:
    # Both sides look at both flags: their aggregates are then equal, and the reports are scanned for one of them only.
    one_sided = flags.where("in_left <> in_right")

    def side(label: str, names: DataFrame) -> DataFrame:
        return names.select(F.lit(label).alias("side"), key).orderBy(key).limit(n)

    return side("left", _in_left_only(one_sided, key)).unionByName(side("right", _in_right_only(one_sided, key)))


def common(left: DataFrame, right: DataFrame, key: str = "name") -> DataFrame:
    return _in_both(presence(left, right, key), key)


def only_left(left: DataFrame, right: DataFrame, key: str = "name") -> DataFrame:
    return _in_left_only(presence(left, right, key), key)


def only_right(left: DataFrame, right: DataFrame, key: str = "name") -> DataFrame:
    return _in_right_only(presence(left, right, key), key)


def diff_counts(left: DataFrame, right: DataFrame, key: str = "name") -> DataFrame:
    """Distinct names left, right, in both, left only, right only."""
    return _counts(presence(left, right, key))


def diff_sample(left: DataFrame, right: DataFrame, n: int = 10, key: str = "name") -> DataFrame:
    """The first n names, in order, of each one-sided set."""
    return _sample(presence(left, right, key), n, key)


BUCKETS = 64
# Equality of buckets knows no nulls: a name is kept behind a slash, and no name as an empty text.
_KEY = "_name"


def store_report(report: DataFrame, table: str, key: str = "name", order: str = "seq", buckets: int = BUCKETS) -> None:
    """Keep the last row of every name in a table that is bucketed and sorted by name.

    Rows without a name count as one name.  Reports that are to be compared must have the same number of buckets.
    """
    kept = latest(report, key, order).withColumn(_KEY, F.coalesce(F.concat(F.lit("/"), key), F.lit("")))
    kept.repartition(buckets, _KEY).write.bucketBy(buckets, _KEY).sortBy(_KEY).mode("overwrite").saveAsTable(table)


class StoredComparison:
    """The comparisons of two stored reports, merged bucket by bucket: no names are shuffled."""

    def __init__(self, spark: SparkSession, left: str, right: str, key: str = "name") -> None:
        self.key = key
        a = spark.table(left).select(_KEY, F.lit(1).alias("l")).hint("merge")
        sides = a.join(spark.table(right).select(_KEY, F.lit(1).alias("r")), _KEY, "full_outer")
        name = F.when(F.col(_KEY) != "", F.expr(f"substr({_KEY}, 2)")).alias(key)
        self.flags = sides.select(name, *(F.coalesce(c, F.lit(0)).alias(n) for c, n in (("l", "in_left"), ("r", "in_right"))))

    def common(self) -> DataFrame:
        return _in_both(self.flags, self.key)

    def only_left(self) -> DataFrame:
        return _in_left_only(self.flags, self.key)

    def only_right(self) -> DataFrame:
        return _in_right_only(self.flags, self.key)

    def diff_counts(self) -> DataFrame:
        return _counts(self.flags)

    def diff_sample(self, n: int = 10) -> DataFrame:
        return _sample(self.flags, n, self.key)
