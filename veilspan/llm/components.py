"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.scratch import cut


def _stars(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Hang neighbours of each node on the least of them; nothing is collected per node.

    edges (a, b) have a > b.  larger_only: from every node's larger neighbours to its minimum
    (large star); otherwise from its smaller neighbours and itself (small star).
    """
    if larger_only:
        pairs = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    else:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = pairs.join(least, "u")
    if larger_only:
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return moved.where("a <> b")


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one node only, which hangs on none."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("hangs")).union(edges.select("b", F.lit(0)))
    held = ends.groupBy("x").agg(F.sum("hangs").alias("n"), F.min("hangs").alias("least"))
    return held.where("n > 1 or (n = 1 and least = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); the root is the component's least node.

    Each round is written to the shared folder; the driver only asks whether it was the last.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = cut(edges, "edges")
    while not _settled(edges):
        edges = cut(_stars(_stars(edges, True), False).distinct(), "edges")
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b"))
