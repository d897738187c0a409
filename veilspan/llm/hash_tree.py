"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level a key draws -ln(u) / weight for every child, u being a hash of the key and the
child's name; the least draw wins, so a child is chosen in proportion to its subtree's weight.
Draws of untouched children never change: when one subtree's weight changes, keys move only
into or out of that subtree.  layout() gives shards beyond its base a region of their own, so
one more shard takes rows only into itself.

Defined results: a null key is a key like any other; a null text is empty; equal keys always
share a shard; zero-weight nodes get nothing; extra columns pass through, those named
like results as ``input_<name>``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.common import set_aside, shielded, table, uniform
from veilspan.llm.scratch import cut

BASE_SHARDS = 24


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(n_shards: int, base: int = BASE_SHARDS, per_rack: int = 4, racks: int = 2) -> list[Shard]:
    """Racks of per_rack shards, regions of racks racks; each shard from base on opens a region."""
    tree = []
    for s in range(min(n_shards, base)):
        rack = s // per_rack
        tree.append(Shard(rack // racks, rack, s))
    first = (base - 1) // (per_rack * racks) + 1
    tree += [Shard(first + s - base, (base - 1) // per_rack + 1 + s - base, s) for s in range(base, n_shards)]
    return tree


def _children(tree: list[Shard]) -> dict[str, dict[str, float]]:
    """Parent's name -> child's name -> weight of the child's subtree."""
    nodes: dict[str, dict[str, float]] = {}
    for leaf in tree:
        if leaf.weight <= 0:
            continue
        region, rack = f"r{leaf.region}", f"r{leaf.region}/k{leaf.rack}"
        for parent, child in (("", region), (region, rack), (rack, f"{leaf.shard}")):
            level = nodes.setdefault(parent, {})
            level[child] = level.get(child, 0.0) + leaf.weight
    return nodes


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """The shard a key descends to; an empty tree gives null."""
    nodes = _children(tree)
    if not nodes:
        return F.lit(None).cast("int")

    def pick(parent: str) -> Column:
        draws = [
            F.struct((-F.log(uniform(key, F.lit(child))) / F.lit(weight)).alias("draw"), F.lit(child).alias("name"))
            for child, weight in sorted(nodes[parent].items())
        ]
        return F.array_min(F.array(*draws))["name"]

    def descend(parent: str, depth: int) -> Column:
        chosen = pick(parent)
        if depth == 2:
            return chosen.cast("int")
        names = sorted(nodes[parent])
        if len(names) == 1:
            return descend(names[0], depth + 1)
        # One lambda variable holds the choice: it is drawn once, and only its branch is evaluated.
        def branch(c: Column) -> Column:
            out = F.when(c == names[0], descend(names[0], depth + 1))
            for name in names[1:]:
                out = out.when(c == name, descend(name, depth + 1))
            return out

        return F.transform(F.array(chosen), branch)[0]

    return descend("", 0)


def place(docs: DataFrame, n_shards: int = BASE_SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add size, text_crc32, law, shard and grown_shard (the shard with one more shard) to each row."""
    docs = set_aside(docs, ["size", "text_crc32", "law", "shard", "grown_shard"], key, text)
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns(
        {
            "size": F.octet_length(body).cast("long") + 8,
            "text_crc32": F.crc32(body.cast("binary")),
            "law": F.lit("key"),
            "shard": shard_of(F.col(key), layout(n_shards)),
            "grown_shard": shard_of(F.col(key), layout(n_shards + 1)),
        }
    )


def number(placed: DataFrame) -> DataFrame:
    """Add slot: 0, 1, ... within each shard, without any gap.

    Each input partition numbers its own rows of a shard, starting where the partitions before it
    end; so no task ever holds more than one partition's rows, however hot a shard or a key is.
    """
    placed, names = shielded(set_aside(placed, ["slot"]), reserved=("_at", "_part", "_nth", "_start"))
    rows = cut(placed.withColumn("_at", F.monotonically_increasing_id()), "placed")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("shard", "_part")
        .agg(F.count("*").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy("shard", "_part").orderBy("_at")
    return (
        rows.withColumn("_nth", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "_part"])
        .withColumn("slot", (F.col("_start") + F.col("_nth")).cast("long"))
        .drop("_at", "_part", "_nth", "_start")
        .withColumnsRenamed(names)
    )


def op10_hash_tree(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    columns = ["doc_id", "size", "text_crc32", "law", "shard", "grown_shard"]
    return number(place(docs).select(*columns)).select(*columns[:5], "slot", "grown_shard")
