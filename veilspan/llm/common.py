"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.scratch import cut

#: Words between ASCII white space.
WHITE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over single batches."""

    def run(batches):
        for batch in batches:
            yield from function(batch)

    return df.mapInArrow(run, schema)


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the values only and that any SQL engine can repeat.

    52 bits of an MD5 digest, so the value and its logarithm are exact doubles.
    """
    digest = F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def crc_bucket(key: Column, n: int) -> Column:
    """crc32 of the key written as text, modulo n; null keys give 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def listed(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Array column whose k-th row holds the next counts[k] values."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


BITMAP_BITS = 1 << 26


def bitmap(values: DataFrame, column: str, most: int | None = None) -> np.ndarray:
    """Bit (value mod size) for each value of a long column: 8 MB, however many values.

    Where no more than ``most`` values are known to come, 1,024 bits a value are enough.
    Built by partial aggregates; the driver gets at most BITMAP_BITS / 32768 pieces of 4 KB.
    """
    size = BITMAP_BITS if most is None else min(BITMAP_BITS, max(1 << 15, 1 << (1024 * most).bit_length()))
    at = F.expr(f"({column} & {size - 1}) + 1")
    pieces = (
        values.select(at.alias("b"))
        .groupBy(F.expr("bitmap_bucket_number(b)").alias("k"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("bits"))
    )
    bits = np.zeros(size // 8, np.uint8)
    for k, piece in pieces.collect():  # bucket k holds the values (k - 1) * 32768 + 1 .. k * 32768
        bits[(k - 1) * 4096 : (k - 1) * 4096 + len(piece)] = np.frombuffer(piece, np.uint8)
    return bits


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value's bit is set."""
    where = (values.view(np.uint64) & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return ((bits[where >> 3] >> (where & 7).astype(np.uint8)) & 1).astype(bool)


def _plain_scan(docs: DataFrame) -> bool:
    """Whether each row is a row of a Parquet file, with columns chosen and rows filtered at most."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.deterministic():
        plan = plan.children().apply(0)
    if plan.nodeName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().fileFormat().toString() == "Parquet"


def numbered(docs: DataFrame, text: str) -> DataFrame:
    """Add _row, a number for each row of this input, and th, a hash of its text.

    The number is the row's place in its Parquet file below the file's place in the order of names,
    so it does not depend on splits or executors.  Rows that are not simply read from Parquet files
    are written once and read from there; all later scans must start from this result.
    """
    if not _plain_scan(docs):
        docs = cut(docs, "numbered")
    at = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    files = sorted(r[0] for r in at.select("_file").distinct().collect())  # one row a file
    places = docs.sparkSession.createDataFrame(
        pa.table({"_file": pa.array(files, pa.string()), "_place": pa.array(range(len(files)), pa.int64())})
    )
    place = F.coalesce("_place", F.raise_error(F.lit("a file that was not listed")).cast("bigint"))
    return (
        at.join(F.broadcast(places), "_file", "left")
        .withColumns({"_row": F.shiftleft(place, 40) + F.col("_index"), "th": F.xxhash64(F.col(text))})
        .drop("_file", "_place", "_index")
    )


def all_met(got: int, asked: int, what: str) -> None:
    """Fail where a join on (_row, th) lost rows, as when files change between two scans."""
    if got != asked:
        raise RuntimeError(f"{what}: {got} of {asked} rows found in a later scan; the input has changed")


def _sifted(rows: DataFrame, shared: Broadcast, inverse: bool = False, column: str = "th") -> DataFrame:
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(shared.value, batch.column(column).to_numpy()) ^ inverse))

    return rows.mapInArrow(run, rows.schema)


def sifted_by(rows: DataFrame, wanted: DataFrame, column: str = "th", most: int | None = None) -> tuple[DataFrame, Broadcast]:
    """The rows whose number in a column may be among the wanted ones; by a bitmap of bounded size, to be destroyed after use."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(wanted, column, most))
    return _sifted(rows, shared, column=column), shared


def maybe_in(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    return sifted_by(rows, wanted)[0]


def without(rows: DataFrame, columns: list[str], gone: DataFrame) -> DataFrame:
    """The columns of numbered rows but for the gone (_row, th); only texts that may be gone are shuffled."""
    asked = gone.count()
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(gone, "th", asked))
    met = _sifted(rows.select("_row", "th"), shared).join(gone, ["_row", "th"], "left_semi")
    all_met(met.count(), asked, "rows to leave out")
    doubt = _sifted(rows, shared).join(gone, ["_row", "th"], "left_anti")
    return _sifted(rows, shared, inverse=True).select(*columns).unionByName(doubt.select(*columns))


def label_sample(labels: DataFrame, key: str, label: str, most: int, balanced: bool) -> DataFrame:
    """About ``most`` labelled keys chosen by a hash of the key, 2 * most at the very most.

    The bound makes it safe to broadcast the result, so that texts are not shuffled to find their
    labels.  With balanced, each label gets an equal part.
    """
    known = labels.select(key, label).where(F.col(key).isNotNull() & F.col(label).isNotNull()).distinct()
    counts = {r[label]: r["count"] for r in known.groupBy(label).count().collect()}  # a few labels
    if not counts:
        return known
    total = sum(counts.values())
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, most / len(counts) / n if balanced else most / total)))
    drawn = (F.xxhash64(F.col(key)) / F.lit(2.0**64)) + 0.5
    return known.where(drawn < share[F.col(label)]).limit(2 * most)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or the first of ``input_name``, ``input_input_name`` and so on that no column has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"input_{name}"
    return name


def set_aside(df: DataFrame, results: list[str], *used: str) -> DataFrame:
    """Give input columns named like result columns another name (``input_<name>``); those in ``used`` stay."""
    wanted = {r.lower() for r in results}
    for c in [c for c in df.columns if c.lower() in wanted and c not in used]:
        df = df.withColumnRenamed(c, free_name(df, c))
    return df


#: Names that numbered rows and the operators on them use inside.
RESERVED = ("_row", "th", "_file", "_index", "_place", "_key", "_body", "copies", "_at", "_part")


def shielded(df: DataFrame, *used: str, reserved: tuple[str, ...] = RESERVED) -> tuple[DataFrame, dict[str, str]]:
    """Columns whose names are reserved under other names, and the names to give back; those in ``used`` stay."""
    aside = {c: free_name(df, f"kept_{c}") for c in df.columns if c.lower() in reserved and c not in used}
    return df.withColumnsRenamed(aside), {v: k for k, v in aside.items()}
