"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources in code point order (null last) weigh 1, 2, 3, repeating, and share the corpus's words;
a target stops at three times its source's size and the excess goes to the others by weight.
Each source is first taken in as many complete epochs as fit its target.  The rest is a weighted
sample without replacement: documents sorted by exponential keys -ln(u) / quality, taken while
the running sum of sizes comes nearer to the rest.

Only the slice of keys in which a source's budget ends is sorted: keys fall into fixed slices,
the sums of slices decide all others.  The first sum is per task, so a hot source is no problem.
Only the table of sources, one row each, and the sums of a source's slices are ordered in one task.

Defined results: a null text has size 0 and is never sampled beyond complete epochs; rows that
are equal in every column are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.common import RESERVED, WHITE_WORD, all_met, numbered, shielded, table, uniform
from veilspan.llm.scratch import cut

MOST_EPOCHS = 3
SLICES = 400  # in an octave of keys
SEED = "mix"
#: Characters that speak against prose.
NOISE = "#*$%&|<>{}[]=_^~0123456789"


def prose_quality(text: Column) -> Column:
    """0.1 to 1: 1 for plain prose, less the more characters are symbols or digits."""
    share = F.length(F.translate(text, NOISE, "")) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.1), share * 2 - 1), F.lit(0.1))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source.

    With sources ordered by the factor at which they are full, 3 * size / weight, the first k are
    full and the others get one common factor times their weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("_limit", "_rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    return (
        sizes.withColumn("_rank", F.row_number().over(by_name))
        .withColumn("_weight", (F.col("_rank") - 1) % 3 + 1)
        .withColumn("_limit", MOST_EPOCHS * F.col("source_size") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_full", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * MOST_EPOCHS)
        .withColumn("_factor", (F.col("_total") - F.col("_full")) / F.sum("_weight").over(from_here))
        # The first source that does not fill up sets the factor of all after it.
        .withColumn("_common", F.min(F.when(F.col("_factor") <= F.col("_limit"), F.struct("_limit", "_rank", "_factor"))).over(everything))
        .withColumn(
            "target",
            F.when(
                F.struct("_limit", "_rank") >= F.struct(F.col("_common._limit"), F.col("_common._rank")),
                F.col("_common._factor") * F.col("_weight"),
            ).otherwise(F.col("source_size") * F.lit(float(MOST_EPOCHS))),
        )
        .select("source", "source_size", F.col("target").cast("double"))
    )


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Narrow rows: id, source, size in words and the exponential key with its slice."""
    keep = [c for c in ("_row", "th") if c in docs.columns]
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WHITE_WORD)), F.lit(0)).cast("long")
    drawn = -F.log(uniform(F.lit(SEED), F.col(key))) / prose_quality(F.col(text))
    return (
        docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words.alias("size"), drawn.alias("_key"), *keep)
        # Rises with the key; by its logarithm, no slice holds more than one in 1,500 rows of a source, whatever their quality.
        .withColumn("_slice", F.floor(F.log2(1 + 64 * F.col("_key")) * SLICES).cast("int"))
    )


def mix(measured: DataFrame) -> DataFrame:
    """Add source_size, target and taken (words the mix takes, repeats counted) to measured rows."""
    slices = measured.groupBy("source", "_slice").agg(F.sum("size").alias("_sum"))
    aims = targets(slices.groupBy("source").agg(F.sum("_sum").alias("source_size"))).withColumn(
        "_epochs", F.least(F.lit(MOST_EPOCHS), F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)) + 1e-9))
    ).withColumn("_rest", F.greatest(F.col("target") - F.col("_epochs") * F.col("source_size"), F.lit(0.0)))
    running = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        slices.withColumn("_before", F.coalesce(F.sum("_sum").over(running), F.lit(0)))
        .join(aims.select(F.col("source").alias("_s"), "_rest"), F.col("source").eqNullSafe(F.col("_s")))
        .where("_before <= _rest")
        .groupBy("source")
        .agg(F.max(F.struct("_slice", "_before")).alias("_end"))
        .select(F.col("source").alias("_s"), F.col("_end._slice").alias("_end"), F.col("_end._before").alias("_before"))
    )
    aims = (
        aims.join(last, F.col("source").eqNullSafe(F.col("_s")), "left")
        .select(F.col("source").alias("_t"), "source_size", "target", "_epochs", "_rest", "_end", "_before")
    )
    # Rows meet their source's aims slice by slice, so a hot source is many small keys.
    aims = (
        slices.select(F.col("source").alias("_s"), F.col("_slice").alias("_k"))
        .join(aims, F.col("_s").eqNullSafe(F.col("_t")))
        .drop("_t")
    )
    rows = measured.join(aims, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_k"))).drop("_s", "_k")
    at_end = F.col("_slice") == F.col("_end")
    in_order = (
        Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    cutoff = (
        rows.where(at_end)
        .withColumn("_sum", F.col("_before") + F.coalesce(F.sum("size").over(in_order), F.lit(0)))
        .withColumn("_extra", F.col("_sum") + F.col("size") / 2 <= F.col("_rest"))
    )
    settled = rows.where(~at_end | F.col("_end").isNull()).withColumn(
        "_extra", F.coalesce(F.col("_slice") < F.col("_end"), F.lit(False))
    )
    both = settled.unionByName(cutoff.drop("_sum"))
    taken = F.col("size") * (F.col("_epochs") + F.col("_extra").cast("int"))
    copies = F.least(F.col("_epochs") + F.col("_extra").cast("int"), F.lit(MOST_EPOCHS)).cast("int")
    return both.select(
        "doc_id", "source", "size", "source_size", "target", F.least(taken, MOST_EPOCHS * F.col("size")).cast("long").alias("taken"),
        copies.alias("copies"), *(c for c in ("_row", "th") if c in measured.columns),
    )


def draw(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents as often as the mix takes them, with all their columns."""
    docs, names = shielded(docs, key, text, source, reserved=(*RESERVED, "_copy"))
    rows = numbered(docs, text)
    mixed = cut(mix(cut(measure(rows, key, text, source), "sizes")).where("copies > 0").select("_row", "th", "copies"), "mixed")
    met = rows.select("_row", "th").join(mixed, ["_row", "th"], "left_semi")
    all_met(met.count(), mixed.count(), "rows of the mix")
    taken = rows.join(mixed, ["_row", "th"])
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*docs.columns).withColumnsRenamed(names)


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(cut(measure(docs), "sizes")).select("doc_id", "size", "source_size", "target", "taken")


# With equal hashes and sums of integers, only the order of keys matters: both engines agree.
OP8_SQL = r"""
with base as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    -ln((cast('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null')), 1, 13) as bigint)::double + 0.5)
        / 4503599627370496.0)
      / coalesce(greatest(0.1, length(translate(text, '#*$%&|<>{}[]=_^~0123456789', ''))::double
                               / greatest(length(text), 1) * 2 - 1), 0.1) as k
  from documents),
sizes as (select source, sum(size)::bigint as source_size from base group by source),
ranked as (select *, row_number() over (order by source nulls last) as r from sizes),
weighed as (select *, (r - 1) % 3 + 1 as w, 3 * source_size / ((r - 1) % 3 + 1)::double as lim from ranked),
factors as (
  select *, ((sum(source_size) over ())
      - 3 * coalesce(sum(source_size) over (order by lim, r rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(w) over (order by lim, r rows between current row and unbounded following)) as f
  from weighed),
first_open as (select lim as l0, r as r0, f as f0 from factors where f <= lim order by lim, r limit 1),
aims as (
  select source, source_size, case when (lim, r) >= (l0, r0) then f0 * w else 3.0 * source_size end::double as target
  from factors left join first_open on true),
split as (
  select *, least(3, floor(target / greatest(source_size, 1) + 1e-9)) as epochs from aims),
rest as (select *, greatest(target - epochs * source_size, 0.0) as rest from split),
ordered as (
  select b.doc_id, b.size, s.source_size, s.target, s.epochs, s.rest,
    coalesce(sum(b.size) over (partition by b.source order by b.k, b.doc_id, b.size
      rows between unbounded preceding and 1 preceding), 0) as before
  from base b join rest s on b.source is not distinct from s.source)
select doc_id, size, source_size, target,
  least(size * (epochs + case when before + size / 2.0 <= rest then 1 else 0 end), 3 * size)::bigint as taken
from ordered
"""
