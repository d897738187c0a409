"""N-gram Jaccard join with grouped prefixes: near-duplicate classes at a similarity of THRESHOLD.

A document is the set of its distinct SHINGLE-word shingles (hashed to 64 bits).  Two sets at the
threshold share one of the first n - ceil(0.75 n) + 1 shingles of each, in any order common to
all documents; here shingles seen often come last, so prefixes are selective.

1. Documents with equal sets are one node; nodes with identical prefixes and size are one group.
2. Groups that share a prefix shingle are candidate pairs, filtered by size.  A shingle with more
   than FEW groups is crowded and not expanded.
3. The leaders of paired groups and the members of a group are verified on their texts, which
   gives first components.
4. In a round, or two where a shingle is cut into shares, each member of a crowded shingle is
   verified with a few others of other components, which joins the members of a large group of
   copies with few pairs.
5. Every remaining candidate pair, be it of a crowded shingle or of members of groups, whose ends
   still lie in different components is verified; pairs inside one component cannot change it.
   Members of a crowded shingle meet only if their sizes and sketches allow the similarity: a
   sketch of SKETCH words holds the parity of shingles in each bit, so bits that differ count
   shingles that differ, and no pair that links is passed over.

So no link between different texts is lost and no group is expanded into all its pairs.
The frequent shingles travel as a bitmap of fixed size; it only affects the order.

Defined results: null and empty texts have no shingles and stay alone; repeated rows are one node;
a null doc_id never becomes a component_id unless the whole component has none.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm import textkit as tk
from veilspan.llm.common import all_met, bitmap, in_bitmap, numbered, shielded, sifted_by, table, without
from veilspan.llm.components import components
from veilspan.llm.scratch import cut, shuffle_partitions

SHINGLE = 5
PERCENT = 75
FEW = 24
OFTEN = 2  # times within a block of shingles
ROUNDS, PARTNERS, SHARE = 2, 3, 512
APART = f"root <> root2 and 100 * least(n, n2) >= {PERCENT} * greatest(n, n2)"
SKETCH = 16  # words
_WORDS = [f"s{k}" for k in range(SKETCH)]
BLOCK = 1 << 22
MOST_FREQUENT = 1 << 23
_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of all distinct shingles, sorted by row and hash, and their number by row."""
    n_rows = len(offsets) - 1
    low = tk.LOWER[data]
    starts, ends, row = tk.words(low, offsets, tk.NOT_WHITE)
    hashes = tk.Prefix(low).ranges(starts, ends)
    at, h = tk.grams(hashes, row, SHINGLE)
    rows = row[at]
    n_words = tk.per_row(row, n_rows)
    few = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(few):
        first = np.concatenate([[0], np.cumsum(n_words)])
        short = np.zeros(len(few), np.uint64)
        for k in range(SHINGLE - 1):
            have = n_words[few] > k
            short[have] = tk.mix(short[have] * _U(3) + hashes[first[few[have]] + k] + _U(k + 1))
        rows, h = np.concatenate([rows, few]), np.concatenate([h, short])
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])])
        rows, h = rows[new], h[new]
    return rows, h, tk.per_row(rows, n_rows)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each row's next counts[row] values."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _nodes(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Identity of each row's set."""
    return tk.mix(_sums(tk.mix(h ^ _U(0x5851F42D4C957F2D)), counts) + counts.astype(np.uint64)).view(np.int64)


def _measured(batches):
    """Rows: every document's node; and, with often set, shingles that many sets of a block share."""
    held, size, seen = [], 0, set()

    def often():
        h, n = np.unique(np.concatenate(held), return_counts=True)
        h, n = h[n >= OFTEN], n[n >= OFTEN]
        none = pa.nulls(len(h), pa.int64())
        return pa.RecordBatch.from_arrays(
            [none, none, pa.array(h.view(np.int64)), pa.array(n, pa.int64()), none], names=["_row", "n_shingles", "node", "often", "th"]
        )

    for batch in batches:
        for first, end, data, offsets in tk.slices(batch.column("_body")):
            rows, h, counts = shingle_sets(data, offsets)
            nodes = _nodes(h, counts)
            part = batch.slice(first, end - first)
            yield pa.RecordBatch.from_arrays(
                [part.column("_row"), pa.array(counts, pa.int64()), pa.array(nodes), pa.nulls(end - first, pa.int64()), part.column("th")],
                names=["_row", "n_shingles", "node", "often", "th"],
            )
            fresh = np.array([not (x in seen or seen.add(x)) for x in nodes.tolist()], bool)
            held.append(h[fresh[rows]])
            size += len(held[-1])
            if size >= BLOCK:
                yield often()
                held, size, seen = [], 0, set()
    if size:
        yield often()


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """Bitmap of the most frequent shingles, at most MOST_FREQUENT by whole powers of two."""
    counted = cut(frequent.groupBy("h").agg(F.sum("often").alias("n")), "often")
    by_power = counted.groupBy(F.floor(F.log2("n")).alias("p")).count().collect()  # at most 63 rows
    least, total = 64, 0
    for p, n in sorted(by_power, reverse=True):
        total += n
        if total > MOST_FREQUENT:
            break
        least = p
    return bitmap(counted.where(F.col("n") >= 2.0**least), "h")


def prefixes(h: np.ndarray, rows: np.ndarray, counts: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle) of all prefixes in the common order, and the group of each row."""
    order = np.lexsort((h, in_bitmap(bits, h), rows))
    h, rows = h[order], rows[order]
    ends = np.cumsum(counts)
    nth = np.arange(len(h)) - (ends - counts)[rows]
    length = np.where(counts > 0, counts - -(-PERCENT * counts // 100) + 1, 0)
    inside = nth < length[rows]
    rows, h = rows[inside], h[inside]
    groups = tk.mix(_sums(tk.mix(h ^ _U(0x14057B7EF767814F)), length) + counts.astype(np.uint64)).view(np.int64)
    return rows, h, groups


def _postings(shared, buckets: int, few: int):
    """Blocks of (shingle, group, size), dealt to buckets by the shingle; one row per bucket and block.

    A group or node that a block has seen is not posted again; of a shingle with more than FEW
    groups in the block only one group is posted, marked as crowded, and all go out as rows
    (shingle, group, -size) of their own.  Nodes go out as (node, group, size).  Both kinds of
    rows only pass through the buckets, which they are dealt to evenly, so one shuffle carries all.
    """

    def run(batches):
        tokens, groups, sizes, total, seen, seen_nodes = [], [], [], 0, set(), set()

        def flush():
            t, g, n = np.concatenate(tokens), np.concatenate(groups), np.concatenate(sizes)
            order = np.lexsort((g, t))
            t, g, n = t[order], g[order], n[order]
            start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            many = np.diff(np.concatenate([start, [len(t)]]))
            crowded = np.repeat(many > few, many)
            lead = np.zeros(len(t), bool)
            lead[start] = True
            yield _rows(((g[crowded].view(np.uint64) ^ t[crowded]) % _U(buckets)), t[crowded], g[crowded], -n[crowded])
            keep = ~crowded | lead
            t, g, n = t[keep], g[keep], np.where(crowded[keep], -n[keep], n[keep])
            bucket = (t >> _U(32)) % _U(buckets)
            order = np.argsort(bucket, kind="stable")
            t, g, n, bucket = t[order], g[order], n[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() + [len(t)]
            at = list(zip(cuts, cuts[1:]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[cuts[:-1]].astype(np.int32)),
                    pa.array([t[a:b].tobytes() for a, b in at], pa.binary()),
                    pa.array([g[a:b].tobytes() for a, b in at], pa.binary()),
                    pa.array([n[a:b].astype(np.int32).tobytes() for a, b in at], pa.binary()),
                    *(pa.nulls(len(at), pa.int64()) for _ in range(3)),
                ],
                names=_POSTED,
            )

        for batch in batches:
            for first, end, data, offsets in tk.slices(batch.column("_body")):
                rows, h, counts = shingle_sets(data, offsets)
                nodes = _nodes(h, counts)
                rows, h, group = prefixes(h, rows, counts, shared.value)
                new = np.array([not (x in seen_nodes or seen_nodes.add(x)) for x in nodes.tolist()], bool) & (counts > 0)
                yield _rows(nodes[new].view(np.uint64) % _U(buckets), nodes[new], group[new], counts[new])
                fresh = np.array([not (x in seen or seen.add(x)) for x in group.tolist()], bool)[rows]
                tokens.append(h[fresh])
                groups.append(group[rows[fresh]])
                sizes.append(counts[rows[fresh]])
                total += len(tokens[-1])
                if total >= BLOCK // 2:
                    yield from flush()
                    tokens, groups, sizes, total, seen, seen_nodes = [], [], [], 0, set(), set()
        if total:
            yield from flush()

    return run


_POSTED = ["bucket", "tokens", "groups", "sizes", "x", "y", "z"]
_POSTED_SQL = "bucket int, tokens binary, groups binary, sizes binary, x bigint, y bigint, z bigint"


def _rows(bucket: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> pa.RecordBatch:
    n = len(bucket)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket.astype(np.int32)),
            *(pa.nulls(n, pa.binary()) for _ in range(3)),
            pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(z.astype(np.int64)),
        ],
        names=_POSTED,
    )


def _paired(found: pa.Table, few: int) -> pa.Table:
    """Of one bucket: candidate pairs of groups (kind 0), groups of crowded shingles (1) and nodes (2)."""
    single = found.filter(pc.is_valid(found.column("x")))
    x, y, z = (single.column(c).to_numpy() for c in "xyz")
    found = found.filter(pc.is_null(found.column("x")))
    if not found.num_rows:
        return _kinds([(np.where(z < 0, 1, 2), x, y, np.abs(z))])
    t = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in found.column("tokens")])
    g = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in found.column("groups")])
    n = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in found.column("sizes")]).astype(np.int64)
    order = np.lexsort((g, t))
    t, g, n = t[order], g[order], n[order]
    crowd, n = n < 0, np.abs(n)
    start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.empty(0, np.int64)
    many = np.diff(np.concatenate([start, [len(t)]]))
    crowded = np.repeat((many > few) | np.logical_or.reduceat(crowd, start), many) if len(t) else np.empty(0, bool)
    pairs = []
    index, left = np.arange(len(t)), np.repeat(start + many, many)
    open_ = ~crowded
    for step in range(1, min(few, int(many.max(initial=1)))):
        a = index[open_ & (index + step < left)]
        b = a + step
        small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        ok = (g[a] != g[b]) & (100 * small >= PERCENT * large)
        pairs.append(np.stack([np.minimum(g[a[ok]], g[b[ok]]), np.maximum(g[a[ok]], g[b[ok]])], 1))
    both = np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), np.int64)
    return _kinds(
        [
            (np.zeros(len(both)), both[:, 0], both[:, 1], np.zeros(len(both))),
            (np.ones(crowded.sum()), t[crowded].view(np.int64), g[crowded], n[crowded]),
            (np.where(z < 0, 1, 2), x, y, np.abs(z)),
        ]
    )


def _kinds(parts: list[tuple]) -> pa.Table:
    kind, x, y, z = (np.concatenate(p) for p in zip(*parts))
    whole = (np.asarray(v, np.int64) for v in (x, y, z))
    return pa.table([pa.array(kind.astype(np.int32)), *(pa.array(v) for v in whole)], names=["kind", "x", "y", "z"])


def _opened(column: pa.Array) -> pa.Array:
    return pa.array([zlib.decompress(x) for x in column.to_pylist()], pa.binary()).view(pa.string())


def _verified(batches):
    """Of rows (a, b, text_a, text_b), the pairs whose sets are similar enough; a is cached along its run."""
    last, known = None, None
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            a, text_a, linked = part.column("a").to_pylist(), part.column("text_a"), np.zeros(part.num_rows, bool)
            for first, end, data, offsets in tk.slices(_opened(part.column("text_b"))):
                _, h, counts = shingle_sets(data, offsets)
                ends = np.cumsum(counts)
                for k in range(first, end):
                    if a[k] != last or known is None:
                        last, body = a[k], np.frombuffer(zlib.decompress(text_a[k].as_py()), np.uint8)
                        known = shingle_sets(body, np.array([0, len(body)]))[1]
                    mine = h[ends[k - first] - counts[k - first] : ends[k - first]]
                    if not len(known) or not len(mine):
                        continue
                    at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                    common = int((known[at] == mine).sum())
                    linked[k] = 100 * common >= PERCENT * (len(known) + len(mine) - common)
            yield part.select(["a", "b"]).filter(pa.array(linked))


def _verify(pairs: DataFrame, texts: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that link; written.

    Only pairs that sizes and sketches allow meet their texts, and only texts of such pairs are shuffled.
    """
    one, two = (sketches.withColumnsRenamed({"node": x, "n": n} | {w: f"{x}{w}" for w in _WORDS}) for x, n in (("a", "n"), ("b", "n2")))
    possible = cut(pairs.join(one, "a").join(two, "b").where(_may_link("a", "b")).select("a", "b"), "possible")
    n_possible = possible.count()
    if not n_possible:
        return possible
    ends = possible.select(F.col("a").alias("node")).union(possible.select("b"))
    near, shared = sifted_by(texts, ends, "node", 2 * n_possible)
    b = near.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    a = near.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    met = possible.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
    links = cut(met.mapInArrow(_verified, "a bigint, b bigint"), "links")
    shared.destroy()
    return links


def _joined(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    of_a, of_b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    return pairs.join(of_a, "a", "left").join(of_b, "b", "left").where(apart).select("a", "b")


def _more(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components of what was one component before and of new links."""
    return cut(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links)), "roots")


def parity_sketches(rows: np.ndarray, h: np.ndarray, n_rows: int) -> np.ndarray:
    """SKETCH words of 64 bits by row: every shingle flips one bit.

    Two sets differ in at least as many shingles as their sketches differ in bits.
    """
    out = np.empty((n_rows, SKETCH), np.uint64)
    bit = (tk.mix(h ^ _U(0x9FB21C651E98DF25)) & _U(64 * SKETCH - 1)).astype(np.int64)
    for first in range(0, n_rows, 256):
        a, b = np.searchsorted(rows, [first, first + 256])
        n = min(256, n_rows - first)
        odd = np.bincount((rows[a:b] - first) * (64 * SKETCH) + bit[a:b], minlength=n * 64 * SKETCH).astype(np.uint8) & 1
        out[first : first + n] = np.packbits(odd.reshape(n, -1), axis=1).view(np.uint64)
    return out


_TOLD = ["node", "n", "text", *_WORDS]
_TOLD_SQL = "node bigint, n bigint, text binary, " + ", ".join(f"{w} bigint" for w in _WORDS)


def _told(batches):
    """Of texts: the node, the size of its set, the text in compressed form and the sketch."""
    for batch in batches:
        for first, end, data, offsets in tk.slices(batch.column("text")):
            rows, h, counts = shingle_sets(data, offsets)
            words = parity_sketches(rows, h, end - first).view(np.int64)
            raw = data.tobytes()
            packed = [zlib.compress(raw[a:b], 1) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(_nodes(h, counts)), pa.array(counts, pa.int64()), pa.array(packed, pa.binary()), *(pa.array(c) for c in words.T)], names=_TOLD
            )


def _may_link(left: str, right: str) -> str:
    """Whether two sets may be similar enough by their sizes and sketches."""
    differ = " + ".join(f"bit_count({left}{w} ^ {right}{w})" for w in _WORDS)
    return f"{100 + PERCENT} * ({differ}) <= {100 - PERCENT} * (n + n2)"


def _unsettled(spots: DataFrame, roots: DataFrame) -> DataFrame:
    """(t, node, n, root, shares) of the crowded shingles whose nodes lie in different components.

    A large shingle is later cut into shares of about SHARE nodes, so no task gets it whole.
    """
    placed = spots.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    shares = F.ceil(F.count("*") / SHARE).alias("shares")
    ends = placed.groupBy("t").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), shares).where("r1 <> r2").select("t", "shares")
    return placed.join(ends, "t").select("t", "node", "n", "root", "shares")


def _neighbours(spots: DataFrame, turn: int) -> DataFrame:
    """Pairs of each node with the PARTNERS next ones of its share of the shingle, in an order of this turn."""
    salted = spots.withColumn("share", F.pmod(F.xxhash64("node", F.lit(turn)), "shares"))
    order = Window.partitionBy("t", "share").orderBy(F.xxhash64(F.lit(turn), "node"))
    one = F.struct(F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("root").alias("root2"))
    after = [f"p{k}" for k in range(1, PARTNERS + 1)]
    ahead = salted.withColumns({name: F.lead(one, k).over(order) for k, name in enumerate(after, 1)})
    beside = ahead.select("node", "n", "root", F.explode(F.array(*after)).alias("p")).select("node", "n", "root", "p.*")
    return _ordered(beside.where(APART).select(F.col("node").alias("a"), F.col("node2").alias("b")))


def _texts(rows: DataFrame, measured: DataFrame, wanted: DataFrame) -> DataFrame:
    """Text, size and sketch of each wanted node, by the row that stands for the node.

    Rows are sifted by number and text together, and each says itself what node it is, so texts are not
    shuffled.  A few rows that were not wanted pass the sieve; they are texts of their nodes as well.
    """
    ends = wanted.toDF("node").distinct()
    number = F.xxhash64("_row", "th").alias("at")
    stands = measured.groupBy("node").agg(F.min(F.struct("th", "_row")).alias("s")).select("node", "s.*").join(ends, "node")
    stands = cut(stands.select("node", number), "stands")
    asked = stands.count()
    near, shared = sifted_by(rows.select(F.col("_body").alias("text"), number), stands, "at", asked)
    texts = cut(near.select("text").mapInArrow(_told, _TOLD_SQL), "texts")
    shared.destroy()
    all_met(texts.select("node").join(stands, "node", "left_semi").distinct().count(), asked, "texts of nodes")
    return texts


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def link_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", few: int = FEW) -> DataFrame:
    """One row per document: the key, n_shingles, component_id (least key of its component), _row and th."""
    return _linked(numbered(docs.select(F.col(key).alias("_key"), F.col(text).alias("_body")), "_body"), key, few)


def _linked(rows: DataFrame, key: str, few: int = FEW) -> DataFrame:
    """link_documents from numbered rows (_key, _body, _row, th)."""
    spark = rows.sparkSession
    schema = "_row bigint, n_shingles bigint, node bigint, often bigint, th bigint"
    scanned = cut(rows.select("_row", "_body", "th").mapInArrow(_measured, schema), "measured")
    measured = scanned.where("often is null").drop("often")
    shared = spark.sparkContext.broadcast(_bitmap(scanned.where("often is not null").select(F.col("node").alias("h"), "often")))
    found = cut(
        rows.select("_body").mapInArrow(_postings(shared, 4 * shuffle_partitions(spark), few), _POSTED_SQL)
        .groupBy("bucket").applyInArrow(lambda found: _paired(found, few), "kind int, x bigint, y bigint, z bigint"),
        "candidates",
    )
    shared.destroy()
    nodes = cut(found.where("kind = 2").select(F.col("x").alias("node"), F.col("y").alias("g"), F.col("z").alias("n")).distinct(), "nodes")
    group_pairs = found.where("kind = 0").select(F.col("x").alias("g"), F.col("y").alias("g2")).distinct()
    crowded = cut(found.where("kind = 1").select(F.col("x").alias("t"), F.col("y").alias("g"), F.col("z").alias("n")).distinct(), "crowded")
    # First links: leaders of paired groups, and members with their leader.
    groups = cut(nodes.groupBy("g").agg(F.min("node").alias("leader"), F.count("*").alias("members")), "groups")
    leader_of = groups.select(F.col("g").alias("g2"), F.col("leader").alias("b"))
    first = cut(
        _ordered(
            group_pairs.join(groups.select("g", F.col("leader").alias("a")), "g").join(leader_of, "g2").select("a", "b")
            .union(nodes.join(groups.where("members > 1"), "g").select(F.col("leader").alias("a"), F.col("node").alias("b")))
        ),
        "first",
    )
    spots = cut(crowded.select("t", "g").join(nodes, "g").select("t", "node", "n"), "spots")
    texts = _texts(rows, measured, first.select("a").union(first.select("b")).union(spots.select("node")))
    sketches = cut(texts.drop("text").dropDuplicates(["node"]), "sketches")
    # One pair of each node comes first: most others then lie inside a component.
    either = first.union(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    leading = cut(_ordered(either.groupBy("a").agg(F.min("b").alias("b"))), "leading")
    roots = cut(components(_verify(leading, texts, sketches)), "roots")
    rest = cut(_joined(first.join(leading, ["a", "b"], "left_anti"), roots), "rest")
    roots = _more(roots, _verify(rest, texts, sketches))
    # Crowded shingles: a few partners for each member, until nothing joins; anew where a shingle has several shares.
    tried = first
    open_spots = cut(_unsettled(spots, roots), "open")
    for turn in range(ROUNDS):
        if turn and open_spots.where("shares > 1").isEmpty():
            break
        pairs = cut(_neighbours(open_spots, turn).join(tried, ["a", "b"], "left_anti"), "neighbours")
        more = _verify(pairs, texts, sketches)
        if more.isEmpty():
            break
        roots = _more(roots, more)
        tried = tried.union(pairs)
        open_spots = cut(_unsettled(spots, roots), "open")
    # Whatever could still join different components, without exception.
    placed = cut(nodes.join(roots, "node", "left").select("g", "n", "node", F.coalesce("root", "node").alias("root")), "placed")
    other = placed.toDF("g2", "n2", "node2", "root2")
    mixed = placed.groupBy("g").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("members"))
    inside = placed.join(mixed.where("r1 <> r2").select("g"), "g").join(other, F.col("g") == F.col("g2")).where("node < node2")
    large = mixed.where("members > 1").select("g")
    between = group_pairs.join(large, "g", "left_semi").union(
        group_pairs.join(large.withColumnRenamed("g", "g2"), "g2", "left_semi").select("g", "g2")
    ).distinct().join(placed, "g").join(other, "g2")
    open_spots = open_spots.drop("shares").join(sketches.drop("n"), "node")
    renamed = {"node": "node2", "n": "n2", "root": "root2"} | {w: f"o{w}" for w in _WORDS}
    crossing = open_spots.join(open_spots.withColumnsRenamed(renamed), "t").where(f"node < node2 and {APART} and {_may_link('', 'o')}")
    last = cut(
        _ordered(
            inside.where(APART).select(F.col("node").alias("a"), F.col("node2").alias("b"))
            .union(between.where(APART).select("node", "node2"))
            .union(crossing.select("node", "node2"))
        ).join(tried, ["a", "b"], "left_anti"),
        "last",
    )
    if not last.isEmpty():
        roots = _more(roots, _verify(last, texts, sketches))
    keys = cut(rows.select("_row", "th", "_key"), "keys")
    keyed = cut(keys.join(measured, ["_row", "th"]), "keyed")
    all_met(keyed.count(), measured.count(), "keys of documents")
    ids = (
        keyed.where("n_shingles > 0")
        .groupBy("node").agg(F.min("_key").alias("_least"))
        .join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    )
    ids = cut(ids, "ids")
    named = ids.select("node", "root").join(ids.groupBy("root").agg(F.min("_least").alias("_component")), "root")
    return (
        keyed.join(named.withColumn("_linked", F.lit(True)), "node", "left")
        .select(
            F.col("_key").alias(key),
            "n_shingles",
            F.when((F.col("n_shingles") > 0) & F.col("_linked"), F.col("_component")).otherwise(F.col("_key")).alias("component_id"),
            "_row", "th", "root",
        )
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, but of each component only the one with the least key (the first row on ties)."""
    docs, names = shielded(docs, key, text)
    rows = numbered(docs, text)
    named = rows.select(F.col(key).alias("_key"), F.col(text).alias("_body"), "_row", "th")
    linked = cut(_linked(named, key).where("n_shingles > 0"), "linked")
    first = linked.groupBy("root").agg(F.min(F.struct(F.col(key).isNull(), key, "_row", "th")).alias("f")).select("f._row", "f.th")
    gone = cut(linked.join(first, ["_row", "th"], "left_anti").select("_row", "th"), "gone")
    return without(rows, docs.columns, gone).withColumnsRenamed(names)


def op6_grouped_prefix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return link_documents(docs).select("doc_id", "n_shingles", "component_id")


OP6_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
  from words, unnest(range(1, greatest(len(w) - 3, 2))) as t(i) where len(w) > 0),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from sets a join sets b using (s) where a.doc_id < b.doc_id group by 1, 2),
links as (
  select x, y from common join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
ways as (select x, y from links union all select y, x from links),
reach as (select x as a, x as b from ways union select r.a, w.y from reach r join ways w on r.b = w.x)
select doc_id, coalesce(n, 0)::bigint as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id
from documents left join sizes using (doc_id) left join (select a, min(b) as m from reach group by a) on a = doc_id
"""
