"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow boosted trees are grown on the statistics of labelled texts.  Every path from a root to a node
is a rule: a conjunction of comparisons.  A logistic regression with an absolute penalty gives the rules
weights, most of them zero, and the strength of the penalty is chosen on a part of the sample that the
fit does not see: the strongest within one standard error of the best.  What is left is compiled to one Spark column expression over the statistics.

Learned on the driver from at most about MOST_ROWS labelled rows, chosen by a hash of the key; every
row is scored.  Only the text is an input of a score.

Defined results: null and empty texts have all statistics 0 and are scored by the rules that this meets;
without labelled rows of both kinds there is no rule and every score is the share of good rows among
them, (good + 0.5) / (rows + 1); repeated rows score alike; rows of equal statistics are ordered by label
before the fit, so ties do not depend on partitions.  Input columns with the names of result columns
come back as ``input_<name>``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm import textkit as tk
from veilspan.llm.common import crc_bucket, free_name, label_sample, map_batches, set_aside, table

MOST_ROWS = 8_000
TREES = 60
DEPTH = 3
BINS = 48
SHRINK = 0.3
LEAST_SUPPORT = 0.01
PENALTIES = (0.3, 0.1, 0.03, 0.01, 0.003)  # of the one that leaves no rule
WINDOW = 5
THRESHOLD = 0.3
STATISTICS = (
    "words", "word_length", "long_words", "short_words", "symbols", "symbol_words", "digits", "capitals",
    "capital_words", "punctuation", "shouts", "distinct_words", "top_word", "repeats_in_place",
    "repeated_windows", "repeated_lines", "words_a_line", "words_a_sentence", "closed_lines",
)


def _among(values: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(values, np.uint8))


_SYMBOLS, _PUNCTUATION, _STOPS = _among(b"#*$%&|<>"), _among(b".,;:?!"), _among(b".?!")
_CAPITAL, _DIGIT = _among(bytes(range(65, 91))), _among(bytes(range(48, 58)))


def _copies(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: how often its row holds it, and whether this is the first time."""
    key = tk.mix(h + tk.mix(row.astype(np.uint64) + np.uint64(1)))
    _, first, of, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(h), bool)
    is_first[first] = True
    return n[of], is_first


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One line a row of a slice, one column for each name of STATISTICS; all 0 for rows without a word."""
    n_rows = len(offsets) - 1
    start, end, row = tk.words(data, offsets, tk.NOT_WHITE)
    prefix = tk.Prefix(data)
    h = prefix.ranges(start, end)

    def inside(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[end] - total[start]

    def by_row(values: np.ndarray, of: np.ndarray = row) -> np.ndarray:
        return np.bincount(of, values, n_rows)

    n = by_row(np.ones(len(h)))
    chars = inside((data & 0xC0) != 0x80)
    symbols, points = inside(_SYMBOLS[data]), inside(_PUNCTUATION[data])
    stops = _STOPS[data[end - 1]] if len(end) else np.empty(0, bool)
    n_copies, first = _copies(row, h)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    at, windows = tk.grams(h, row, WINDOW)
    again = at[_copies(row[at], windows)[0] > 1]
    covered = np.zeros(len(h) + WINDOW, bool)
    for k in range(WINDOW):
        covered[again + k] = True
    top = np.zeros(n_rows)
    np.maximum.at(top, row, n_copies)
    # Lines with a word: the words between two line feeds or ends of rows.
    border = np.union1d(np.flatnonzero(data == 0x0A) + 1, offsets)
    line, opens, in_line = np.unique(np.searchsorted(border, start, "right"), return_index=True, return_counts=True)
    closes = opens + in_line - 1
    line_row = row[opens]
    line_first = _copies(line_row, prefix.ranges(start[opens], end[closes]))[1] if len(line) else np.empty(0, bool)
    n_lines = by_row(np.ones(len(line)), line_row)
    words, letters, lines = np.maximum(n, 1), np.maximum(by_row(chars), 1), np.maximum(n_lines, 1)
    return np.stack(
        [
            np.log1p(n), by_row(chars) / words, by_row(chars > 14) / words, by_row(chars < 3) / words,
            by_row(symbols) / letters, by_row(symbols > 0) / words, by_row(inside(_DIGIT[data])) / letters,
            by_row(inside(_CAPITAL[data])) / letters, by_row(inside(_CAPITAL[data]) * 2 > chars) / words,
            by_row(points) / words, by_row(inside(data == 0x21)) / words, by_row(first) / words, top / words,
            by_row(same) / words, by_row(covered[: len(h)]) / words, by_row(~line_first, line_row) / lines,
            np.log1p(n / lines), np.log1p(n / (1 + by_row(stops))), by_row(stops[closes], line_row) / lines,
        ],
        1,
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction: lows holds (statistic, bound) of ``statistic > bound``, highs of ``statistic <= bound``."""

    lows: tuple[tuple[int, float], ...] = ()
    highs: tuple[tuple[int, float], ...] = ()

    def narrowed(self, statistic: int, bound: float, low: bool) -> Rule:
        lows, highs = dict(self.lows), dict(self.highs)
        if low:
            lows[statistic] = max(bound, lows.get(statistic, bound))
        else:
            highs[statistic] = min(bound, highs.get(statistic, bound))
        return Rule(tuple(sorted(lows.items())), tuple(sorted(highs.items())))

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, bound in self.lows:
            out &= x[:, k] > bound
        for k, bound in self.highs:
            out &= x[:, k] <= bound
        return out

    def column(self, of) -> Column:
        """The same test as a Spark expression; ``of`` gives the column of a statistic's name."""
        tests = [of(STATISTICS[k]) > bound for k, bound in self.lows] + [of(STATISTICS[k]) <= bound for k, bound in self.highs]
        return reduce(Column.__and__, tests)

    def __str__(self) -> str:
        return " and ".join([f"{STATISTICS[k]} > {b:.4g}" for k, b in self.lows] + [f"{STATISTICS[k]} <= {b:.4g}" for k, b in self.highs])


@dataclass
class RuleModel:
    bias: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule, w in zip(self.rules, self.weights):
            total += w * rule.holds(x)
        return 1 / (1 + np.exp(-total))

    def column(self, of) -> Column:
        """The score as one Spark expression."""
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights):
            total = total + F.when(rule.column(of), w).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _edges(x: np.ndarray) -> list[np.ndarray]:
    """Candidate bounds of each statistic: midpoints between neighbouring quantiles of the sample."""
    out = []
    for column in x.T:
        q = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1), method="nearest"))
        out.append((q[1:] + q[:-1]) / 2)
    return out


def grow(x: np.ndarray, y: np.ndarray, seed: int = 13) -> list[Rule]:
    """The paths of boosted trees, each on half of the rows and half of the statistics, without repeats."""
    rng = np.random.default_rng(seed)
    edges = _edges(x)
    codes = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)  # code <= k just where c <= e[k]
    total = np.full(len(y), np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    found: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        rest, weight = y - p, np.maximum(p * (1 - p), 1e-6)
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        among = np.flatnonzero(rng.random(x.shape[1]) < 0.5)
        level = [(Rule(), rows, np.arange(len(y)))]
        for depth in range(DEPTH + 1):
            below = []
            for rule, here, reach in level:
                best = _split(codes, rest, weight, here, among, edges) if depth < DEPTH else None
                if best is None:
                    w = weight[here].sum()
                    total[reach] += SHRINK * rest[here].sum() / (w + 1)
                    continue
                k, cut = best
                for low in (False, True):
                    part = rule.narrowed(int(k), float(edges[k][cut]), low)
                    found[part] = None
                    below.append((part, here[(codes[here, k] > cut) == low], reach[(codes[reach, k] > cut) == low]))
            level = below
    return list(found)


def _split(codes, rest, weight, here, among, edges) -> tuple[int, int] | None:
    """The statistic and bound of the largest gain; none where a side would hold too few rows."""
    best, least = (1e-4, None), max(1, int(LEAST_SUPPORT * len(rest) / 2))
    if len(here) < 2 * least:
        return None
    for k in among:
        if not len(edges[k]):
            continue
        n = np.cumsum(np.bincount(codes[here, k], minlength=len(edges[k]) + 1))
        g = np.cumsum(np.bincount(codes[here, k], rest[here], len(edges[k]) + 1))
        h = np.cumsum(np.bincount(codes[here, k], weight[here], len(edges[k]) + 1))
        gain = g**2 / (h + 1) + (g[-1] - g) ** 2 / (h[-1] - h + 1) - g[-1] ** 2 / (h[-1] + 1)
        gain[(n < least) | (n[-1] - n < least)] = 0
        cut = int(gain.argmax())
        if gain[cut] > best[0]:
            best = (gain[cut], (k, cut))
    return best[1]


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None, rounds: int = 250) -> np.ndarray:
    """Weights and, last, the free bias of a logistic regression with an absolute penalty, by accelerated steps.

    Columns of z are 0 or 1 and are divided by their deviation inside, so that rare rules are not favoured less.
    """
    mean, scale = z.mean(0), np.maximum(z.std(0), 1e-3)
    a = np.concatenate([(z - mean) / scale, np.ones((len(z), 1))], 1).astype(np.float32)
    power = np.ones(a.shape[1], np.float32)
    for _ in range(12):  # largest curvature
        power = a.T @ (a @ power)
        power /= np.linalg.norm(power)
    step = 4 * len(a) / max(float(power @ (a.T @ (a @ power))), 1e-9) / 1.05
    w = np.zeros(a.shape[1]) if start is None else start.copy()
    ahead, t = w, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ ahead.astype(np.float32), -40, 40)))
        new = ahead - step * (a.T @ (p - y)) / len(a)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (before - 1) / t * (new - w), new
    return w


def unscaled(w: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Weights for the 0 and 1 of z from those of lasso."""
    out = w.copy()
    out[:-1] = w[:-1] / np.maximum(z.std(0), 1e-3)
    out[-1] = w[-1] - (out[:-1] * z.mean(0)).sum()
    return out


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Rules and weights from statistics and labels of 0 and 1."""
    good = float(y.sum())
    if good in (0, len(y)):
        share = (good + 0.5) / (len(y) + 1)
        return RuleModel(float(np.log(share / (1 - share))))
    rules = grow(x, y)
    z = np.array([r.holds(x) for r in rules], bool).reshape(len(rules), len(x)).T
    _, new = np.unique(np.packbits(z, axis=0), axis=1, return_index=True)  # rules that hold for the same rows count once
    new = np.sort(new)
    new = new[(z[:, new].mean(0) >= LEAST_SUPPORT) & (z[:, new].mean(0) <= 1 - LEAST_SUPPORT)]
    rules, z = [rules[k] for k in new], z[:, new].astype(np.float32)
    if not rules:
        return RuleModel(float(np.log(good / (len(y) - good))))
    test = np.arange(len(y)) % 4 == 3
    zt, yt = z[~test], y[~test]
    strongest = np.abs(((zt - zt.mean(0)) / np.maximum(zt.std(0), 1e-3)).T @ (yt - yt.mean())).max() / len(yt)
    losses, start = [], None
    for share in PENALTIES:
        start = lasso(zt, yt, share * strongest, start)
        w = unscaled(start, zt)
        margin = np.clip(z[test] @ w[:-1] + w[-1], -40, 40)
        losses.append(np.log1p(np.exp(-np.where(y[test] == 1, margin, -margin))))
    # The strongest penalty that is within one standard error of the best.
    means, best = [v.mean() for v in losses], min(losses, key=np.mean)
    enough = best.mean() + best.std() / np.sqrt(max(len(best), 1))
    w = unscaled(lasso(z, y, PENALTIES[int(np.argmax(np.array(means) <= enough))] * strongest), z)
    kept = np.flatnonzero(np.abs(w[:-1]) > 1e-6)
    return RuleModel(float(w[-1]), [rules[k] for k in kept], [float(w[k]) for k in kept])


def described(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Every row with a struct of its statistics under a free name, in place of its text."""
    others = [c for c in docs.columns if c != text]
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*(F.col(f"`{c}`") for c in others)).schema)
    kind = pa.struct([(s, pa.float64()) for s in STATISTICS])

    def run(batch):
        for first, end, data, offsets in tk.slices(batch.column(text)):
            x = statistics(data, offsets)
            part = batch.slice(first, end - first)
            told = pa.StructArray.from_arrays([pa.array(c) for c in x.T], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), told], names=[*others, name])

    fields = ", ".join(f"{s}: double" for s in STATISTICS)
    return map_batches(docs.select(*(F.col(f"`{c}`") for c in [*others, text])), run, f"{kept}`{name}` struct<{fields}>")


def train(rows: DataFrame) -> RuleModel:
    """From labelled (key, text, quality) rows; read at most about MOST_ROWS of them, 2 * MOST_ROWS at the very most."""
    known = rows.where("quality is not null").select("key", "text", "quality")
    n = known.count()
    if not n:
        return RuleModel(0.0)
    drawn = F.coalesce(F.xxhash64("key") / F.lit(2.0**64), F.lit(0.0)) + 0.5
    sample = known.where(drawn < MOST_ROWS / n).select("quality", "text")
    got = described(sample, "text", "told").select("quality", "told.*").limit(2 * MOST_ROWS).toArrow()
    table_ = np.stack([np.asarray(got.column(c).to_numpy(), float) for c in ("quality", *STATISTICS)], 1)
    table_ = table_[np.lexsort(table_.T)]
    # Neighbours in that order are alike; a fixed shuffle spreads them over the parts of the fit.
    table_ = table_[np.random.default_rng(1).permutation(len(table_))]
    return fit(table_[:, 1:], (table_[:, 0] == 1).astype(float))


def score(docs: DataFrame, model: RuleModel, text: str = "text") -> DataFrame:
    """Every row with quality_score (0 to 1) in place of its text."""
    docs = set_aside(docs, ["quality_score"], text)
    name = free_name(docs, "statistics")
    out = described(docs, text, name)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c != text), model.column(lambda s: F.col(f"`{name}`.{s}")).alias("quality_score"))


def trained_on(spark, sf_dir: str, docs: DataFrame) -> RuleModel:
    """From the labels of rows that are not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("bigint").alias("quality"))
    learn = label_sample(labels.where(crc_bucket(F.col("doc_id"), 5) != 0), "doc_id", "quality", MOST_ROWS, balanced=False)
    return train(docs.select("doc_id", "text").join(F.broadcast(learn), "doc_id").select(F.col("doc_id").alias("key"), "text", "quality"))


def op13_rule_ensemble(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = docs.withColumn("held_out", crc_bucket(F.col("doc_id"), 5) == 0)
    return score(held, trained_on(spark, sf_dir, docs)).select(
        "doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted")
    )
