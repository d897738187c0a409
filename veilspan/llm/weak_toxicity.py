"""Toxicity by weak supervision.

Voters: lexicons of words and word beginnings that labelled toxic documents use (several disjoint
ones), a seed lexicon and patterns of style.  Each votes toxic, clean or abstains.  A generative label model, fitted by
expectation maximisation over the distinct vote patterns, estimates how each voter votes on either
class; voters that agree beyond what the class explains share their weight.  A linear classifier
is trained on the model's posterior labels and scores every whole text.

Learned from at most about MOST_ROWS labelled rows, chosen by a hash of the key.  Labels,
language, source and key are never inputs of a score.

Defined results: null and empty texts have no features and get the classifier's base score; without
any labelled row of both classes every score is 0; repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import textkit as tk
from veilspan.llm.common import crc_bucket, label_sample, table
from veilspan.llm.scratch import cut

MOST_ROWS = 20_000
LEXICON_TERMS = 400
LEXICONS = 6
LEAST_DOCUMENTS = 4
LEAST_SHARE = 0.005
LEAST_ODDS = 3.5  # natural logarithm
BEGINNINGS = (4, 5, 6, 7, 8)  # bytes
THRESHOLD = 0.3
ABSTAIN, CLEAN, TOXIC = 0, 1, 2
SEED_WORDS = (
    "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile dumb "
    "idiota estúpido imbécil basura asqueroso dummkopf trottel abschaum widerlich "
    "crétin débile ordure minable dégoûtant"
).split()
_WORD = np.zeros(256, bool)
_WORD[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
STYLE = ("shouting", "exclamations", "questions", "symbols", "digits", "long_words")


def word_hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = tk.words(data, np.array([0, len(data)]), _WORD)
    return tk.Prefix(data).ranges(starts, ends)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of all words, and of the beginnings of longer ones; and words by row."""
    starts, ends, row = tk.words(data, offsets, _WORD)
    prefix = tk.Prefix(data)
    rows, hashes = [row], [prefix.ranges(starts, ends)]
    for n in BEGINNINGS:
        longer = ends - starts > n
        rows.append(row[longer])
        hashes.append(tk.mix(prefix.ranges(starts[longer], starts[longer] + n) + np.uint64(1)))
    return np.concatenate(rows), np.concatenate(hashes), tk.per_row(row, len(offsets) - 1)


def _style(raw: np.ndarray, offsets: np.ndarray, starts, ends, row) -> np.ndarray:
    """Shares of bytes or words, one column for each name of STYLE."""
    n_rows = len(offsets) - 1
    of = np.repeat(np.arange(n_rows), np.diff(offsets))
    share = lambda flag: tk.per_row(of[flag], n_rows) / np.maximum(np.diff(offsets), 1)
    symbols = np.isin(raw, np.frombuffer(b"#*$%&|<>", np.uint8))
    long = tk.per_row(row[ends - starts > 14], n_rows) / np.maximum(tk.per_row(row, n_rows), 1)
    return np.stack(
        [share((raw >= 65) & (raw <= 90)), share(raw == 0x21), share(raw == 0x3F), share(symbols), share((raw >= 48) & (raw <= 57)), long], 1
    )


def features(column: pa.Array, lexicon: np.ndarray):
    """Per slice: (first row, end row, counts of lexicon words by row as (row, word), style, words by row)."""
    column = column.fill_null("")
    for first, end, raw, offsets in tk.slices(column):
        low_column = pc.utf8_lower(column.slice(first, end - first))
        for a, b, data, low_offsets in tk.slices(low_column, 1 << 62):
            row, h, n_words = terms(data, low_offsets)
            at = np.minimum(np.searchsorted(lexicon, h), max(len(lexicon) - 1, 0))
            hit = lexicon[at] == h if len(lexicon) else np.zeros(len(h), bool)
            raw_starts, raw_ends, raw_row = tk.words(tk.LOWER[raw], offsets, _WORD)
            yield first, end, row[hit], at[hit], _style(raw, offsets, raw_starts, raw_ends, raw_row), n_words


def _matrix(rows, at, style, n_rows: int, width: int) -> np.ndarray:
    x = np.zeros((n_rows, width + style.shape[1]), np.float32)
    np.add.at(x, (rows, at), 1)
    x[:, :width] = np.log1p(x[:, :width])
    x[:, width:] = style
    return x


def votes(x: np.ndarray, parts: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One column a voter: each part of the lexicon, all of it (twice a word or none), and each style."""
    words = x[:, : parts.shape[1]] > 0
    out = [np.where(words[:, p].any(1), TOXIC, ABSTAIN) for p in parts.astype(bool)]
    n = words.sum(1)
    out.append(np.where(n >= 2, TOXIC, np.where(n == 0, CLEAN, ABSTAIN)))
    style = x[:, parts.shape[1] :]
    out += [np.where(style[:, k] > cuts[1, k], TOXIC, np.where(style[:, k] <= cuts[0, k], CLEAN, ABSTAIN)) for k in range(style.shape[1])]
    return np.stack(out, 1).astype(np.int8)


def label_model(v: np.ndarray, prior: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior of toxic for each row of votes; prior holds a first guess by row.

    Class-conditional vote tables by expectation maximisation.  A voter's evidence is divided by
    one plus its summed squared residual correlations with the others.
    """
    patterns, of, n = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    of = of.reshape(-1)
    q = np.bincount(of, prior) / n
    for _ in range(rounds):
        weight = np.stack([n * (1 - q), n * q])
        share = np.clip(weight.sum(1) / n.sum(), 1e-4, 1)
        chance = np.stack(
            [((weight[:, :, None] * (patterns == k)).sum(1) + 0.5) / (weight.sum(1)[:, None] + 1.5) for k in (ABSTAIN, CLEAN, TOXIC)], 2
        )
        toxic = (patterns == TOXIC).astype(float)
        rest = toxic - (np.stack([1 - q, q], 1) @ chance[:, :, TOXIC])
        cov = (rest * n[:, None]).T @ rest / n.sum()
        dev = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        ties = (cov / dev / dev[:, None]) ** 2
        np.fill_diagonal(ties, 0)
        temper = 1 / (1 + np.where(ties > 0.05, ties, 0).sum(1))
        evidence = np.log(chance)[:, np.arange(v.shape[1])[None, :], patterns]  # class, pattern, voter
        score = np.log(share)[:, None] + (evidence * temper).sum(2)
        q = 1 / (1 + np.exp(np.clip(score[0] - score[1], -40, 40)))
    return q[of]


def fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 300, penalty: float = 2e-4) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression on soft labels."""
    # The matrix is kept once, as it came: weights are scaled instead of its columns.
    mean = x.mean(0, dtype=np.float64)
    square = np.einsum("ij,ij->j", x, x, dtype=np.float64) / max(len(x), 1)
    scale = np.append(np.maximum(np.sqrt(np.maximum(square - mean**2, 0)), 0.05), 1.0)
    w, m, s = np.zeros(len(scale)), np.zeros(len(scale)), np.zeros(len(scale))
    for t in range(1, rounds + 1):
        margin = x @ (w / scale)[:-1].astype(np.float32) + w[-1]
        rest = 1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -40, 40))) - y
        g = np.append(rest.astype(np.float32) @ x, rest.sum()) / scale / len(y) + penalty * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w / scale


@dataclass
class ToxicityModel:
    lexicon: np.ndarray  # sorted hashes
    weights: np.ndarray | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -40, 40)))


def _distinct_words(batches):
    for batch in batches:
        texts = pc.utf8_lower(batch.column("text").fill_null(""))
        toxic = np.asarray(batch.column("toxic").to_pylist(), np.int64)
        for first, end, data, offsets in tk.slices(texts):
            row, h, _ = terms(data, offsets)
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.empty(0, bool)
            row, h = row[new], h[new]
            words, n = np.unique(h, return_counts=True)
            seen, k = np.unique(h[toxic[first:end][row] == 1], return_counts=True)
            in_toxic = np.zeros(len(words), np.int64)
            in_toxic[np.searchsorted(words, seen)] = k
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.view(np.int64)), pa.array(n, pa.int64()), pa.array(in_toxic)], names=["h", "n", "n_toxic"]
            )


def train(rows: DataFrame) -> ToxicityModel:
    """From labelled (key, text, toxic) rows."""
    labelled = rows.where("toxic is not null")
    counts = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}  # two rows
    if not counts.get(0) or not counts.get(1):
        return ToxicityModel(np.empty(0, np.uint64), None)
    share = min(1.0, MOST_ROWS / sum(counts.values()))
    sample = cut(labelled.where((F.xxhash64("key") / F.lit(2.0**64)) + 0.5 < share).select("text", "toxic"), "labelled")
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = max(totals.get(1, 0), 1), max(totals.get(0, 0), 1)
    odds = F.log((F.col("k") + 0.5) / n_toxic) - F.log((F.col("n") - F.col("k") + 0.5) / n_clean)
    words = (
        sample.mapInArrow(_distinct_words, "h bigint, n bigint, n_toxic bigint")
        .groupBy("h").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("k"))
        .where((F.col("k") >= LEAST_DOCUMENTS) & (F.col("k") >= LEAST_SHARE * n_toxic)).withColumn("odds", odds)
        .where(F.col("odds") > LEAST_ODDS).orderBy(F.desc(F.col("odds") * F.sqrt("k")), "h").limit(LEXICON_TERMS).collect()
    )
    found = np.array([r["h"] for r in words], np.int64).view(np.uint64)
    seeds = word_hashes(SEED_WORDS)
    lexicon = np.unique(np.concatenate([found, seeds]))

    def featured(batches):
        for batch in batches:
            for first, end, row, at, style, _ in features(batch.column("text"), lexicon):
                x = _matrix(row, at, style, end - first, len(lexicon))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.tobytes() for r in x], pa.binary()), batch.column("toxic").slice(first, end - first)], names=["x", "toxic"]
                )

    got = sample.mapInArrow(featured, "x binary, toxic bigint").toArrow()  # at most about MOST_ROWS rows
    x = np.empty((got.num_rows, len(lexicon) + len(STYLE)), np.float32)
    at = 0
    for part in got.column("x").chunks:  # rows of equal length, end to end
        x[at : at + len(part)] = np.frombuffer(part.buffers()[2], np.float32, len(part) * x.shape[1], 4 * part.offset * x.shape[1]).reshape(len(part), -1)
        at += len(part)
    y = got.column("toxic").to_numpy().astype(float)
    del got
    parts = np.zeros((LEXICONS + 1, len(lexicon)))
    for k, h in enumerate(found.tolist()):
        parts[k % LEXICONS, np.searchsorted(lexicon, np.uint64(h))] = 1
    parts[LEXICONS, np.searchsorted(lexicon, seeds)] = 1
    style = x[:, len(lexicon) :]
    cuts = np.quantile(style, [0.3, 0.97], axis=0)
    posterior = label_model(votes(x, parts, cuts), np.where(y == 1, 0.9, 0.1))
    return ToxicityModel(lexicon, fit_linear(x, posterior))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Add toxicity (0 to 1) to every row, in place of a column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred weights
    docs = docs.drop("toxicity")
    names, kept = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches):
        model = shared.value
        for batch in batches:
            for first, end, row, at, style, _ in features(batch.column(text), model.lexicon):
                x = _matrix(row, at, style, end - first, len(model.lexicon))
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(x))], names=[*names, "toxicity"])

    return docs.mapInArrow(run, f"{kept}, toxicity double")


def trained_on(spark, sf_dir: str, docs: DataFrame) -> ToxicityModel:
    """From the labels of rows that are not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("bigint").alias("toxic"))
    learn = label_sample(labels.where(crc_bucket(F.col("doc_id"), 4) != 2), "doc_id", "toxic", MOST_ROWS, balanced=False)
    return train(docs.select("doc_id", "text").join(F.broadcast(learn), "doc_id").select(F.col("doc_id").alias("key"), "text", "toxic"))


def op5_weak_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = docs.withColumn("held_out", crc_bucket(F.col("doc_id"), 4) == 2)
    return score(held, trained_on(spark, sf_dir, docs)).select(
        "doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted")
    )
