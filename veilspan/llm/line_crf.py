"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Lines are described by a few numbers, scores of the two labels and of their transitions are learned
by gradient ascent on labelled documents, and Viterbi decoding marks the lines of every text.  A
document is kept when at least LEAST_CONTENT of its characters (of words) are in content lines and
the plain rules do not reject it.

Training reads about MOST_DOCUMENTS labelled documents, chosen by a hash of the key, of at most
MOST_LINES lines each; lines take the label of their document, apart from repeats of earlier lines
and licence lines, which are boilerplate anywhere.

Defined results: null and empty texts have no words and fail the plain rules; lines without a word
are left out of the sequence; without labelled documents of both kinds the plain rules alone
decide; repeated rows are judged alike; input columns named like results come back as ``input_<name>``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import textkit as tk
from veilspan.llm.common import label_sample, map_batches, set_aside, table
from veilspan.llm.scratch import cut

MOST_DOCUMENTS = 6000
MOST_LINES = 400
LEAST_CONTENT = 0.5
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent
FEATURES = (
    "bias", "symbols", "digits", "capitals", "repeat_of_line", "repeated_words", "same_as_before",
    "short", "length", "word_length", "ends_sentence", "notice", "words_with_symbols",
)
NOTICES = ("license", "licensed", "licence", "copyright", "reserved", "cookie", "cookies", "privacy", "subscribe", "newsletter", "http", "https", "www")
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _seen_before(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an equal value stands earlier in the row, or anywhere else in the row) for each value."""
    order = np.lexsort((np.arange(len(h)), h, row))
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        a, b = order[:-1], order[1:]
        same[1:] = (h[a] == h[b]) & (row[a] == row[b])
    earlier, anywhere = np.zeros(len(h), bool), np.zeros(len(h), bool)
    earlier[order] = same
    anywhere[order] = same | np.concatenate([same[1:], [False]]) if len(h) else same
    return earlier, anywhere


@dataclass
class Measures:
    """Of a slice: counts by row, and lines with a word: their row, features and characters."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_row: np.ndarray
    x: np.ndarray
    chars: np.ndarray


_NOTICE_HASHES = None


def _notices() -> np.ndarray:
    global _NOTICE_HASHES
    if _NOTICE_HASHES is None:
        data = np.frombuffer(" ".join(NOTICES).encode(), np.uint8)
        starts, ends, _ = tk.words(data, np.array([0, len(data)]), _ALPHA)
        _NOTICE_HASHES = np.sort(tk.Prefix(data).ranges(starts, ends))
    return _NOTICE_HASHES


def measure(data: np.ndarray, offsets: np.ndarray) -> Measures:
    n_rows = len(offsets) - 1
    starts, ends, row = tk.words(data, offsets, tk.NOT_WHITE)
    prefix = tk.Prefix(data)
    h = prefix.ranges(starts, ends)
    code_points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = code_points[ends] - code_points[starts]
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    # Words in 5-word windows that the row has twice or more.
    at, g = tk.grams(h, row, WINDOW)
    _, twice = _seen_before(row[at], g)
    covered = np.zeros(len(h) + WINDOW, np.int64)
    for k in range(WINDOW):
        covered[at[twice] + k] = 1
    repeated = covered[: len(h)].astype(bool)
    # Lines: runs of bytes between line feeds, with a word.
    line_start = np.zeros(len(data) + 1, bool)
    line_start[offsets[:-1][np.diff(offsets) > 0]] = True
    feeds = np.flatnonzero(data == 0x0A)
    line_start[feeds + 1] = True
    begin = np.flatnonzero(line_start[: len(data)])
    line_of = np.searchsorted(begin, starts, "right") - 1
    ids, first, n = np.unique(line_of, return_index=True, return_counts=True)
    stop = np.append(begin[1:], len(data))
    line_row = row[first] if len(first) else np.empty(0, np.int64)
    a = begin[ids] if len(ids) else np.empty(0, np.int64)
    b = stop[ids] if len(ids) else np.empty(0, np.int64)
    if len(a):
        b = np.minimum(b, offsets[line_row + 1])
        b = b - (data[b - 1] == 0x0A)
    earlier, _ = _seen_before(line_row, prefix.ranges(a, b))
    last = first + n - 1 if len(first) else first

    def by_line(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[last + 1] - total[first] if len(first) else np.empty(0)

    line_chars = by_line(chars)
    word_symbols = symbols[ends] - symbols[starts]
    digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    size = np.maximum(b - a, 1)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    low = tk.LOWER[data]
    w_start, w_end, _ = tk.words(low, offsets, _ALPHA)
    known = _notices()
    wh = tk.Prefix(low).ranges(w_start, w_end)
    hit = known[np.minimum(np.searchsorted(known, wh), len(known) - 1)] == wh
    notice = np.zeros(len(ids))
    notice[np.unique(np.searchsorted(ids, np.searchsorted(begin, w_start[hit], "right") - 1))] = 1
    mean = line_chars / np.maximum(n, 1)
    ends_sentence = np.isin(data[ends[last] - 1], np.frombuffer(b".!?:;", np.uint8)) if len(last) else np.empty(0)
    x = np.stack(
        [
            np.ones(len(ids)), (symbols[b] - symbols[a]) / size * 5, (digit[b] - digit[a]) / size * 5, (upper[b] - upper[a]) / size * 2,
            earlier, by_line(repeated) / np.maximum(n, 1), by_line(same) / np.maximum(n, 1), n < 4, np.minimum(np.log1p(n), 6) / 3,
            np.minimum(np.abs(mean - 5.5), 20) / 5, ends_sentence, notice, by_line(word_symbols > 0) / np.maximum(n, 1),
        ],
        1,
    )
    total = np.concatenate([[0], np.cumsum(chars)])
    first_word = np.concatenate([[0], np.cumsum(tk.per_row(row, n_rows))])
    return Measures(
        tk.per_row(row, n_rows), total[first_word[1:]] - total[first_word[:-1]], symbols[offsets[1:]] - symbols[offsets[:-1]],
        tk.per_row(line_row[earlier], n_rows), tk.per_row(row[repeated], n_rows), line_row, x, line_chars,
    )


@dataclass
class Crf:
    weights: np.ndarray  # label, feature; label 1 is content
    steps: np.ndarray  # from label, to label


def _in_step(length: np.ndarray):
    """Order of the sequences, longest first, and for each position the number that reach it."""
    order = np.argsort(-length, kind="stable")
    reach = len(length) - np.searchsorted(np.sort(length), np.arange(1, int(length.max(initial=0)) + 1), "left")
    return order, reach


def viterbi(scores: np.ndarray, start: np.ndarray, length: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Best label of every line; sequence k is scores[start[k]:start[k] + length[k]]."""
    labels = np.zeros(len(scores), np.int64)
    if not len(scores):
        return labels
    order, reach = _in_step(length)
    at = start[order]
    best = scores[at[: reach[0]]]
    back = np.zeros((len(scores), 2), np.int8)
    final = np.zeros((len(order), 2))
    final[: reach[0]] = best
    for t in range(1, len(reach)):
        k = reach[t]
        ways = best[:k, :, None] + steps
        here = at[:k] + t
        back[here] = ways.argmax(1)
        best = ways.max(1) + scores[here]
        final[:k] = best
    now = final.argmax(1)
    for t in range(len(reach) - 1, -1, -1):
        k = reach[t]
        here = at[:k] + t
        labels[here] = now[:k]
        now[:k] = back[here, now[:k]]
    return labels


def fit(x: np.ndarray, y: np.ndarray, start: np.ndarray, length: np.ndarray, rounds: int = 120, penalty: float = 1e-3) -> Crf:
    """Gradient ascent on the conditional likelihood by forward and backward sums."""
    order, reach = _in_step(length)
    at, n = start[order], len(x)
    theta = np.zeros(2 * x.shape[1] + 4)
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    one_hot = np.stack([1 - y, y], 1).astype(float)
    inner = np.ones(n, bool)
    inner[start] = False
    pairs = np.bincount(2 * y[np.flatnonzero(inner) - 1] + y[inner], minlength=4).reshape(2, 2)
    for t in range(1, rounds + 1):
        w, steps = theta[:-4].reshape(2, -1), theta[-4:].reshape(2, 2)
        scores = x @ w.T
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        alpha[at] = scores[at]
        for p in range(1, len(reach)):
            here = at[: reach[p]] + p
            alpha[here] = np.logaddexp.reduce(alpha[here - 1][:, :, None] + steps, 1) + scores[here]
        for p in range(len(reach) - 1, 0, -1):
            here = at[: reach[p]] + p
            beta[here - 1] = np.logaddexp.reduce(steps + (scores[here] + beta[here])[:, None, :], 2)
        z = np.logaddexp.reduce(alpha + beta, 1)
        chance = np.exp(alpha + beta - z[:, None])
        after = np.flatnonzero(inner)
        joint = np.exp(alpha[after - 1][:, :, None] + steps + (scores[after] + beta[after])[:, None, :] - z[after][:, None, None])
        g = np.concatenate([((one_hot - chance).T @ x).ravel(), (pairs - joint.sum(0)).ravel()]) / n - penalty * theta
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return Crf(theta[:-4].reshape(2, -1), theta[-4:].reshape(2, 2))


def _sequences(line_row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    length = tk.per_row(line_row, n_rows)
    return np.cumsum(length) - length, length


def train(labelled: DataFrame) -> Crf | None:
    """From (key, text, quality) rows."""
    known = labelled.where("quality is not null and text is not null")
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}  # two rows
    if not counts.get(0) or not counts.get(1):
        return None
    drawn = (F.xxhash64("key") / F.lit(2.0**64)) + 0.5
    share = F.when(F.col("quality") == 1, F.lit(MOST_DOCUMENTS / 2 / counts[1])).otherwise(F.lit(MOST_DOCUMENTS / 2 / counts[0]))
    sample = cut(known.where(drawn < share).select("text", "quality"), "labelled")

    def described(batch):
        for first, end, data, offsets in tk.slices(batch.column("text")):
            m = measure(data, offsets)
            start, length = _sequences(m.line_row, end - first)
            good = np.asarray(batch.column("quality").slice(first, end - first).to_pylist())
            y = (good[m.line_row] == 1) & (m.x[:, 4] == 0) & (m.x[:, 11] == 0) if len(m.x) else np.empty(0, bool)
            for a, n in zip(start.tolist(), length.tolist()):
                if 0 < n <= MOST_LINES:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([m.x[a : a + n].astype(np.float32).tobytes()], pa.binary()), pa.array([y[a : a + n].astype(np.int8).tobytes()], pa.binary())],
                        names=["x", "y"],
                    )

    got = map_batches(sample, described, "x binary, y binary").toArrow()  # about MOST_DOCUMENTS rows
    if not got.num_rows:
        return None
    ys = [np.frombuffer(v, np.int8) for v in got.column("y").to_pylist()]
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, len(FEATURES)).astype(float)
    length = np.array([len(v) for v in ys])
    return fit(x, np.concatenate(ys).astype(np.int64), np.cumsum(length) - length, length)


def judge(docs: DataFrame, model: Crf | None, text: str = "text") -> DataFrame:
    """Add the plain measures, base_failed, content_share, n_boilerplate_lines and kept to every row; the text is left out."""
    docs = set_aside(docs, MEASURES, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some dozen numbers
    others = [c for c in docs.columns if c != text]
    kept_columns = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*others).schema)

    def run(batch):
        model = shared.value
        for first, end, data, offsets in tk.slices(batch.column(text)):
            m, n_rows = measure(data, offsets), end - first
            failed = (m.n_words < LEAST_WORDS) | (100 * m.n_repeat_words > MOST_REPEATED * m.n_words)
            if model is None:
                labels = np.ones(len(m.x), np.int64)
            else:
                labels = viterbi(m.x @ model.weights.T, *_sequences(m.line_row, n_rows), model.steps)
            content = np.bincount(m.line_row, m.chars * labels, n_rows) / np.maximum(m.word_chars, 1)
            kept = ~failed & (content >= LEAST_CONTENT)
            part = batch.slice(first, n_rows)
            counts = [m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in others), *(pa.array(c, pa.int64()) for c in counts), pa.array(failed), pa.array(kept),
                 pa.array(content), pa.array(tk.per_row(m.line_row[labels == 0], n_rows), pa.int64())],
                names=[*others, *MEASURES],
            )

    return map_batches(docs.select(*others, text), run, kept_columns + _MEASURES_SQL)


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "n_boilerplate_lines"]
_MEASURES_SQL = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, content_share double, n_boilerplate_lines bigint"
)


def op3_line_crf(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = label_sample(table(spark, sf_dir, "labels"), "doc_id", "quality", MOST_DOCUMENTS, balanced=True)
    return judge(docs, train(docs.join(F.broadcast(labels), "doc_id").select(F.col("doc_id").alias("key"), "text", "quality")))
