"""Secret scans: broad patterns find candidates, a random forest removes the false ones.

Candidates are runs of LEAST_LENGTH or more characters of keys and tokens that hold a digit, mix cases or stand
after a credential word.  A candidate is described by its length, its character transitions, its
coverage by a dictionary of the corpus's own words, its path and the words beside it; the forest is
trained on labelled findings and gives each candidate the probability that it is a secret.

Where no findings were labelled by hand, label_findings() labels a bounded sample: shapes of well-known
issuers and values assigned to a credential word count as secrets, everything else does not.  The
forest never sees these shapes themselves, only the features named above.

Defined results: null and empty texts have no candidates; a null path is the path ""; repeated rows
give repeated findings; without labelled findings of both kinds every candidate stays, at 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Container
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import BITMAP_BITS, bitmap, map_batches, table
from veilspan.llm.scratch import cut

LEAST_LENGTH = 8
MOST_FINDINGS = 20_000
LEAST_DOCUMENTS, LEAST_SHARE = 3, 1 / 20_000  # documents that hold a word of the dictionary
TREES, DEPTH, LEAF = 40, 8, 3
THRESHOLD = 0.5
BESIDE = 40  # characters of context on either side
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{%d,}={0,2}(?![A-Za-z0-9+/_=-])" % LEAST_LENGTH)
NAME = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{2,}+[\"']?\s*+[:=]\s*+[\"']?")
#: Up to white space or a quote, or to the next name of a query string.
ASSIGNED = re.compile(r"(?:[^\s\"'&]|&(?![A-Za-z0-9_.-]+=))++")
OPENERS = {")": "(", "]": "[", "}": "{", ">": "<"}
CREDENTIAL = re.compile(r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|access_?key|auth|credential|private_?key)")
#: Shapes of well-known issuers, used for labels only.
ISSUED = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{16,}|eyJ[\w-]+\.eyJ[\w-]+\.[\w-]+")
FEATURES = (
    "length", "digits", "capitals", "lower", "others", "class_changes", "same_class_run", "letter_digit_changes",
    "entropy", "hex", "vowels", "dictionary", "longest_word", "credential_before", "assignment", "quoted",
    "words_before_known", "path_depth", "path_is_code", "path_is_text", "words_after_known", "credential_after",
)
_CODE = re.compile(r"(?i)\.(?:py|js|ts|java|go|rs|c|cpp|rb|php|sh|ya?ml|json|toml|ini|cfg|conf|env|properties|xml|tf)$")
_PROSE = re.compile(r"(?i)\.(?:md|txt|rst|html?|csv|log)$")
_LETTERS = re.compile(r"[^\W\d_]+")


def candidates(text: str) -> list[tuple[int, str]]:
    """(start, value), in order; a value assigned to a credential word counts whatever its characters are."""
    found = {}
    for m in CANDIDATE.finditer(text):
        value = m[0].strip(".-/")
        if len(value) >= LEAST_LENGTH and (any(c.isdigit() for c in value) or (value[1:] != value[1:].lower() and value != value.upper())):
            found[m.start() + m[0].find(value)] = value
    end = 0
    for m in NAME.finditer(text):
        if m.start() >= end and CREDENTIAL.search(m[0]) and (body := ASSIGNED.match(text, m.end())):
            value, end = _unclosed(body[0]), body.end()
            if len(value) >= max(LEAST_LENGTH, len(found.get(m.end(), ""))):
                found[m.end()] = value
    return sorted(found.items())


def _unclosed(value: str) -> str:
    """The value without marks of the sentence at its end and brackets that were opened before it."""
    counts = {c: value.count(c) for pair in OPENERS.items() for c in pair}
    end = len(value)
    while end and (value[end - 1] in ".,;" or counts.get(OPENERS.get(value[end - 1], ""), end) < counts.get(value[end - 1], 0)):
        if value[end - 1] in counts:
            counts[value[end - 1]] -= 1
        end -= 1
    return value[:end]


def describe(text: str, start: int, value: str, path: str, dictionary: Container[str]) -> list[float]:
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    mixed = sum({a, b} in ({"d", "l"}, {"d", "u"}) for a, b in zip(kinds, kinds[1:]))
    run = longest = 1
    for a, b in zip(kinds, kinds[1:]):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    counts = np.unique(np.frombuffer(value.encode("utf-32-le"), np.uint32), return_counts=True)[1] / n
    covered = best = 0
    for part in _LETTERS.findall(value):
        for piece in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|.+", part):
            if piece.lower() in dictionary and len(piece) > 2:
                covered += len(piece)
                best = max(best, len(piece))
    before = text[max(0, start - BESIDE) : start]
    near = before[-24:]
    words = [w.lower() for w in _LETTERS.findall(before)]
    after = text[start + n : start + n + BESIDE]
    words_after = [w.lower() for w in _LETTERS.findall(after)]
    return [
        n, kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n, kinds.count("o") / n, changes / n, longest / n, mixed / n,
        float(-(counts * np.log2(counts)).sum()), float(all(c in "0123456789abcdefABCDEF" for c in value)),
        sum(c in "aeiouAEIOU" for c in value) / n, covered / n, best, float(bool(CREDENTIAL.search(near))),
        float(bool(re.search(r"[:=]\s*[\"']?$", near))), float(near[-1:] in "\"'" and bool(near)),
        sum(w in dictionary for w in words) / max(len(words), 1), path.count("/"), float(bool(_CODE.search(path))), float(bool(_PROSE.search(path))),
        sum(w in dictionary for w in words_after) / max(len(words_after), 1), float(bool(CREDENTIAL.search(after))),
    ]


@dataclass
class Forest:
    """Trees as arrays: feature (-1: a leaf), bound, left child, right child, share of secrets."""

    trees: list[tuple[np.ndarray, ...]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), 0.5)
        total = np.zeros(len(x))
        for feature, bound, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                f = feature[at]
                inner = f >= 0
                goes_left = x[np.arange(len(x)), np.maximum(f, 0)] <= bound[at]
                at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
            total += share[at]
        return total / len(self.trees)


def _best_split(x: np.ndarray, y: np.ndarray, features: np.ndarray) -> tuple[float, int, float] | None:
    """(impurity, feature, bound) with the least weighted Gini impurity."""
    best = None
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        n_left = np.arange(1, len(v))
        ones = np.cumsum(t)[:-1]
        p, q = ones / n_left, (t.sum() - ones) / (len(v) - n_left)
        gini = n_left * p * (1 - p) + (len(v) - n_left) * q * (1 - q)
        ok = (v[1:] > v[:-1]) & (n_left >= LEAF) & (len(v) - n_left >= LEAF)
        if ok.any():
            k = int(np.where(ok, gini, np.inf).argmin())
            if best is None or gini[k] < best[0]:
                best = (float(gini[k]), int(f), float((v[k] + v[k + 1]) / 2))
    return best


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 7) -> Forest:
    """Bootstrap samples, and a random square root of the features at each split."""
    rng = np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        return Forest([])
    grown = []
    for _ in range(trees):
        nodes: list[list[float]] = []

        def split(rows: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
            if depth < DEPTH and 0 < nodes[me][4] < 1:
                tried = rng.choice(x.shape[1], max(2, int(np.sqrt(x.shape[1]))), replace=False)
                found = _best_split(x[rows], y[rows], tried)
                if found:
                    _, f, bound = found
                    low = x[rows, f] <= bound
                    nodes[me][:4] = [f, bound, split(rows[low], depth + 1), split(rows[~low], depth + 1)]
            return me

        split(rng.integers(0, len(y), len(y)), 0)
        table_ = np.array(nodes)
        grown.append((table_[:, 0].astype(int), table_[:, 1], table_[:, 2].astype(int), table_[:, 3].astype(int), table_[:, 4]))
    return Forest(grown)


class Dictionary:
    """Words by the bit of their CRC-32 in a bitmap of fixed size."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    def __contains__(self, word: str) -> bool:
        at = zlib.crc32(word.encode()) & (BITMAP_BITS - 1)
        return bool(self.bits[at >> 3] >> (at & 7) & 1)


def corpus_words(docs: DataFrame, text: str) -> DataFrame:
    """Words (w) of letters that LEAST_DOCUMENTS documents hold, and LEAST_SHARE of all documents."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,20}"), F.lit(0)))
    least = max(LEAST_DOCUMENTS, LEAST_SHARE * docs.count())
    return docs.select(F.explode(words).alias("w")).groupBy("w").count().where(F.col("count") >= least).select("w")


def corpus_dictionary(docs: DataFrame, text: str) -> Dictionary:
    return Dictionary(bitmap(corpus_words(docs, text).select(F.crc32(F.col("w").cast("binary")).alias("c")), "c"))


def find_candidates(docs: DataFrame, dictionary: Container[str], key: str, text: str, path: str) -> DataFrame:
    """(key, path, start, value, x) for each candidate; x holds the FEATURES."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)
    kind = docs.schema[key].dataType.simpleString()

    def run(batch):
        keys, values, paths = batch.column("_key"), batch.column("_body"), batch.column("_path").to_pylist()
        picked: list[int] = []
        out: list[tuple] = []
        for k in range(batch.num_rows):
            body = values[k].as_py()
            if not body:
                continue
            for start, value in candidates(body):
                picked.append(k)
                before = body[max(0, start - BESIDE) : start]
                out.append((paths[k] or "", start, value, before, describe(body, start, value, paths[k] or "", shared.value)))
        columns = list(zip(*out)) or [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays(
            [keys.take(pa.array(picked, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["_key", "_path", "start", "value", "before", "x"]
        )

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_body"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("_path"))
    return map_batches(rows, run, f"_key {kind}, _path string, start bigint, value string, before string, x array<double>")


def label_findings(found: DataFrame) -> DataFrame:
    """Candidates with is_secret: an issuer's shape, or a digit-bearing value assigned to a credential word."""
    issued = F.col("value").rlike(f"^(?:{ISSUED.pattern})$")
    assigned = F.col("before").rlike(CREDENTIAL.pattern + r"\w*[\"']?\s*[:=]\s*[\"']?$") & F.col("value").rlike("[0-9]")
    placeholder = F.lower("value").rlike(r"example|sample|changeme|placeholder|your|x{6,}|0{8,}|1234567")
    return found.withColumn("is_secret", (issued | assigned) & ~placeholder)


def train(labelled: DataFrame) -> Forest:
    """From findings (value, x, is_secret); about MOST_FINDINGS, half of either kind, chosen by a hash of the value."""
    counts = {r["is_secret"]: r["count"] for r in labelled.groupBy("is_secret").count().collect()}  # two rows
    if not counts.get(True) or not counts.get(False):
        return Forest([])
    half = MOST_FINDINGS / 2
    share = F.when(F.col("is_secret"), F.lit(half / counts[True])).otherwise(F.lit(half / counts[False]))
    got = labelled.where((F.xxhash64("value", "start") / F.lit(2.0**64)) + 0.5 < share).select("x", "is_secret").toPandas()
    return grow(np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES)), got["is_secret"].to_numpy().astype(float))


def scan(found: DataFrame, forest: Forest) -> DataFrame:
    """Add score and is_secret to candidates; the value is masked."""
    shared = found.sparkSession.sparkContext.broadcast(forest)
    kind = found.schema["_key"].dataType.simpleString()

    def run(batch):
        x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
        score = shared.value.predict(x)
        masked = [v[:3] + "*" * (len(v) - 3) for v in batch.column("value").to_pylist()]
        lengths = [len(v) for v in masked]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_key"), batch.column("_path"), batch.column("start"), pa.array(lengths, pa.int64()), pa.array(masked, pa.string()),
             pa.array(score, pa.float64()), pa.array(score >= THRESHOLD, pa.bool_())],
            names=["_key", "path", "start", "n_chars", "masked", "score", "is_secret"],
        )

    return map_batches(found, run, f"_key {kind}, path string, start bigint, n_chars bigint, masked string, score double, is_secret boolean")


def op1_secret_forest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = cut(find_candidates(docs, corpus_dictionary(docs, "text"), "doc_id", "text", "source"), "candidates")
    return scan(found, train(label_findings(found))).withColumnRenamed("_key", "doc_id")
