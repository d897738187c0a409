"""Small tables for the tests of the llm operators."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, root string"


def docs_frame(spark, rows):
    """documents with two extra columns whose names operators use inside; rows are (doc_id, text, ...)."""
    whole = [tuple(r) + (None,) * (3 - len(r)) for r in rows]
    return spark.createDataFrame([(i, t, lang, f"src{(i or 0) % 3}", None, "x", "y") for i, t, lang in whole], DOCS)


def word_soup(rng: random.Random, n: int, words: str = "ab cd ef gh ij kl mn op") -> str:
    return " ".join(rng.choice(words.split()) for _ in range(n))
