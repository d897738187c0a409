from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from veilspan.llm import textkit as tk

TEXTS = [None, "", " ", "a", "ab  cd", "x y", "é ü", "end", "start", "a\nb\x0bc", "z" * 50]


def test_words_end_at_row_ends():
    for limit in (1, 7, 1000):
        got = []
        for first, end, data, offsets in tk.slices(pa.array(TEXTS), limit):
            starts, ends, row = tk.words(data, offsets, tk.NOT_WHITE)
            got += [(first + r, data[a:b].tobytes().decode()) for a, b, r in zip(starts, ends, row)]
            assert end > first
        want = [(k, w) for k, t in enumerate(TEXTS) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        assert got == want


def test_hashes_follow_content():
    data = np.frombuffer(b"abcabcabd" * 3, np.uint8)
    prefix = tk.Prefix(data)
    windows = prefix.windows(3)
    for i in range(len(windows)):
        for j in range(len(windows)):
            assert (windows[i] == windows[j]) == (data[i : i + 3].tobytes() == data[j : j + 3].tobytes())
    assert prefix.ranges(np.array([0]), np.array([3]))[0] == windows[0]


def test_window_minima_take_the_rightmost():
    rng = random.Random(5)
    values = np.array([rng.randint(0, 6) for _ in range(200)], np.uint64)
    for width in (1, 2, 3, 7, 16):
        got = tk.window_minima(values, width)
        for i in range(len(values) - width + 1):
            part = values[i : i + width].tolist()
            assert got[i] == i + max(k for k, v in enumerate(part) if v == min(part))


def test_empty_columns():
    assert list(tk.slices(pa.array([], pa.string()))) == []
    assert tk.grams(np.empty(0, np.uint64), np.empty(0, np.int64), 5)[0].size == 0
