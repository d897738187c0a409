"""Contamination against brute force over random word sequences."""

from __future__ import annotations

import hashlib
import random
import re

from helpers import docs_frame, word_soup

from veilspan.llm.winnowing import drop_contaminated, find_overlaps

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id string, text string, fp string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = []
    for key, text in items:
        w = words(text)
        n = min(13, len(w))
        windows += [(key or "", tuple(w[i : i + n])) for i in range(len(w) - n + 1)] if w else []
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for item, g in windows:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found.add(item)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(11)
    items = [(f"i{k}", word_soup(rng, rng.randint(13, 40))) for k in range(12)]
    items += [("short", "Uno dos, tres"), ("one", "zeta"), ("i1", "again ZETA"), (None, "nothing like it here at all"), ("none", None), ("blank", " .,! ")]
    items += [("twelve", " ".join(f"w{k}" for k in range(12))), ("thirteen", " ".join(f"v{k}" for k in range(13)))]
    docs = [(k, word_soup(rng, rng.randint(0, 60))) for k in range(30)]
    for k, (_, t) in enumerate(items[:12]):
        w = t.split()
        a = rng.randint(0, len(w) - 13)
        docs.append((100 + k, word_soup(rng, rng.randint(0, 300), "qq rr ss") + " " + "; ".join(w[a : a + 13]).upper() + " é " + word_soup(rng, 5)))
    docs += [(200, "x UNO,dos tres ñ zeta"), (201, None), (202, ""), (203, "w0 w1 w2"), (204, " ".join(f"w{k}" for k in range(12)) + " tail" * 400)]
    docs += [(205, " ".join(f"v{k}" for k in range(12))), (206, " ".join(f"v{k}" for k in range(13))), (206, " ".join(f"v{k}" for k in range(13))), (None, items[0][1])]
    return docs, items


def frames(spark, docs, items):
    return docs_frame(spark, docs), spark.createDataFrame([(a, b, "c") for a, b in items], ITEMS)


def test_against_brute_force(spark):
    docs, items = cases()
    got = find_overlaps(*frames(spark, docs, items), ["doc_id"]).drop("_row")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items)


def test_clean_documents_stay(spark):
    docs, items = cases()
    kept = drop_contaminated(*frames(spark, docs, items))
    want = sorted((r[0] for r in brute(docs, items) if not r[5]), key=repr)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "root"]
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == want


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b")], [("i", "a b")])
    assert find_overlaps(docs.limit(0), items, ["doc_id"]).count() == 0
    assert [r["n_hit"] for r in find_overlaps(docs, items.limit(0), ["doc_id"]).collect()] == [0]
