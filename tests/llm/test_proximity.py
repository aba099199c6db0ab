import math
import re
from collections import Counter

import numpy as np

from sparkloom.llm import proximity


def words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def brute(docs, items, window=10, slop=2, share=0.8):
    docs, items = [(d, words(t)) for d, t in docs], {(i, tuple(words(t))) for i, t in items}
    tests = {w for _, ws in items for w in ws}
    counts = Counter(w for _, ws in docs for w in ws if w in tests)
    out = set()
    for item, ws in items:
        n = min(window, len(ws))
        for start in range(len(ws) - n + 1) if n else ():
            win = ws[start : start + n]
            ranked = sorted((counts[w], w, i) for i, w in enumerate(win) if counts[w])
            if not ranked:
                continue
            _, term, at = ranked[0]
            for doc, dw in docs:
                for pos in (p for p, w in enumerate(dw) if w == term):
                    found = sum(w in dw[max(0, pos + i - at - slop) : max(0, pos + i - at + slop + 1)] for i, w in enumerate(win))
                    if found >= math.ceil(share * n):
                        out.add((doc, item, start, pos, found, pos >= at and tuple(dw[pos - at : pos - at + n]) == win))
    return out


def test_like_brute_force(spark):
    rng = np.random.default_rng(6)
    items = [(f"i{k}", " ".join(f"t{x}" for x in rng.integers(0, 120, n))) for k, n in enumerate((3, 10, 14, 30, 60))]
    docs = []
    for i in range(60):
        w = words(items[i % 5][1])
        for _ in range(i % 4):  # words inserted, dropped, replaced, swapped
            at, kind = int(rng.integers(0, len(w))), rng.integers(0, 4)
            if kind < 3:
                w[at : at + (kind != 0)] = ["other"] * int(kind != 1)
            else:
                w[at : at + 2] = w[at : at + 2][::-1]
        docs.append((i, " ".join([f"t{x}" for x in rng.integers(0, 300, 20)] + w + ["End."] * (i % 3))))
    got = proximity.proximity_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    got = set(map(tuple, got.collect()))
    assert got == brute(docs, items)
    assert any(x[-1] for x in got) and sum(not x[-1] for x in got) > 50


def test_edges(spark):
    docs = [(None, "alpha beta gamma"), (1, None), (2, ""), (3, "alpha beta gamma"), (3, "alpha beta gamma"), (4, "word " * 20000 + "alpha gamma beta")]
    items = [("a", "Alpha, beta gamma!"), ("a", "Alpha, beta gamma!"), (None, "beta"), ("e", ""), ("n", None), ("z", "nowhere")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item long")
    i = spark.createDataFrame([(*x, 2) for x in items], "item_id string, text string, doc long")
    assert set(map(tuple, proximity.proximity_matches(d, i).collect())) == brute(docs, items)
    assert proximity.proximity_matches(d.limit(0), i).count() == proximity.proximity_matches(d, i.limit(0)).count() == 0
