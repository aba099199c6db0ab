import math
import re
import zlib
from collections import Counter

import numpy as np

from sparkloom.llm.lm_scoring import lm_scores, resample, seat


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def check(docs, **more):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, t in rows if not held[i] for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held[i], len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t in rows), key=repr)
    got = lm_scores(docs, **more).collect()
    assert sorted(((*tuple(r)[:5], round(r.base_score, 6)) for r in got), key=repr) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    return got


def test_like_brute_force_and_better_than_the_base(docs):
    got = check(docs, bucket_bytes=1 << 16)
    held = [r for r in got if r.held_out]
    per = lambda x: -sum(getattr(r, x) for r in held) / sum(r.n_tokens for r in held)
    assert per("score") < per("base_score") - 0.1
    train = [r for r in got if not r.held_out]
    assert sum(r.score for r in train) > sum(r.base_score for r in train)


def test_edges(odd_docs):
    check(odd_docs)


def test_empty(no_docs):
    assert lm_scores(no_docs).collect() == []


def test_seating_follows_the_restaurant_rule():
    """Three customers of one dish in a restaurant of its own: tables against the exact distribution."""
    d, fresh, grow, n = 0.5, 0.7, 0.2, 40000
    rng = np.random.default_rng(4)
    c, f, g = np.full(n, 3), np.full(n, fresh), np.full(n, grow)
    t, norm = seat(c, f, g, d, rng)
    for _ in range(6):
        t, norm = resample(c, t, norm, f, g, d, rng)
    two = fresh
    weight = np.array([(1 - d) * (2 - d), (1 - d) * two + two * 2 * (1 - d), two * (fresh + grow)])
    seen = np.array([(t == k).mean() for k in (1, 2, 3)])
    assert np.abs(seen - weight / weight.sum()).max() < 0.015


def test_chances_sum_to_one(spark):
    """Behind one context, the chances of all words and of the unknown one."""
    train = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(40, 400) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, f"a {x} a b") for i, x in zip(train, "bcdefghbcbcbb" * 3)]
    vocabulary = sorted({w for _, t in rows for w in t.split()})
    rows += [(i, f"a {w}") for i, w in zip(held, [*vocabulary, "zzz"])]
    rows += [(10_000 + next(k for k in range(9999) if zlib.crc32(str(10_000 + k).encode()) % 7 == 2), "a")]
    got = {r.doc_id: r for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({r.train_tokens for r in got.values()}) == 1
    assert sum(10 ** got[i].score for i in held[: len(vocabulary) + 1]) < 1
