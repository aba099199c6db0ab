import hashlib

import numpy as np

from sparkloom.llm.suffix_dedup import repeated_windows, suffix_dedup


def brute(rows, length):
    rows = [(2**62 if i is None else i, i, (t or "").encode()) for i, t in rows]
    least = {}
    for order, _, t in rows:
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            least[w] = min(order, least.get(w, order))
    out = []
    for order, name, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if least[t[p : p + length]] < order:
                gone[p : p + length] = True
        edge = np.diff(np.concatenate(([0], gone.astype(int))))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((name, len(t), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(docs, length, **more):
    return sorted((tuple(r) for r in suffix_dedup(docs, length=length, **more).collect()), key=repr)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_like_brute_force(docs):
    assert run(docs, 50, block_bytes=1 << 16) == brute(pairs(docs), 50)


def test_edges(odd_docs):
    assert run(odd_docs, 50, block_bytes=1 << 14) == brute(pairs(odd_docs), 50)


def test_repetitive_texts(spark):
    rows = [(3, "a" * 200), (1, "a" * 60 + "b" * 60), (2, "ab" * 90), (5, "xyz" * 50 + "ab" * 40), (4, "b" * 55), (9, "a" * 49), (7, "xyz" * 17)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(d, 50, block_bytes=100) == brute(rows, 50)
    assert run(d, 8, seed=4, block_bytes=100) == brute(rows, 8)


def test_empty(no_docs):
    assert run(no_docs, 50) == []


def test_radix_passes():
    rng = np.random.default_rng(1)
    w, doc = rng.integers(0, 2, (400, 10), dtype=np.uint8), rng.integers(0, 50, 400)
    least = {}
    for x, d in zip(w, doc):
        least[x.tobytes()] = min(d, least.get(x.tobytes(), d))
    assert repeated_windows(w, doc).tolist() == [d > least[x.tobytes()] for x, d in zip(w, doc)]
