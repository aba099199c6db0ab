import re
from collections import defaultdict

import numpy as np

from sparkloom.llm import near_dedup as nd
from sparkloom.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    rows = sorted({(i, t) for i, t in rows if i is not None}, key=repr)
    sets = [shingles(t) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    pairs = {(a, b) for v in where.values() for j, a in enumerate(v) for b in v[:j]}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(rows[a][0]), find(rows[b][0])))
            parent[y] = x
    return {i: find(i) for i in parent}


def check(docs, **more):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    got = nd.near_dedup(docs, **more).collect()
    assert len(got) == len(rows)
    assert sorted(((r.doc_id, r.n_shingles) for r in got), key=repr) == sorted(((i, len(shingles(t))) for i, t in rows), key=repr)
    for r in got:
        assert r.component_id == want.get(r.doc_id)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    return want


def test_like_brute_force(docs):
    want = check(docs)
    assert len(set(want.values())) < len(want)


def test_edges(odd_docs):
    check(odd_docs)


def test_empty(no_docs):
    assert nd.near_dedup(no_docs).collect() == []


def test_large_group_of_near_copies(spark, monkeypatch):
    """Copies of one text with more and fewer edits, so that some link only to a few others."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for at in rng.choice(len(w), rng.integers(0, 9), replace=False):
            w[at] = f"x{i}_{at}"
        rows.append((i * 3 % 151, " ".join(w)))
    monkeypatch.setattr(nd, "LONG_LIST", 20)
    monkeypatch.setattr(nd, "TILE", 32)
    monkeypatch.setattr(nd, "STAR", 16)
    want = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert 1 < len(set(want.values())) < 100


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (300, 200), (7, 7), (500, 400)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 200: 100, 300: 100, 400: 400, 500: 400}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
