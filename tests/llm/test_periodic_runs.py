"""Runs of words against brute force over every period."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from sparkloom.llm import periodic_runs


def brute(w, times=4, least=6):
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda x: (x[0], x[2]))


def some_words(letters):
    w = []
    while len(w) < random.randint(0, 160):
        w += [random.choice(letters) for _ in range(random.randint(1, random.choice([2, 5, 30])))] * random.randint(1, 6)
        if random.random() < 0.3:
            w = w * random.randint(1, 4)
    return w[:400]


@pytest.mark.parametrize("times", [2, 3, 4, 5])
def test_every_run_is_caught(times):
    random.seed(times)
    for _ in range(400):
        w = some_words([b"a", b"b", b"c"][: random.randint(1, 3)])
        assert periodic_runs.runs_of(w, times, 6) == brute(w, times, 6)
        assert periodic_runs.runs_of(w, times, 1) == brute(w, times, 1)


def test_words_come_one_by_one():
    random.seed(8)
    for _ in range(50):
        w = some_words([b"a", b"b"])
        catchers = periodic_runs.Catchers(len(w))
        for word in w:
            catchers.extend([word])
        assert catchers.end() == periodic_runs.runs_of(w)


def test_long_texts_take_no_square_time():
    fib = [b"a"], [b"a", b"b"]
    while len(fib[1]) < 20_000:
        fib = fib[1], fib[1] + fib[0]
    assert periodic_runs.runs_of(fib[1]) == []
    assert periodic_runs.runs_of([b"a"] * 30_000) == [(0, 30_000, 1)]
    block = [b"%d" % i for i in range(10_000)]
    assert periodic_runs.runs_of([b"x"] + block * 4 + [b"y"]) == [(1, 40_000, 10_000)]


def wanted(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(((-m, s, q) for s, m, q in runs), default=None)
    first = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(runs), *first, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_on_the_whole_table(spark, docs):
    got = periodic_runs.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    short = {r.doc_id: r.text for r in docs.collect() if len((r.text or "").split()) < 2500}
    assert len(got) == docs.count() and len(short) > 150
    for r in got:
        if r.doc_id in short:
            assert tuple(r) == wanted(r.doc_id, short[r.doc_id])
    assert any(r.n_runs for r in got)


def test_edges(spark, odd_docs, no_docs):
    more = spark.createDataFrame([(30, "ab cd " * 9, "s", 1, "k", "b"), (31, "x\ty\nx\r\ny x y x y", "s", 1, "k", "b"), (30, "ab cd " * 9, "s", 1, "k", "b")], odd_docs.schema)
    docs = odd_docs.unionAll(more)
    got = periodic_runs.periodic_runs(docs)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    want = sorted(((r.doc_id, brute((r.text or "").split())) for r in docs.collect() if len((r.text or "").split()) < 2000), key=repr)
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs]) for r in got.collect() if r.n_words < 2000), key=repr) == want
    assert [r.collapsed for r in got.where("doc_id IN (30, 31)").collect()] == ["ab cd", "x y", "ab cd"]
    assert periodic_runs.periodic_runs(no_docs).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, times=1)


def test_query_like_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(periodic_runs.SQL)
    names = [x[0] for x in want.description]
    got = periodic_runs.op12_periodic_runs(spark, "/root/testdata/sf0.001").select(names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
