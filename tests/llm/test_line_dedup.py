from collections import Counter

import numpy as np
from pyspark.sql import functions as F
import xxhash

from sparkloom.llm import line_dedup as ld


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, min_words=1, similarity=0.85):
    """Over all pairs of distinct lines, by edit similarity alone."""
    where = {}
    for doc, text in rows:
        for n, words in enumerate(ld.normal_lines((text or "").encode())):
            if len(words) >= min_words:
                where.setdefault(b" ".join(words).decode(), []).append(((doc is not None, doc), ld_mark(text), n))
    bodies = sorted(where)
    parent = list(range(len(bodies)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for i in range(len(bodies)):
        for j in range(i + 1, len(bodies)):
            x, y = bodies[i].split(" "), bodies[j].split(" ")
            k = int((1 - similarity) * max(len(x), len(y)))
            if abs(len(x) - len(y)) <= k and (Counter(x) - Counter(y)).total() <= k and edit(x, y) <= int((1 - similarity) * max(len(x), len(y))):
                links += 1
                parent[find(i)] = find(j)
    groups = {}
    for i, b in enumerate(bodies):
        groups.setdefault(find(i), []).extend(where[b])
    gone = set()
    for g in groups.values():
        first = min(g, key=lambda x: (x[0][0], x[0][1] or 0, x[1], x[2]))
        gone |= {x for x in g if x != first}
    out = []
    for doc, text in rows:
        mine = {n for d, m, n in gone if d == (doc is not None, doc) and m == ld_mark(text)}
        out.append((doc, None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in mine)))
    return out, links


MARKS = {}


def ld_mark(text):
    return MARKS[text]


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    MARKS.update({r.text: r.m for r in docs.select("text", F.xxhash64("text").alias("m")).collect()})
    want, links = brute(rows)
    got = ld.line_dedup(docs)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert set(docs.columns) <= set(got.columns)
    return links


def test_like_brute_force(docs, spark):
    rng = np.random.default_rng(2)
    rows = [(r.doc_id, r.text) for r in docs.limit(20).collect()]
    base = [f"term{i}" for i in rng.integers(0, 5000, 160)]
    for i in range(12):  # long lines that differ in one word
        w = list(base)
        w[rng.integers(0, 160)] = f"other{i}"
        rows.append((1000 + i, "A short one.\n" + " ".join(w) + f"\nunique line number {xxhash.xxh3_64_hexdigest(str(i))} a b c"))
    assert check(spark.createDataFrame(rows, "doc_id long, text string")) > 5


def test_edges(odd_docs):
    check(odd_docs.withColumn("text", odd_docs.text.substr(1, 2000)))
    assert ld.line_dedup(odd_docs.where("length(text) > 50000")).select("n_removed").collect() == [(0,), (1,)]


def test_long_lists(spark, monkeypatch):
    monkeypatch.setattr(ld, "TILE", 4)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(24):
        w = list(base)
        for at in rng.integers(0, 100, rng.integers(0, 3)):
            w[at] = f"x{i}_{at}"
        rows.append((i, " ".join(w)))
    assert check(spark.createDataFrame(rows, "doc_id long, text string")) > 30


def test_lines_that_share_many_lists(spark, monkeypatch):
    """Copies with many edits: they meet in many lists, some pairs are links and some are not."""
    monkeypatch.setattr(ld, "TILE", 8)
    rng = np.random.default_rng(6)
    rows = []
    for i in range(40):
        w = [f"w{k}" for k in range(61)]
        for at in rng.choice(61, rng.integers(3, 9), replace=False):
            w[at] = f"x{i}_{at}"
        rows.append((i, " ".join(w)))
    links = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert 0 < links < 40 * 39 // 2


def test_empty(no_docs):
    assert ld.line_dedup(no_docs).collect() == []


def test_every_similar_pair(spark):
    """Edit similarity alone decides, at the lengths that lines have; the brute force has no SimHash."""
    rng = np.random.default_rng(5)
    rows = []
    for n in (7, 8, 12, 20, 21, 35, 50):
        for _ in range(12):
            base = [f"v{int(400 * x**2)}" for x in rng.random(n)]
            rows.append(base)
            for _ in range(3):
                w = list(base)
                for _ in range(rng.integers(1, int(0.15 * n) + 2)):
                    at, kind = rng.integers(0, len(w)), rng.integers(0, 3)
                    w[at : at + (kind != 0)] = [f"v{int(400 * rng.random() ** 2)}"] * int(kind != 1)
                rows.append(w)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    MARKS.update({r.text: r.m for r in docs.selectExpr("text", "xxhash64(text) AS m").collect()})
    want, links = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert links > 100
    assert sorted((r.doc_id, r.text) for r in ld.line_dedup(docs).collect()) == sorted(want)


def test_digits_count(spark):
    """Rows of numbers of equal width are different lines."""
    docs = spark.createDataFrame([(1, "12 45 78 90"), (2, "31 22 64 55"), (3, "12 45 78 90")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in ld.line_dedup(docs).collect()) == [(1, 0), (2, 0), (3, 1)]


def test_recall_by_length(spark):
    """Lines with as many replaced, inserted or deleted words as 0.85 allows are all found, at every length."""
    rows, close, lengths = [], {}, (7, 10, 24, 25, 60, 99, 100, 300)
    for words in lengths:
        rng = np.random.default_rng(words)
        for i in range(60):
            base = [f"v{words}w{x}" for x in rng.integers(0, 3000, words)]
            w, most = list(base), int(0.15 * words)
            for at in sorted(rng.choice(words, most, replace=False), reverse=True):
                kind = rng.integers(0, 3) if i % 2 else 0
                w[at : at + 1] = [[f"x{i}"], [], [w[at], f"y{i}"]][kind]
            rows += [(1000 * words + 2 * i, " ".join(base)), (1000 * words + 2 * i + 1, " ".join(w))]
            x, y = (rows[k][1].split() for k in (-2, -1))
            close[words] = close.get(words, 0) + (edit(x, y) <= int(0.15 * max(len(x), len(y))))
    got = ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").groupBy((F.col("doc_id") / 1000).cast("int").alias("words")).count()
    assert {r.words: r["count"] for r in got.collect()} == close and min(close.values()) > 20


def test_short_and_blankless_lines(spark):
    han = "今日は天気がとても良いので公園まで散歩に行きました"
    rows = [(1, "Read more\n" + han), (2, "read more!\n" + han[:-2] + "した"), (3, "Read less\n---\n---")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in ld.line_dedup(docs).collect()) == [(1, 0), (2, 2), (3, 0)]


def test_edit_distance_by_bits():
    rng = np.random.default_rng(1)
    for _ in range(2000):
        x, y = ([f"{i}" for i in rng.integers(0, 5, rng.integers(0, 12))] for _ in range(2))
        d = edit(x, y)
        assert [ld.within(x, y, k) for k in range(13)] == [ld.alike(x, y, k) for k in range(13)] == [d <= k for k in range(13)]


def test_lists_are_cut_by_length():
    """No two lines of similar length and a common key are in different lists, and nobody is alone in one."""
    rng = np.random.default_rng(4)
    for similarity in (0.6, 0.85, 0.97, 1.0):
        n = rng.integers(1, 400, 600)
        key = rng.integers(0, 60, 600).astype(np.uint64)
        kind = ld.length_class(n, similarity)
        got = ld.segments(key, kind, np.ones(600, np.int64))
        near = np.abs(n[:, None] - n) <= ld.allowed(np.maximum(n[:, None], n), similarity)
        near &= (key[:, None] == key) & ~np.eye(600, dtype=bool)
        x, y = np.nonzero(near)
        assert (got[x] == got[y]).all() and (got[x] > 0).all()
        _, where, size = np.unique(np.stack([key, got.astype(np.uint64)])[:, got > 0], axis=1, return_inverse=True, return_counts=True)
        assert not len(size) or size.min() > 1
    assert ld.segments(np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64)).tolist() == []


def test_common_words_are_counted_in_all_documents(spark, monkeypatch):
    n, filler = 60, " ".join(f"Filler{i % 997}" for i in range(40_000))  # 22 MB
    docs = spark.range(0, n, 1, 4).select(F.concat(F.lit(filler), F.lit("\n"), F.expr("'word' || (id div 3)"), F.lit(", a-b")).alias("text"))
    monkeypatch.setattr(ld, "WORDS", 500, raising=False)
    got = dict(zip(*(x.tolist() for x in ld.common_words(docs)), strict=True))
    want = Counter({w: n * c for w, c in Counter(filler.lower().encode().split()).items()}) + Counter({b"a": n, b"b": n})
    want += Counter(f"word{i // 3}".encode() for i in range(n))
    assert got == {xxhash.xxh3_64_intdigest(w): c for w, c in want.items() if c > 2}


def test_pairs_of_a_very_common_word_come_last():
    """Of pairs with equally rare words, those whose other word is rarer are posted."""
    counts = {b"mid": 50, b"the": 1_000_000}
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in counts], np.uint64)
    o = np.argsort(h)
    common = h[o], np.array(list(counts.values()))[o]
    for i in range(20):
        coded = ld.numbered([[f"r{i}x{j}".encode() if w == b"r" else w for j, w in enumerate([b"r", b"mid", b"r", b"the", b"r", b"the", b"r"])]])
        keys, bounds = ld.rare_pairs(coded, common, 0.85)
        of = lambda a, b: ld.mix(ld.mix(a + ld.mix(b)))
        word = coded[1][coded[0]]
        assert bounds.tolist() == [0, 3] and set(of(word[:2], word[1:3]).tolist()) <= set(keys.tolist())


def test_lines_of_whole_pieces_are_those_of_plain_code(spark):
    """Words, lines and their numbers are cut from whole pieces at once; plain code cuts them line by line."""
    han = "今日は天気 がとても良い\n\n ไทย abc"
    texts = ["", " \n\t x", "One, two -- three\n\nfour\r\n" * 3, "é" * 300 + " tail " + "z" * 70_000, han, "a" * 400_000 + "b\n" + "a" * 400_000 + "c", "\n", "last word", "a.b.c.d.e.f.g h"]
    docs = spark.createDataFrame([(i, 7, t) for i, t in enumerate(texts)], "doc long, mark long, text string").coalesce(1)
    got = ld.occurrences(docs, 1, 0.85).collect()
    want = [(i, n, xxhash.xxh3_64_intdigest(b" ".join(w)) >> 1) for i, t in enumerate(texts) for n, w in enumerate(ld.normal_lines(t.encode())) if w]
    assert [(r.doc, r.line, r.id) for r in got] == want
    bodies = {xxhash.xxh3_64_intdigest(b" ".join(w)) >> 1: w for t in texts for w in ld.normal_lines(t.encode())}
    assert all(r.n is None or r.n == len(bodies[r.id]) for r in got) and len({r.id for r in got if r.n is not None}) == len({r.id for r in got})
    assert {r.body for r in got if r.body} == {b" ".join(w).decode() for w in bodies.values() if len(w) > 5}
    for t in texts:
        raw = ld.normal(t.encode())
        number, h = ld.told_apart(raw, *ld.words_of(raw))
        assert h[number].tolist() == [xxhash.xxh3_64_intdigest(w) for w in raw.split()] and len(set(h.tolist())) == len(h)


def test_only_wanted_lines_are_joined(spark):
    """A bitmap keeps every wanted line and leaves nearly all others out of a shuffle."""
    ids = [xxhash.xxh3_64_intdigest(str(i)) >> 1 for i in range(20_000)]
    rows = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id long, line long")
    got = {r.line for r in ld.with_ids(rows, spark.createDataFrame([(x,) for x in ids[:500]], "id long")).collect()}
    assert set(range(500)) <= got and len(got) < 520
