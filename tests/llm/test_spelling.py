"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import duckdb

from sparkloom.llm import spelling


def brute(rows, damage, length=6, least=5, ratio=5):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    words = {w: n for w, n in found.items() if len(w) >= length and n >= least}
    return judged(words, ratio)


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def judged(words, ratio=5):
    around = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= ratio * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(around[w]), words.get(form.get(w))))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_whole_table(spark, docs):
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = rows_of(spelling.spelling_variants(docs, damage=spelling.DAMAGE))
    assert got == brute(texts, spelling.DAMAGE) and any(r[1] for r in got)


def test_every_kind_of_edit(spark):
    """Short alphabets, so that words share prefixes, repeat letters and have neighbours at every place."""
    random.seed(3)
    words = {}
    while len(words) < 400:
        w = "".join(random.choice("abé") for _ in range(random.randint(1, 9)))
        words[w] = random.choice([1, 1, 3, 20, 400, 9000])
    found = spelling.neighbours(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert sorted((r.word, r.other, r.n, r.other_n) for r in found.collect()) == sorted((a, b, words[a], words[b]) for a in words for b in words if near(a, b))


def test_chains_of_forms(spark):
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb"]
    text = " ".join(w for i, w in enumerate(chain) for _ in range(5**i * 5))
    got = rows_of(spelling.spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert got == brute([(1, text)], 0) and [r[2] for r in got] == [chain[-1]] * 6


def test_edges(spark, odd_docs, no_docs):
    long = "x" * 50_000 + "y" + "z" * 50_000
    more = spark.createDataFrame([(20, f"{long} {long[1:]} " * 6, "s", 1, "k", "b"), (21, "École éCOLE ÉCOLES Ärger× " * 7, "s", 1, "k", "b"), (22, "Straße STRASSE " * 9, "s", 1, "k", "b")], odd_docs.schema)
    for docs in (odd_docs.unionAll(more), no_docs):
        texts = [(r.doc_id, r.text) for r in docs.collect()]
        assert rows_of(spelling.spelling_variants(docs, damage=3)) == brute(texts, 3)


def test_counts_are_passed_on(spark, docs, monkeypatch):
    want = rows_of(spelling.spelling_variants(docs))
    monkeypatch.setattr(spelling, "HELD", 5)
    monkeypatch.setattr(spelling, "LETTERS", 40)
    assert rows_of(spelling.spelling_variants(docs)) == want


def test_query_like_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(spelling.SQL)
    names = [x[0] for x in want.description]
    got = spelling.op11_spelling_variants(spark, "/root/testdata/sf0.001").select(names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
