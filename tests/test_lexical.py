"""Analyzers and BM25 over fields: literals, and a brute-force scorer."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import analysis, arrow
from sparkloom.operators import fielded, retrieval
from sparkloom.plans import lexical

# singular and plural of the stemming bench, and words that must stay whole
PAIRS = "cost costs report reports contract contracts payment payments document documents rule rules claim claims limit limits benefit benefits supplier suppliers agreement agreements term terms invoice invoices policy policies status statuses address addresses process processes employee employees company companies expense expenses".split()
WHOLE = "business organization reimbursement compliance analysis premises data status".split()


def analyzed(spark, text, f=analysis.english_terms):
    return spark.createDataFrame([(text,)], "text string").select(f(F.col("text")).alias("t")).first().t


def test_stemming_bench(spark):
    one, many = analyzed(spark, " ".join(PAIRS[::2])), analyzed(spark, " ".join(PAIRS[1::2]))
    assert one == many == PAIRS[::2]
    assert analyzed(spark, " ".join(WHOLE)) == WHOLE


@pytest.mark.parametrize(("text", "want"), [
    ("The Employees’ café’s policies", ["employee", "cafe", "policy"]),
    ("per-diem “allowances” – 3.14 v1.2.3", ["per", "diem", "allowance", "3.14", "v1.2.3"]),
    ("a_b is not the Straße, Ærø", ["a_b", "strasse", "aero"]),
    ("viruses, bonuses, houses, causes, boxes, ties, shoes, heroes, news", ["virus", "bonus", "house", "cause", "box", "tie", "shoe", "hero", "news"]),
    (None, []), ("", []), ("of the and", []),
])
def test_english(spark, text, want):
    assert analyzed(spark, text) == want


def test_stop_words_keep_their_places(spark):
    assert analyzed(spark, "terms of the contract", analysis.english_positions) == ["term", "", "", "contract"]


def test_codes_keep_their_places(spark):
    got = [tuple(x) for x in analyzed(spark, "see Wi-Fi-802.11 SEC-4.2", analysis.exact_positions)]
    assert got == [(0, "see"), *((1, t) for t in ("wi-fi-802.11", "wi", "fi", "802", "11", "wifi", "80211", "wifi80211")), *((2, t) for t in ("sec-4.2", "sec", "4", "2", "42", "sec42"))]
    assert analyzed(spark, "a - b", analysis.exact_positions)[1].term == "-"


def test_code_positions_need_no_other_row(spark, tmp_path):
    rows = [(1, "see B-2 here"), (1, "plain words only"), (2, None), (3, "no digit")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lexical.exact_code_positions(spark, str(tmp_path))
    assert sorted(tuple(x) for x in got.collect()) == [(1, 1, "2"), (1, 1, "b"), (1, 1, "b-2"), (1, 1, "b2")]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_identifiers_named_by_any_of_them(spark):
    docs = spark.createDataFrame([(1, "see SEC-4.2.1 and TKT-99812"), (2, "SEC 4.2.1, again sec-4.2.1"), (3, "SEC-4.2"), (4, "section 14.2.1"), (5, None), (1, "TKT-99812")], "doc_id long, text string")
    asked = spark.createDataFrame([(9, ["SEC-4.2.1", "TKT-99812", "SEC-4.2.1"]), (8, ["2"]), (7, []), (6, ["--"])], "query_id long, identifiers array<string>")
    got = {(r.query_id, r.doc_id): (r.n_identifiers, r.n_places, r["rank"]) for r in retrieval.identifiers_in(docs, asked, analysis.code_runs).collect()}
    assert got == {(9, 1): (2, 3, 1), (9, 2): (1, 2, 2), (8, 2): (1, 2, 1), (8, 1): (1, 1, 2), (8, 3): (1, 1, 3), (8, 4): (1, 1, 4)}


def test_identifiers_of_many_questions_are_ranked_once(spark):
    rng = random.Random(5)
    codes = [f"TKT-{i}" for i in range(6)]
    texts = {d: " ".join(rng.choices(codes, k=rng.choice([1, 1, 1, 2, 3, 5]))) for d in range(120)}
    asks = {q: rng.sample(codes + ["tkt 1"], rng.randint(1, 4)) for q in range(60)}
    docs, asked = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(asks.items()), "query_id long, identifiers array<string>")
    want = {}
    for q, ids in asks.items():
        places = {d: [t.split().count(c.upper().replace(" ", "-")) for c in ids] for d, t in texts.items()}
        hits = sorted((-sum(map(bool, n)), -sum(n), d) for d, n in places.items() if any(n))[:4]
        want |= {(q, d): (-a, -b, r) for r, (a, b, d) in enumerate(hits, 1)}
    found = retrieval.identifiers_in(docs, asked, analysis.code_runs, 4)
    assert {(r.query_id, r.doc_id): (r.n_identifiers, r.n_places, r["rank"]) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "lead" in plan and plan[plan.index("Final Plan") : plan.index("Initial Plan")].count("ReusedExchange") >= 1


def brute(docs, questions, weights, slop=2):
    """Scores by definition; texts are words without stop words or plurals."""
    tokens = {(d, f): (t or "").split() for d, fields in docs.items() for f, t in zip(weights, fields)}
    out = {}
    for q, text in questions.items():
        words = text.split()
        distinct = set(words)
        need = len(distinct) if len(distinct) <= 2 else math.floor(len(distinct) * 0.7)
        for d in docs:
            best = phrase = 0.0
            for f, boost in weights.items():
                ts = tokens[d, f]
                held = [tokens[x, f] for x in docs if tokens[x, f]]
                mean = sum(map(len, held)) / max(1, len(held))
                norm = 0.9 * (0.6 + 0.4 * len(ts) / max(mean, 1e-9))
                idf = {t: math.log1p((len(held) - sum(t in x for x in held) + 0.5) / (sum(t in x for x in held) + 0.5)) for t in distinct}
                tf = Counter(ts)
                there = [t for t in distinct if tf[t]]
                if not there or len(there) < need:
                    continue
                best = max(best, boost * sum(idf[t] * tf[t] * 1.9 / (tf[t] + norm) for t in there))
                if len(there) == len(distinct):
                    off = [[p - i for p, t in enumerate(ts) if t == w] for i, w in enumerate(words)]
                    freq = 0.0
                    for s in {x for o in off for x in o}:
                        reach = [min((x for x in o if x >= s), default=s + slop + 1) - s for o in off]
                        freq += 1 / (1 + max(reach)) if max(reach) <= slop else 0
                    if freq:
                        phrase = max(phrase, boost * sum(idf[t] for t in words) * freq * 1.9 / (freq + norm))
            if best:
                out[q, d] = round(best + 2 * phrase, 6)
    return out


def test_fields_like_brute_force(spark):
    random.seed(4)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    weights = {"content": 1.0, "title": 2.0}
    text = lambda n: " ".join(random.choice(words) for _ in range(random.randint(0, n)))
    docs = {i: (text(30), text(5) if i % 4 else None) for i in range(60)}
    questions = {i: text(5) or "alpha" for i in range(25)}
    table = spark.createDataFrame([(i, *x) for i, x in docs.items()], "doc_id long, content string, title string").repartition(3)
    asked = spark.createDataFrame(list(questions.items()), "query_id long, text string")
    want = brute(docs, questions, weights)
    for cells in (1 << 21, 120):
        fielded.CELLS = cells
        got = {(r.query_id, r.doc_id): r.score for r in fielded.bm25_fields(table, asked, weights).collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)
    fielded.CELLS = 1 << 21


def test_scope_comes_before_ranking(spark):
    docs = spark.createDataFrame([(i, "rare word", "a" if i < 50 else "b") for i in range(60)] + [(99, "rare word", None)], "doc_id long, content string, lang string")
    asked = spark.createDataFrame([(1, "rare word"), (2, "absent")], "query_id long, text string")
    found = fielded.bm25_fields(docs, asked, {"content": 1.0}, k=5, scope=F.col("lang") == "b")
    assert [(r.query_id, r.doc_id, r["rank"]) for r in found.orderBy("rank").collect()] == [(1, 50 + i, i + 1) for i in range(5)]
    assert fielded.bm25_fields(docs, asked.limit(0), {"content": 1.0}).collect() == []
    assert fielded.bm25_fields(docs.limit(0), asked, {"content": 1.0}).collect() == []


def test_nothing_is_read_before_an_action(spark):
    """Documents are not read while the query is built: a table that cannot be read fails only afterwards."""
    docs = spark.createDataFrame([(1, "a")], "doc_id long, content string").withColumn("content", F.raise_error(F.lit("read")).cast("string"))
    fielded.bm25_fields(docs, spark.createDataFrame([(1, "alpha")], "query_id long, text string"), {"content": 1.0})


def test_many_questions_in_bounded_memory(spark):
    """20,000 questions: cells are held in blocks, whatever the number of questions."""
    docs = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 2}") for i in range(300)], "doc_id long, content string")
    asked = spark.range(20_000).selectExpr("id AS query_id", "concat('w', id % 300, ' w', id % 300 + 1) AS text")
    got = fielded.bm25_fields(docs, asked, {"content": 1.0}, k=1).selectExpr("count(*) AS n", "count_if(doc_id = greatest(query_id % 300 - 1, 0)) AS right").first()
    assert got.n == got.right == 20_000


def test_words_of_tasks_are_the_analyzer_s(spark):
    text = " ".join([*PAIRS, *WHOLE, "the of café’s viruses bonuses houses causes boxes ties shoes heroes news foes ties's his gas a_b v1.2.3 uses tuses species"])
    words = analyzed(spark, text, analysis.english_words)
    assert [analysis.english_stem(w) for w in words] == analyzed(spark, text, analysis.english_positions)


def test_texts_are_cut_once_and_batches_in_pieces(spark, monkeypatch):
    rows = [(i, f"alpha beta w{i}") for i in range(50)]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "alpha w7"), (2, "beta")], "query_id long, text string")
    want = [tuple(x) for x in retrieval.bm25(docs, asked, 3).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(arrow, "PIECE", 7)
    monkeypatch.setattr(fielded, "CELLS", 5)
    batch = pa.RecordBatch.from_pydict({"a": [[1] * n for n in (3, 9, 0, 2, 4, 2)]})
    assert [x.num_rows for x in arrow.pieces([batch.slice(0, 6), batch.slice(2, 1)], [0])] == [1, 1, 3, 1, 1]
    found = retrieval.bm25(docs, asked, 3).orderBy("query_id", "rank")
    assert [tuple(x) for x in found.collect()] == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan[plan.index("Final Plan") : plan.index("Initial Plan")]
