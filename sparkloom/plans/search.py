"""Queries over documents, passages and vectors, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evals, retrieval
from ..sources.pages import html_blocks
from ..sources.tables import table
from .registry import registry

QUERIES, SQL, query = registry()


TOKENS = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), lambda t: NOT contains(t, '_'))"
BM25 = f"""
d AS (SELECT doc_id, {TOKENS} AS ts FROM documents),
q AS (SELECT item_id AS query_id, list_distinct({TOKENS}) AS ts FROM benchmark),
qt AS (SELECT query_id, len(ts) AS n_terms, unnest(ts) AS term FROM q),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
st AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avg_dl FROM d),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
sc AS (SELECT query_id, doc_id, n_terms, count(*) AS matched,
  round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * (0.9 + 1) / (tf + 0.9 * (1 - 0.4 + 0.4 * dl / avg_dl))), 6) AS score
  FROM p JOIN qt USING (term) JOIN df USING (term), st GROUP BY ALL),
bm25 AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)
"""
PHRASE = f"""
pq AS (SELECT DISTINCT query_id, array_to_string(ts[i : i + 7], ' ') AS run FROM (SELECT query_id, ts, unnest(range(1, len(ts) - 6)) AS i FROM
  (SELECT item_id AS query_id, {TOKENS} AS ts FROM benchmark))),
pd AS (SELECT doc_id, array_to_string(ts[i : i + 7], ' ') AS run FROM (SELECT doc_id, ts, unnest(range(1, len(ts) - 6)) AS i FROM (SELECT doc_id, {TOKENS} AS ts FROM documents))),
phrase AS (SELECT query_id, doc_id, count(*) AS n FROM pd JOIN pq USING (run) GROUP BY query_id, doc_id)
"""


def docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"SELECT doc_id, len(ts)::BIGINT AS n_tokens, len(list_distinct(ts))::BIGINT AS n_distinct FROM (SELECT doc_id, {TOKENS} AS ts FROM documents)")
def tokens_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = T.tokens(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(ts).cast("long").alias("n_tokens"), F.size(F.array_distinct(ts)).cast("long").alias("n_distinct"))


@query(r"SELECT doc_id, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, floor(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) * 1.15::DOUBLE)) END::BIGINT AS n_tokens FROM documents")
def approx_token_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.approx_tokens(F.col("text")).alias("n_tokens"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY term")
def term_stats(spark, sf_dir):
    return retrieval.postings(docs(spark, sf_dir)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM bm25 WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return retrieval.bm25(docs(spark, sf_dir), questions(spark, sf_dir)).select("query_id", "doc_id", "score", "rank")


@query(f"""WITH {BM25}, mm AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc
  WHERE matched >= CASE WHEN n_terms <= 2 THEN n_terms ELSE floor(n_terms * 0.7) END) SELECT * FROM mm WHERE rank <= 10""")
def bm25_min_match(spark, sf_dir):
    return retrieval.bm25(docs(spark, sf_dir), questions(spark, sf_dir), min_match=True).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {PHRASE} SELECT query_id, doc_id, n FROM phrase")
def exact_phrase(spark, sf_dir):
    return retrieval.phrase(docs(spark, sf_dir), questions(spark, sf_dir), 8)


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""")
def dense_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return retrieval.dense(v, v.where("vec_id % 50 = 0"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id WHERE v.label IN (1, 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 5""")
def dense_filtered(spark, sf_dir):
    """The filter runs inside the search, before any ranking."""
    v = table(spark, sf_dir, "embeddings")
    return retrieval.dense(v, v.where("vec_id % 50 = 0"), 5, F.col("label").isin(1, 3))


def legs(spark, sf_dir) -> DataFrame:
    """Two legs of hits: BM25 and exact phrases."""
    d, q = docs(spark, sf_dir), questions(spark, sf_dir)
    lexical = retrieval.bm25(d, q, 20).select("query_id", F.lit("bm25").alias("leg"), "doc_id", "rank")
    exact = retrieval.top(retrieval.phrase(d, q, 8), 20, "n").select("query_id", F.lit("exact").alias("leg"), "doc_id", "rank")
    return lexical.unionByName(exact)


LEGS = f"""{BM25}, {PHRASE}, legs AS (SELECT query_id, 'bm25' AS leg, doc_id, rank FROM bm25 WHERE rank <= 20 UNION ALL
SELECT * FROM (SELECT query_id, 'exact' AS leg, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id) AS rank FROM phrase) WHERE rank <= 20)"""
FUSED = """fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, doc_id) AS rank FROM
(SELECT query_id, doc_id, round(sum({w} / (60 + rank)), 9) AS score, min(rank) AS best_rank, count(*) AS n_legs FROM legs GROUP BY query_id, doc_id))"""


@query(f"WITH {LEGS}, {FUSED.format(w='1.0')} SELECT * FROM fused")
def rrf_fused(spark, sf_dir):
    return retrieval.rrf(legs(spark, sf_dir))


@query(f"WITH {LEGS}, {FUSED.format(w=chr(40) + 'CASE WHEN leg = ' + chr(39) + 'exact' + chr(39) + ' THEN 2.0 ELSE 1.0 END)')} SELECT * FROM fused")
def rrf_weighted(spark, sf_dir):
    return retrieval.rrf(legs(spark, sf_dir), weights={"exact": 2.0})


@query(f"WITH {LEGS} SELECT leg, count(*) AS n_unique FROM (SELECT query_id, doc_id, min(leg) AS leg FROM legs GROUP BY ALL HAVING count(DISTINCT leg) = 1) GROUP BY leg")
def leg_contribution(spark, sf_dir):
    return retrieval.contribution(legs(spark, sf_dir))


def meta(spark, sf_dir) -> DataFrame:
    """Document metadata derived from the tables: dates, authority (labelled quality), supersession."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("authority"))
    d = docs(spark, sf_dir).select("doc_id", "source", "lang", F.date_add(F.lit("2022-01-01").cast("date"), F.pmod("n_chars", F.lit(900)).cast("int")).alias("publication_date"), (F.pmod("doc_id", F.lit(7)) == 3).alias("is_superseded"))
    return d.join(labels, "doc_id", "left").withColumn("effective_from", F.lit(None).cast("date"))


@query(f"""WITH {LEGS}, {FUSED.format(w='1.0')}, lb AS (SELECT doc_id, max(quality)::DOUBLE AS authority FROM labels GROUP BY doc_id),
m AS (SELECT d.doc_id, DATE '2022-01-01' + (n_chars % 900)::INT AS day, d.doc_id % 7 = 3 AS old, authority FROM documents d LEFT JOIN lb USING (doc_id)),
s AS (SELECT query_id, doc_id, score, round(score * (1 + 0.15 * least(1, greatest(0, coalesce(authority, 0))) + 0.1 * pow(0.5, greatest(0, date_diff('day', day, DATE '2024-06-01')) / 730)) * CASE WHEN old THEN 0.25 ELSE 1 END, 9) AS prior_score FROM fused JOIN m USING (doc_id))
SELECT query_id, doc_id, prior_score, row_number() OVER (PARTITION BY query_id ORDER BY prior_score DESC, doc_id) AS prior_rank FROM s""")
def priors_ranked(spark, sf_dir):
    fused = retrieval.rrf(legs(spark, sf_dir)).join(meta(spark, sf_dir), "doc_id")
    return retrieval.priors(fused, "2024-06-01").select("query_id", "doc_id", "prior_score", "prior_rank")


@query(f"""WITH {BM25}, hits AS (SELECT query_id, source AS parent_id, row_number() OVER (PARTITION BY query_id ORDER BY sum(score) DESC, source) AS rank FROM (SELECT * FROM bm25 WHERE rank <= 10) JOIN documents USING (doc_id) GROUP BY query_id, source),
k AS (SELECT query_id, parent_id, doc_id, h.rank AS pr, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY doc_id) AS n FROM hits h JOIN documents d ON d.source = h.parent_id WHERE h.rank <= 5)
SELECT query_id, parent_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY pr, n) AS rank FROM k WHERE n <= 3""")
def parent_projection(spark, sf_dir):
    """The best sources of each question, and three documents of each."""
    d = docs(spark, sf_dir)
    hits = retrieval.bm25(d, questions(spark, sf_dir)).join(d.select("doc_id", "source"), "doc_id").groupBy("query_id", "source").agg(F.sum("score").alias("score"))
    parents = retrieval.top(hits, 5, key="source").withColumnRenamed("source", "parent_id")
    return retrieval.children(parents, d.select("doc_id", F.col("source").alias("parent_id")))


@query(f"WITH {BM25}, x AS (SELECT query_id, doc_id, source, rank, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM bm25 JOIN documents USING (doc_id) WHERE rank <= 50) SELECT query_id, doc_id, source, rank FROM x WHERE n <= 3")
def doc_cap(spark, sf_dir):
    """At most three hits a source, in rank order."""
    d = docs(spark, sf_dir)
    hits = retrieval.bm25(d, questions(spark, sf_dir), 50).join(d.select("doc_id", "source"), "doc_id")
    n = F.row_number().over(W.partitionBy("query_id", "source").orderBy("rank"))
    return hits.withColumn("n", n).where("n <= 3").select("query_id", "doc_id", "source", "rank")


@query(f"""WITH {BM25}, x AS (SELECT query_id, doc_id, rank, len(ts) AS n_tokens, sum(len(ts)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM bm25 JOIN d USING (doc_id) WHERE rank <= 8)
SELECT query_id, doc_id, rank, n_tokens::BIGINT AS n_tokens, used::BIGINT AS used FROM x WHERE used <= 6000""")
def budget_prefix(spark, sf_dir):
    """Hits in rank order while eight blocks and 6000 tokens last."""
    d = docs(spark, sf_dir).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))
    hits = retrieval.bm25(docs(spark, sf_dir), questions(spark, sf_dir), 8).join(d, "doc_id")
    used = F.sum("n_tokens").over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return hits.withColumn("used", used).where("used <= 6000").select("query_id", "doc_id", "rank", "n_tokens", "used")


@query(f"""WITH {BM25}, c AS (SELECT query_id, doc_id, rank, n_terms, matched / n_terms AS coverage, n AS supporting FROM
 (SELECT b.query_id, b.doc_id, b.rank, s.n_terms, s.matched, count(*) FILTER (b.score >= 20) OVER (PARTITION BY b.query_id) AS n FROM bm25 b JOIN sc s USING (query_id, doc_id) WHERE b.rank <= 10))
SELECT query_id, max(round(coverage, 6)) AS coverage, max(supporting) AS supporting, CASE WHEN max(supporting) < 1 THEN 'weak' WHEN max(coverage) < 0.6 THEN 'incomplete' ELSE 'sufficient' END AS verdict FROM c GROUP BY query_id""")
def evidence_gate(spark, sf_dir):
    """Whether the best ten hits support an answer: enough score, then enough of the question's terms in one of them."""
    hits = retrieval.bm25(docs(spark, sf_dir), questions(spark, sf_dir)).withColumn("coverage", F.col("matched") / F.col("n_terms"))
    by = hits.groupBy("query_id").agg(F.max(F.round("coverage", 6)).alias("coverage"), F.max("coverage").alias("exact"), F.count_if(F.col("score") >= 20).alias("supporting"))
    return by.select("query_id", "coverage", "supporting", F.when(F.col("supporting") < 1, "weak").when(F.col("exact") < 0.6, "incomplete").otherwise("sufficient").alias("verdict"))


@query(f"""WITH {BM25}, pool AS (SELECT query_id, doc_id, score, rank FROM bm25 WHERE rank <= 24),
t AS (SELECT pool.query_id, pool.doc_id, pool.score, p.term FROM pool JOIN qt USING (query_id) JOIN p ON p.doc_id = pool.doc_id AND p.term = qt.term),
n AS (SELECT query_id, count(*) AS pool_n FROM pool GROUP BY query_id), tdf AS (SELECT query_id, term, count(*) AS df FROM t GROUP BY ALL),
w AS (SELECT qt.query_id, qt.term, ln(1 + pool_n / (1 + coalesce(df, 0))) AS idf FROM qt JOIN n USING (query_id) LEFT JOIN tdf USING (query_id, term)),
tot AS (SELECT query_id, sum(idf) AS total FROM w GROUP BY query_id),
s AS (SELECT t.query_id, t.doc_id, round(sum(idf) / max(total) + 0.05 * max(t.score), 6) AS rerank_score FROM t JOIN w USING (query_id, term) JOIN tot ON tot.query_id = t.query_id GROUP BY t.query_id, t.doc_id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id) AS rerank FROM s""")
def lexical_rerank(spark, sf_dir):
    """The best 24 by the share of the question's weight, with weights counted inside the pool."""
    d, q = docs(spark, sf_dir), questions(spark, sf_dir)
    qt = retrieval.query_terms(q)
    pool = retrieval.bm25(d, q, 24).select("query_id", "doc_id", "score")
    # only documents of the pool are read again, and their tokens meet their own questions
    words = d.join(pool.select("doc_id").distinct(), "doc_id").select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("ts"))
    asked = qt.groupBy("query_id").agg(F.collect_list("term").alias("asked"))
    there = pool.join(words, "doc_id").join(asked, "query_id").select("query_id", "doc_id", "score", F.explode(F.array_intersect("asked", "ts")).alias("term"))
    sizes = pool.groupBy("query_id").agg(F.count(F.lit(1)).alias("pool_n"))
    df = there.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
    weights = qt.join(sizes, "query_id").join(df, ["query_id", "term"], "left").select("query_id", "term", F.log1p(F.col("pool_n") / (1 + F.coalesce("df", F.lit(0)))).alias("idf"))
    total = weights.groupBy("query_id").agg(F.sum("idf").alias("total"))
    scored = there.join(weights, ["query_id", "term"]).join(total, "query_id").groupBy("query_id", "doc_id").agg(F.round(F.sum("idf") / F.max("total") + 0.05 * F.max("score"), 6).alias("rerank_score"))
    return scored.withColumn("rerank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "doc_id")))


METRICS = f"""{BM25}, {PHRASE}, gold AS (SELECT query_id, doc_id, CASE WHEN n > 1 THEN 2 ELSE 1 END AS grade FROM phrase),
gi AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS i FROM gold),
ideal AS (SELECT query_id, count(*) AS n_rel, sum((pow(2, grade) - 1) / (ln(i + 1) / ln(2))) FILTER (i <= 10) AS best FROM gi GROUP BY query_id),
f AS (SELECT query_id, count(*) AS n, min(rank) AS first, sum((pow(2, grade) - 1) / (ln(rank + 1) / ln(2))) AS got FROM bm25 JOIN gold USING (query_id, doc_id) WHERE rank <= 10 GROUP BY query_id),
m AS (SELECT b.item_id AS query_id, round(CASE WHEN n_rel IS NULL THEN 1 ELSE coalesce(n, 0) / n_rel END, 6) AS recall, round(coalesce(n, 0) / 10, 6) AS precision,
 round(coalesce(1 / first, 0), 6) AS rr, round(CASE WHEN n_rel IS NULL THEN 1 ELSE coalesce(got, 0) / best END, 6) AS ndcg FROM benchmark b LEFT JOIN ideal i ON i.query_id = b.item_id LEFT JOIN f ON f.query_id = b.item_id)"""


def by_query(spark, sf_dir) -> DataFrame:
    d, q = docs(spark, sf_dir), questions(spark, sf_dir)
    gold = retrieval.phrase(d, q, 8).select("query_id", "doc_id", F.when(F.col("n") > 1, 2).otherwise(1).alias("grade"))
    return evals.metrics(retrieval.bm25(d, q), gold, q)


@query(f"WITH {METRICS} SELECT * FROM m")
def eval_metrics(spark, sf_dir):
    return by_query(spark, sf_dir)


@query(f"""WITH {METRICS} SELECT category, grouping(category)::INT AS is_total, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(rr), 6) AS rr, round(avg(ndcg), 6) AS ndcg
FROM (SELECT *, 'stratum' || (query_id % 4) AS category FROM m) GROUP BY GROUPING SETS ((category), ())""")
def eval_summary(spark, sf_dir):
    rows = by_query(spark, sf_dir).withColumn("category", F.concat(F.lit("stratum"), F.pmod("query_id", F.lit(4))))
    return evals.summary(rows, "category")


@query(f"""WITH {METRICS}, now AS (SELECT 'recall' AS metric, round(avg(recall), 6) AS value FROM m UNION ALL SELECT 'ndcg', round(avg(ndcg), 6) FROM m),
b AS (SELECT 'recall' AS metric, 0.9 AS baseline UNION ALL SELECT 'ndcg', 0.999 UNION ALL SELECT 'mrr', 0.5)
SELECT metric, baseline::DOUBLE AS baseline, value, value IS NULL OR value < baseline - 0.02 AS failed FROM b LEFT JOIN now USING (metric)""")
def regression_gate(spark, sf_dir):
    rows = by_query(spark, sf_dir).agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("ndcg"), 6).alias("ndcg"))
    now = rows.unpivot([], ["recall", "ndcg"], "metric", "value")
    before = spark.createDataFrame([("recall", 0.9), ("ndcg", 0.999), ("mrr", 0.5)], "metric string, value double")
    return evals.regressions(now, before)


@query(f"""WITH {BM25}, t AS (SELECT unnest([10.0, 20.0, 30.0, 50.0, 80.0])::DOUBLE AS threshold), best AS (SELECT query_id, max(score) AS score FROM sc GROUP BY query_id)
SELECT threshold, count(*) FILTER (score >= threshold) AS answered, count(*) FILTER (score < threshold) AS refused FROM best, t GROUP BY threshold""")
def threshold_sweep(spark, sf_dir):
    """How many questions each score threshold would answer: a sort of five constants against one row a question."""
    best = retrieval.bm25(docs(spark, sf_dir), questions(spark, sf_dir), 1).select("query_id", "score", F.explode(F.array(*[F.lit(x) for x in (10.0, 20.0, 30.0, 50.0, 80.0)])).alias("threshold"))
    return best.groupBy("threshold").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("answered"), F.count_if(F.col("score") < F.col("threshold")).alias("refused"))


@query("SELECT sha256(text) AS sha, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def exact_dup_groups(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""WITH m AS (SELECT d.doc_id, d.lang, d.source, DATE '2022-01-01' + (n_chars % 900)::INT AS day FROM documents d)
SELECT doc_id, source || ' in ' || lang || ' published ' || strftime(day, '%Y-%m-%d') || CASE WHEN source <> 'src0' THEN ' from ' || source ELSE '' END AS line FROM m""")
def context_line(spark, sf_dir):
    source = F.when(F.col("source") != "src0", F.concat(F.lit(" from "), "source")).otherwise("")
    return meta(spark, sf_dir).select("doc_id", F.concat("source", F.lit(" in "), "lang", F.lit(" published "), F.date_format("publication_date", "yyyy-MM-dd"), source).alias("line"))


@query()
def html_page_blocks(spark, sf_dir):
    return html_blocks(table(spark, sf_dir, "pages"))


@query(r"""WITH b AS (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n_blocks, sum(length(trim(line)))::BIGINT AS n_chars FROM b WHERE trim(line) <> '' GROUP BY doc_id""")
def plain_blocks(spark, sf_dir):
    b = docs(spark, sf_dir).select("doc_id", F.explode(F.split(F.replace(F.col("text"), F.lit("\r"), F.lit("")), "\n")).alias("line"))
    return b.where(F.trim("line") != "").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length(F.trim("line"))).cast("long").alias("n_chars"))
