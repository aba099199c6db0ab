"""Queries that compare configurations, bind labels and pack vectors, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrow
from ..operators import ablation, retrieval
from ..operators.ablation import Configuration
from ..sources.tables import table
from .registry import registry
from .search import BM25, FUSED, LEGS, TOKENS, docs, legs, questions

QUERIES, SQL, query = registry()

GRID = [
    Configuration("bm25_only", ("bm25",)), Configuration("exact_only", ("exact",)), Configuration("hybrid", ("bm25", "exact")), Configuration("hybrid_exact2", ("bm25", "exact"), {"exact": 2.0}),
    Configuration("bm25_reranked", ("bm25",), rerank=True), Configuration("exact_reranked", ("exact",), rerank=True), Configuration("hybrid_reranked", ("bm25", "exact"), rerank=True),
    Configuration("hybrid_exact0", ("bm25", "exact"), {"exact": 0.0}),
]
_USE = ", ".join(f"('{c.name}', {c.rerank}, '{leg}', {c.weights.get(leg, 1.0)})" for c in GRID for leg in c.legs)
_NAMES = ", ".join(f"('{c.name}')" for c in GRID)


@query(f"""WITH {LEGS}, {FUSED.format(w='1.0')}, x AS (SELECT f.*, n FROM fused f LEFT JOIN phrase USING (query_id, doc_id))
SELECT query_id, doc_id, rank AS fused_rank, row_number() OVER (PARTITION BY query_id ORDER BY rank > 24, CASE WHEN rank <= 24 THEN n END DESC NULLS LAST, rank) AS rank FROM x""")
def reranked_head(spark, sf_dir):
    """Fused hits, the first 24 by the phrases they hold, the others behind them as they were."""
    d, q = docs(spark, sf_dir), questions(spark, sf_dir)
    scores = retrieval.phrase(d, q, 8).withColumnRenamed("n", "rerank_score")
    return ablation.head_tail(retrieval.rrf(legs(spark, sf_dir)), scores, ["query_id"]).select("query_id", "doc_id", "fused_rank", "rank")


@query(f"""WITH {LEGS}, use(config, rerank, leg, w) AS (VALUES {_USE}), names(config) AS (VALUES {_NAMES}),
fu AS (SELECT config, rerank, query_id, doc_id, score, row_number() OVER (PARTITION BY config, query_id ORDER BY score DESC, best, doc_id) AS fr FROM
 (SELECT config, rerank, query_id, doc_id, round(sum(w / (60 + rank)), 9) AS score, min(rank) AS best FROM legs JOIN use USING (leg) WHERE w > 0 GROUP BY ALL)),
sh AS (SELECT * FROM (SELECT config, query_id, doc_id, CASE WHEN rerank THEN row_number() OVER (PARTITION BY config, query_id ORDER BY fr > 24, CASE WHEN fr <= 24 THEN n END DESC NULLS LAST, fr) ELSE fr END AS rank FROM fu LEFT JOIN phrase USING (query_id, doc_id)) WHERE rank <= 10),
gold AS (SELECT query_id, doc_id, CASE WHEN n > 1 THEN 2 ELSE 1 END AS grade FROM phrase), gi AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS i FROM gold),
ideal AS (SELECT query_id, count(*) AS n_rel, sum((pow(2, grade) - 1) / (ln(i + 1) / ln(2))) FILTER (i <= 10) AS best FROM gi GROUP BY query_id),
f AS (SELECT config, query_id, count(*) AS n, min(rank) AS first, sum((pow(2, grade) - 1) / (ln(rank + 1) / ln(2))) AS got FROM sh JOIN gold USING (query_id, doc_id) GROUP BY ALL),
m AS (SELECT config, b.item_id AS query_id, round(CASE WHEN n_rel IS NULL THEN 1 ELSE coalesce(n, 0) / n_rel END, 6) AS recall, round(coalesce(n, 0) / 10, 6) AS precision, round(coalesce(1 / first, 0), 6) AS rr, round(CASE WHEN n_rel IS NULL THEN 1 ELSE coalesce(got, 0) / best END, 6) AS ndcg, first
 FROM benchmark b CROSS JOIN names LEFT JOIN ideal i ON i.query_id = b.item_id LEFT JOIN f ON f.query_id = b.item_id AND f.config = names.config),
s AS (SELECT config, round(avg((doc_id % 11 = 5)::INT), 6) AS leak, count(DISTINCT query_id) AS heard FROM sh GROUP BY config)
SELECT config, n, recall, precision, rr, ndcg, coalesce(leak, 0) AS leak, round((n - coalesce(heard, 0)) / n, 6) AS silent, first_p50, first_p95 FROM (SELECT config, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(rr), 6) AS rr, round(avg(ndcg), 6) AS ndcg,
 quantile_cont(first, 0.5)::DOUBLE AS first_p50, quantile_cont(first, 0.95)::DOUBLE AS first_p95 FROM m GROUP BY config) LEFT JOIN s USING (config)""".replace("SELECT config, b.item_id", "SELECT names.config, b.item_id"))
def ablation_grid(spark, sf_dir):
    """Eight configurations of two legs, out of one plan."""
    d, q = docs(spark, sf_dir), questions(spark, sf_dir)
    found = retrieval.phrase(d, q, 8)
    gold = found.select("query_id", "doc_id", F.when(F.col("n") > 1, 2).otherwise(1).alias("grade"))
    hits = legs(spark, sf_dir)
    hidden = hits.where("doc_id % 11 = 5").select("query_id", "doc_id").distinct()
    return ablation.grid(hits, GRID, gold, q, found.select("query_id", "doc_id", F.col("n").alias("rerank_score")), hidden)


LINES = "ch AS (SELECT doc_id AS doc, doc_id || ':' || i AS chunk_id, ls[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"
MARKED = "la AS (SELECT doc_id % 40 AS query_id, doc_id AS doc, CASE WHEN doc_id % 3 = 0 THEN 'no such marker' ELSE replace(substr(text, 5, 30), ' ', '  ') END AS contains, 1 + doc_id % 2 AS grade FROM documents WHERE doc_id % 5 = 1)"
SQUEEZED = r"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"


def marked(spark, sf_dir):
    """Lines as chunks, and labels by a piece of text, a third of them nowhere."""
    d = docs(spark, sf_dir)
    chunks = d.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("i", "text")).select("doc", F.concat("doc", F.lit(":"), F.col("i") + 1).alias("chunk_id"), "text")
    want = F.when(F.pmod("doc_id", F.lit(3)) == 0, "no such marker").otherwise(F.replace(F.substring("text", 5, 30), F.lit(" "), F.lit("  ")))
    labels = d.where("doc_id % 5 = 1").select(F.pmod("doc_id", F.lit(40)).alias("query_id"), F.col("doc_id").alias("doc"), want.alias("contains"), (1 + F.pmod("doc_id", F.lit(2))).alias("grade"))
    return ablation.resolved(labels, chunks)


@query(f"WITH {LINES}, {MARKED} SELECT query_id, chunk_id, max(grade) AS grade FROM la JOIN ch USING (doc) WHERE contains({SQUEEZED.format(x='text')}, {SQUEEZED.format(x='contains')}) GROUP BY ALL")
def labels_resolved(spark, sf_dir):
    """Chunks that labels mean."""
    return marked(spark, sf_dir)[0]


@query(f"WITH {LINES}, {MARKED} SELECT * FROM la WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.doc = la.doc AND contains({SQUEEZED.format(x='text')}, {SQUEEZED.format(x='la.contains')}))")
def labels_unresolved(spark, sf_dir):
    """Labels whose marker no chunk of their document holds."""
    return marked(spark, sf_dir)[1]


@query("SELECT vec_id, 2 * len(embedding)::BIGINT AS n_bytes, len(embedding)::BIGINT AS n, TRUE AS close FROM embeddings")
def half_vectors(spark, sf_dir):
    """Vectors as half floats and back: two bytes a number, each within half a unit of its last place."""
    v = table(spark, sf_dir, "embeddings").withColumn("raw", arrow.half_bytes(F.col("embedding")))
    back = v.withColumn("back", arrow.half_vector(F.col("raw")))
    near = F.forall(F.arrays_zip("embedding", "back"), lambda x: F.abs(x["embedding"] - x["back"]) <= F.abs(x["embedding"]) / 2048 + F.lit(3e-8))
    return back.select("vec_id", F.length("raw").cast("long").alias("n_bytes"), F.size("back").cast("long").alias("n"), near.alias("close"))


PARTS = f"""pa AS (SELECT item_id, unnest(range(0, len(ps))) AS part, unnest(ps) AS text FROM (SELECT item_id, string_split(text, '. ') AS ps FROM benchmark))"""
_BY_PART = BM25.replace(f"q AS (SELECT item_id AS query_id, list_distinct({TOKENS}) AS ts FROM benchmark)", f"q AS (SELECT item_id || ':' || part AS query_id, list_distinct({TOKENS}) AS ts FROM pa)")


@query(f"""WITH {PARTS}, {_BY_PART}, l AS (SELECT split_part(query_id, ':', 1)::BIGINT AS query_id, split_part(query_id, ':', 2) AS part, doc_id, rank FROM bm25 WHERE rank <= 20),
f AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 9) AS score, min(rank) AS best_rank, count(DISTINCT part) AS n_parts FROM l GROUP BY ALL)
SELECT query_id, doc_id, score, n_parts, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, doc_id) AS rank FROM f) WHERE rank <= 20""")
def subquery_fusion(spark, sf_dir):
    """Questions in parts, each part searched for itself, all lists fused."""
    parts = questions(spark, sf_dir).select("query_id", F.posexplode(F.split("text", r"\. ")).alias("part", "text"))
    asked = parts.select(F.concat_ws(":", "query_id", "part").alias("query_id"), "text")
    found = retrieval.bm25(docs(spark, sf_dir), asked, 20).withColumns({"part": F.substring_index("query_id", ":", -1), "query_id": F.substring_index("query_id", ":", 1).cast("long"), "leg": F.lit("bm25")})
    return retrieval.rrf_parts(found).where("rank <= 20").select("query_id", "doc_id", "score", "n_parts", "rank")
