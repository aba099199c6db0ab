"""Queries of the analyzers, of BM25 over fields and of the identifier leg, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import analysis
from ..operators import fielded, planner, retrieval
from ..sources.tables import table
from .registry import registry
from .understanding import DISTINCT, IDS

QUERIES, SQL, query = registry()

ENGLISH = analysis.english_sql("text")


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({ENGLISH}) AS term FROM documents) WHERE term <> '' GROUP BY term")
def english_terms(spark, sf_dir):
    """Document and collection frequency of every English stem."""
    terms = table(spark, sf_dir, "documents").select("doc_id", F.explode(analysis.english_terms(F.col("text"))).alias("term"))
    return terms.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))


RUNS = r"regexp_extract_all({t}, '\p{{L}}+|\p{{N}}+')"
PARTS = DISTINCT.format(x=f"list_concat(list_concat([t], {RUNS.format(t='t')}), list_concat({RUNS.format(t='bare')}, [bare]))")


@query(f"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all({analysis.fold_sql("coalesce(text, '')")}, '\\S+'), lambda x, i: {{'i': i - 1, 't': x}}) AS l FROM documents),
t AS (SELECT doc_id, x.i AS position, x.t AS t, regexp_replace(x.t, '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS bare FROM (SELECT doc_id, unnest(l) AS x FROM w)),
p AS (SELECT doc_id, position, unnest({PARTS}) AS term FROM t WHERE regexp_matches(t, '[0-9]'))
SELECT doc_id, position::INT AS position, term FROM p WHERE term <> ''""")
def exact_code_positions(spark, sf_dir):
    """Every token with a digit and its parts, at its position in the whole text."""
    d = table(spark, sf_dir, "documents")
    # a token has a digit where one of its parts has; the others get no parts, and nothing is shuffled
    tokens = d.where(F.col("text").rlike("[0-9]")).select("doc_id", F.posexplode(analysis.exact_tokens(F.col("text"))).alias("position", "t")).where(F.col("t").rlike("[0-9]"))
    return tokens.select("doc_id", "position", F.explode(analysis.code_parts(F.col("t"))).alias("term"))


def coded(spark, sf_dir) -> DataFrame:
    """Documents, every third with a ticket number at its end."""
    ticket = F.concat(F.lit(" Ref TKT-"), F.pmod("doc_id", F.lit(11)), F.lit("-"), F.pmod("doc_id", F.lit(5)), F.lit("."))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.coalesce("text", F.lit("")), ticket)).otherwise(F.col("text")).alias("text"))


def named(spark, sf_dir) -> DataFrame:
    """The identifiers that every fiftieth document names, as questions."""
    return coded(spark, sf_dir).where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), planner.identifiers(F.coalesce("text", F.lit(""))).alias("identifiers"))


CODED = "c0 AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') || ' Ref TKT-' || (doc_id % 11) || '-' || (doc_id % 5) || '.' ELSE text END AS text FROM documents)"


@query(f"""WITH {CODED}, a AS (SELECT doc_id AS query_id, coalesce(text, '') AS t FROM c0 WHERE doc_id % 50 = 0), i AS (SELECT DISTINCT query_id, unnest({IDS}) AS identifier FROM a),
w AS (SELECT *, {RUNS.format(t=analysis.fold_sql('identifier'))} AS want FROM i), k AS (SELECT DISTINCT want FROM w WHERE len(want) > 0),
d AS (SELECT doc_id, {RUNS.format(t=analysis.fold_sql("coalesce(text, '')"))} AS ts FROM c0), spots AS (SELECT doc_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM d),
c AS (SELECT doc_id, want, count(*) AS n FROM spots JOIN k ON ts[i] = want[1] AND ts[i : i + len(want) - 1] = want GROUP BY ALL),
b AS (SELECT query_id, doc_id, count(DISTINCT identifier) AS n_identifiers, sum(n)::BIGINT AS n_places FROM w JOIN c USING (want) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_identifiers DESC, n_places DESC, doc_id) AS rank FROM b) WHERE rank <= 50""")
def exact_identifiers(spark, sf_dir):
    """Documents that name any of a question's identifiers."""
    return retrieval.identifiers_in(coded(spark, sf_dir), named(spark, sf_dir), analysis.code_runs)


def fields(spark, sf_dir) -> DataFrame:
    """Documents with the four fields: the title is the text up to its first full stop."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", "lang", F.col("text").alias("content"), F.concat("source", F.lit(" in "), "lang").alias("context_line"), F.concat("lang", F.lit(" > "), F.substring_index("text", "\n", 1)).alias("heading_path"),
        F.substring_index("text", ".", 1).alias("title"),
    )


FIELDED = f"""f AS (SELECT doc_id, lang, 'content' AS field, 1.0 AS boost, text FROM documents UNION ALL SELECT doc_id, lang, 'context_line', 0.7, source || ' in ' || lang FROM documents
 UNION ALL SELECT doc_id, lang, 'heading_path', 1.6, lang || ' > ' || split_part(text, chr(10), 1) FROM documents UNION ALL SELECT doc_id, lang, 'title', 2.0, split_part(text, '.', 1) FROM documents),
l AS (SELECT doc_id, lang, field, boost, {ENGLISH} AS ts FROM f), lt AS (SELECT doc_id, lang, field, boost, unnest(ts) AS term, unnest(range(0, len(ts))) AS pos FROM l),
dl AS (SELECT doc_id, field, count(*) AS dl FROM lt WHERE term <> '' GROUP BY ALL), st AS (SELECT field, count(*) AS n_docs, avg(dl) AS avg_dl FROM dl GROUP BY field),
ql AS (SELECT item_id AS query_id, {ENGLISH} AS ts FROM benchmark), qp AS (SELECT query_id, term, pos FROM (SELECT query_id, unnest(ts) AS term, unnest(range(0, len(ts))) AS pos FROM ql) WHERE term <> ''),
qn AS (SELECT query_id, count(DISTINCT term) AS n_terms, count(*) AS n_words FROM qp GROUP BY query_id), qt AS (SELECT query_id, term, count(*) AS times FROM qp GROUP BY ALL),
p AS (SELECT doc_id, lang, field, boost, term, count(*) AS tf FROM lt WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL),
pw AS (SELECT p.*, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf, 0.9 * (1 - 0.4 + 0.4 * dl / avg_dl) AS norm FROM p JOIN df USING (field, term) JOIN st USING (field) JOIN dl USING (doc_id, field)),
m AS (SELECT query_id, doc_id, field, boost, n_terms, n_words, count(*) AS matched, sum(idf * tf * 1.9 / (tf + norm)) AS total, sum(idf * times) AS weight, max(norm) AS norm
 FROM pw JOIN qt USING (term) JOIN qn USING (query_id) WHERE lang <> 'de' GROUP BY ALL HAVING count(*) >= CASE WHEN n_terms <= 2 THEN n_terms ELSE floor(n_terms * 0.7) END),
o AS (SELECT query_id, doc_id, field, qp.pos AS i, lt.pos - qp.pos AS a FROM m JOIN lt USING (doc_id, field) JOIN qp USING (query_id, term) WHERE matched = n_terms),
s AS (SELECT DISTINCT query_id, doc_id, field, a AS s FROM o), g AS (SELECT query_id, doc_id, field, s, i, min(a) AS a FROM s JOIN o USING (query_id, doc_id, field) WHERE a BETWEEN s AND s + 2 GROUP BY ALL),
h AS (SELECT query_id, doc_id, field, s, count(*) AS n, max(a) - s AS width FROM g GROUP BY query_id, doc_id, field, s), ph AS (SELECT query_id, doc_id, field, sum(1 / (1 + width)) AS freq FROM h JOIN qn USING (query_id) WHERE n = n_words GROUP BY ALL),
x AS (SELECT query_id, doc_id, round(max(boost * total) + 2 * max(coalesce(boost * weight * freq * 1.9 / (freq + norm), 0)), 6) AS score, max(matched) AS matched FROM m LEFT JOIN ph USING (query_id, doc_id, field) GROUP BY ALL)"""


@query(f"WITH {FIELDED} SELECT query_id, doc_id, score, matched, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x) WHERE rank <= 50")
def bm25_fields(spark, sf_dir):
    """The best 50 documents in scope by their best field and the question's phrase."""
    found = fielded.bm25_fields(fields(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), k=50, scope=F.col("lang") != "de")
    return found.select("query_id", "doc_id", "score", "matched", "rank")
