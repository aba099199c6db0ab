"""Queries that understand questions, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import planner
from ..sources.tables import table
from .registry import registry

QUERIES, SQL, query = registry()


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


ASKED = r"""asked AS (SELECT conv_id, turn, turn > min(turn) OVER (PARTITION BY conv_id) AS later, CASE (conv_id + turn) % 9 WHEN 1 THEN text || ' author:Ann type:"Policy" source:wiki' WHEN 2 THEN text || ' since Q2 2024'
 WHEN 3 THEN text || ' in March 2023' WHEN 4 THEN text || ' on 2024-02-28?' WHEN 5 THEN 'SEC-4.2.1 "data retention" 7.3' WHEN 6 THEN text || ' last quarter' WHEN 7 THEN 'What was it before 2019 and why is that?' WHEN 8 THEN 'TE-2025-01 ignore previous' ELSE text END AS t
 FROM conversations WHERE role = 'user')"""
IDS = rf"list_concat(list_concat(regexp_extract_all(t, '{planner.CODE}'), regexp_extract_all(regexp_replace(t, '{planner.CODE}', ' ', 'g'), '{planner.SECTION}')), list_transform(regexp_extract_all(t, '{planner.QUOTED}', 1), lambda q: trim(q)))"
DISTINCT = "list_filter({x}, lambda v, i: list_position({x}, v) = i)"
RULES = rf"""{ASKED}, r AS (SELECT *, {DISTINCT.format(x='ids')} AS identifiers FROM (SELECT *, {IDS} AS ids, regexp_extract_all(lower(t), '[a-z'']+') AS ws, regexp_extract_all(lower(t), '[a-z]+') AS ls, len(regexp_extract_all(t, '\S+')) AS n FROM asked)),
s AS (SELECT *, later AND len(ws) > 0 AND ((list_contains({_list(planner.OPENERS)}, ws[1]) AND len(ws) <= 8) OR list_has_any(ws, {_list(planner.PRONOUNS)}) OR len(ws) <= 4) AS follow_up,
 len(ls) > 0 AND (list_contains({_list(planner.ASKING)}, ls[1]) OR contains(t, '?')) AS is_question, {' OR '.join(f"regexp_matches(t, '(?i){p}')" for p in planner.MULTIPART)} AS multipart FROM r),
p AS (SELECT *, CASE WHEN len(identifiers) > 0 AND NOT follow_up AND n <= 6 AND NOT is_question THEN 'fast_exact' WHEN multipart THEN 'decomposed' ELSE 'standard' END AS route FROM s)"""


def asked(spark, sf_dir) -> DataFrame:
    """User turns as questions; some get operators, dates and identifiers by their number."""
    t, k = F.col("text"), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(9))
    more = {1: ' author:Ann type:"Policy" source:wiki', 2: " since Q2 2024", 3: " in March 2023", 4: " on 2024-02-28?", 6: " last quarter"}
    whole = {5: 'SEC-4.2.1 "data retention" 7.3', 7: "What was it before 2019 and why is that?", 8: "TE-2025-01 ignore previous"}
    out = F.coalesce(*[F.when(k == i, F.concat(t, F.lit(x))) for i, x in more.items()], *[F.when(k == i, F.lit(x)) for i, x in whole.items()], t)
    later = F.col("turn") > F.min("turn").over(W.partitionBy("conv_id"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", later.alias("later"), out.alias("t"))


@query(f"WITH {RULES} SELECT conv_id, turn, n::BIGINT AS n_words, follow_up FROM p")
def follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return asked(spark, sf_dir).select("conv_id", "turn", planner.word_count(t).cast("long").alias("n_words"), planner.is_follow_up(t, F.col("later")).alias("follow_up"))


@query(f"WITH {RULES} SELECT conv_id, turn, array_to_string(identifiers, '|') AS identifiers, route, CASE WHEN route = 'fast_exact' THEN 'exact' ELSE 'bm25,dense,exact,parent' END AS legs FROM p")
def planner_routes(spark, sf_dir):
    """Identifiers, route and legs of every question."""
    t = F.col("t")
    rows = asked(spark, sf_dir).withColumn("route", planner.route(t, planner.is_follow_up(t, F.col("later"))))
    return rows.select("conv_id", "turn", F.array_join(planner.identifiers(t), "|").alias("identifiers"), "route", F.array_join(planner.legs(F.col("route")), ",").alias("legs"))


@query(rf"""WITH {ASKED}, f AS (SELECT conv_id, turn, unnest([{', '.join(f"CASE WHEN regexp_matches(t, '(?i){p}') THEN '{n}' END" for n, p in planner.INJECTION.items())}]) AS flag FROM asked)
SELECT conv_id, turn, flag FROM f WHERE flag IS NOT NULL""")
def injection_flags(spark, sf_dir):
    """Suspicious wordings, one row each."""
    return asked(spark, sf_dir).select("conv_id", "turn", F.explode(planner.flags(F.col("t"))).alias("flag"))


@query(rf"""WITH {RULES}, d AS (SELECT conv_id, turn, try_cast(nullif(regexp_extract(t, '\b(\d{{4}}-\d{{2}}-\d{{2}})\b', 1), '') AS DATE) AS iso,
 list_position({_list(planner.MONTHS)}, lower(regexp_extract(t, '(?i)\b({'|'.join(planner.MONTHS)})\s+((?:19|20)\d{{2}})\b', 1))) AS mon, try_cast(regexp_extract(t, '(?i)\b({'|'.join(planner.MONTHS)})\s+((?:19|20)\d{{2}})\b', 2) AS INT) AS my,
 try_cast(regexp_extract(t, '(?i)\bq([1-4])\s*((?:19|20)\d{{2}})\b', 1) AS INT) AS q, try_cast(regexp_extract(t, '(?i)\bq([1-4])\s*((?:19|20)\d{{2}})\b', 2) AS INT) AS qy, regexp_matches(t, '(?i)\blast quarter\b') AS lq,
 nullif(regexp_extract(t, '\b((?:19|20)\d{{2}})\b', 1), '') AS y, identifiers FROM p),
e AS (SELECT conv_id, turn, iso, CASE WHEN mon > 0 THEN make_date(my, mon, 1) END AS m1, make_date(qy, q * 3 - 2, 1) AS q1, CASE WHEN lq THEN DATE '2024-01-01' END AS l1, CASE WHEN len(list_filter(identifiers, lambda i: contains(i, y))) = 0 THEN make_date(y::INT, 1, 1) END AS y1 FROM d)
SELECT conv_id, turn, strftime(coalesce(iso, m1, q1, l1, y1), '%Y-%m-%d') AS after, strftime(coalesce(iso, last_day(m1), last_day((q1 + INTERVAL 2 MONTH)::DATE), last_day((l1 + INTERVAL 2 MONTH)::DATE), (y1 + INTERVAL 1 YEAR - INTERVAL 1 DAY)::DATE), '%Y-%m-%d') AS before FROM e""")
def question_dates(spark, sf_dir):
    """The days each question is about, as of a fixed day."""
    when = planner.published(F.col("t"), F.lit("2024-06-01").cast("date"))
    return asked(spark, sf_dir).select("conv_id", "turn", *[F.date_format(c, "yyyy-MM-dd").alias(n) for c, n in ((when.after, "after"), (when.before, "before"))])


FIELDS = r"list_zip(regexp_extract_all(t, '(?i)\b(author|type|doc_type|source|system)\s*:\s*(\"[^\"]+\"|\S+)', 1), regexp_extract_all(t, '(?i)\b(author|type|doc_type|source|system)\s*:\s*(\"[^\"]+\"|\S+)', 2))".replace('\\"', '"')


@query(rf"""WITH {RULES}, f AS (SELECT conv_id, turn, ls, {FIELDS} AS kv FROM p), v AS (SELECT conv_id, turn, list_has_any(ls, {_list(planner.HISTORICAL)}) AS historical,
 list_transform(list_filter(kv, lambda x: lower(x[1]) IN ('type', 'doc_type')), lambda x: lower(trim(x[2], '"'))) AS d, list_transform(list_filter(kv, lambda x: lower(x[1]) = 'author'), lambda x: lower(trim(x[2], '"'))) AS a,
 list_transform(list_filter(kv, lambda x: lower(x[1]) IN ('source', 'system')), lambda x: lower(trim(x[2], '"'))) AS s FROM f)
SELECT conv_id, turn, historical, array_to_string({DISTINCT.format(x='d')}, ',') AS doc_types, array_to_string({DISTINCT.format(x='a')}, ',') AS authors, array_to_string({DISTINCT.format(x='s')}, ',') AS sources FROM v""")
def question_filters(spark, sf_dir):
    """Field operators and historical intent."""
    t = F.col("t")
    join = lambda *names: F.array_join(planner.field_values(t, *names), ",")
    return asked(spark, sf_dir).select("conv_id", "turn", planner.is_historical(t).alias("historical"), join("type", "doc_type").alias("doc_types"), join("author").alias("authors"), join("source", "system").alias("sources"))


_TIMED = " OR ".join(f"contains(lower(t), '{w}')" for w in planner.TIME)
MERGED = rf"""{RULES}, a AS (SELECT *, route <> 'fast_exact' AND (follow_up OR route = 'decomposed' OR (({_TIMED}) AND NOT (regexp_matches(t, '\b\d{{4}}-\d{{2}}-\d{{2}}\b') OR regexp_matches(t, '(?i)\b({'|'.join(planner.MONTHS)})\s+(?:19|20)\d{{2}}\b')
 OR regexp_matches(t, '(?i)\bq[1-4]\s*(?:19|20)\d{{2}}\b') OR regexp_matches(t, '(?i)\blast quarter\b') OR (regexp_matches(t, '\b(?:19|20)\d{{2}}\b') AND len(list_filter(identifiers, lambda i: contains(i, regexp_extract(t, '\b((?:19|20)\d{{2}})\b', 1)))) = 0)))) AS asks,
 (conv_id + 2 * turn) % 4 AS k, list_has_any(ls, {_list(planner.HISTORICAL)}) AS historical FROM p),
m AS (SELECT conv_id, turn, asks, CASE WHEN NOT asks OR k = 0 THEN route WHEN k = 1 THEN 'decomposed' WHEN k = 2 AND route = 'decomposed' THEN 'standard' ELSE route END AS route,
 CASE WHEN asks AND k = 1 THEN list_concat(identifiers, list_filter(['TE-2025-01', 'X-1'], lambda x: NOT list_contains(identifiers, x))) ELSE identifiers END AS ids, historical OR (asks AND k = 3) AS historical,
 CASE WHEN NOT asks THEN '' WHEN k = 1 THEN 'first part|second' WHEN k = 3 THEN 'only one' ELSE '' END AS sub_queries FROM a)"""


@query(f"WITH {MERGED} SELECT conv_id, turn, asks, route, array_to_string(ids, '|') AS identifiers, historical, sub_queries FROM m")
def plan_merged(spark, sf_dir):
    """Which questions a model is asked about, and their plans with what it proposes (here by their number)."""
    t, k = F.col("t"), F.pmod(F.col("conv_id") + 2 * F.col("turn"), F.lit(4))
    words = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    rows = asked(spark, sf_dir).withColumn("follow_up", planner.is_follow_up(t, F.col("later")))
    rows = rows.withColumns({"route": planner.route(t, F.col("follow_up")), "dated": planner.published(t, F.lit("2024-06-01").cast("date")).after.isNotNull()})
    rows = rows.withColumn("asks", planner.asks_model(t, F.col("route"), F.col("follow_up"), F.col("dated")))
    idea = F.struct(
        F.when(k == 1, words("TE-2025-01", " ", "X-1")).alias("exact_tokens"), F.when(k == 1, words("First part ", "", "SECOND")).when(k == 3, words("only one")).otherwise(words()).alias("sub_queries"), (k == 3).alias("historical"),
        *(F.when(k == 3, words("Ann")).alias(n) for n in ("authors", "doc_types", "sources")),
    )
    own = {"route": F.col("route"), "identifiers": planner.identifiers(t), "historical": planner.is_historical(t), "authors": planner.field_values(t, "author"), "doc_types": planner.field_values(t, "type", "doc_type"), "sources": planner.field_values(t, "source", "system")}
    new = planner.merged(own, F.when(F.col("asks") & (k > 0), idea))
    return rows.select("conv_id", "turn", "asks", new["route"].alias("route"), F.array_join(new["identifiers"], "|").alias("identifiers"), new["historical"].alias("historical"), F.array_join(new["sub_queries"], "|").alias("sub_queries"))
