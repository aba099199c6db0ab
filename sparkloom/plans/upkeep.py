"""Queries on incremental maintenance, grants, values and costs, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, upkeep
from ..sources.pages import html_blocks
from ..sources.tables import table
from .registry import registry

QUERIES, SQL, query = registry()


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, event_id, value FROM r WHERE k = 1 AND event_type <> 'error'""")
def delta_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after a change feed: the last change of each key, unless it is a tombstone."""
    feed = table(spark, sf_dir, "events").withColumn("deleted", F.col("event_type") == "error")
    return upkeep.latest(feed, "user_id", ["ts", "event_id"], "deleted").select("user_id", "event_id", "value")


@query("""WITH l AS (SELECT source, doc_id, n, sha256(line) AS h FROM (SELECT source, doc_id, generate_subscripts(ls, 1) AS n, unnest(ls) AS line FROM (SELECT source, doc_id, string_split(text, chr(10)) AS ls FROM documents))),
f AS (SELECT h, min((doc_id, n)) AS first FROM l GROUP BY h)
SELECT source, count(*) FILTER ((doc_id, n) = first) AS computed, count(*) FILTER ((doc_id, n) <> first) AS reused, round(count(*) FILTER ((doc_id, n) <> first) / count(*), 6) AS ratio FROM l JOIN f USING (h) GROUP BY source""")
def cache_reuse(spark, sf_dir):
    """Lines whose content was met before need no new work."""
    lines = table(spark, sf_dir, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return upkeep.reuse(lines.select("source", F.sha2("line", 256).alias("h"), F.struct("doc_id", "n").alias("place")), "source")


@query("""WITH g AS (SELECT o_custkey AS operator_id, o_orderkey AS grant_id, CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 ELSE 1 END AS scope_rank, o_orderstatus <> 'F' AS active FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY operator_id ORDER BY scope_rank, grant_id) AS k FROM g WHERE active AND scope_rank >= 2)
SELECT c_custkey AS operator_id, grant_id, CASE WHEN grant_id IS NULL THEN 'no_grant' ELSE 'allowed' END AS verdict FROM customer LEFT JOIN r ON operator_id = c_custkey AND k = 1""")
def grants_narrowest(spark, sf_dir):
    """The narrowest active grant that covers the action, for every operator."""
    p = F.col("o_orderpriority")
    rank = F.when(p == "1-URGENT", 4).when(p == "2-HIGH", 3).when(p == "3-MEDIUM", 2).otherwise(1)
    grants = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("operator_id"), F.col("o_orderkey").alias("grant_id"), rank.alias("scope_rank"), (F.col("o_orderstatus") != "F").alias("active"))
    return upkeep.narrowest(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("operator_id")), grants, 2)


@query("""WITH m AS (SELECT n_nationkey, n_name AS role, n_nationkey % 5 AS rank FROM nation),
b AS (SELECT s_suppkey % 40 AS user_id, arg_max(role, (rank, role)) AS role FROM supplier JOIN m ON s_nationkey = n_nationkey WHERE rank > 0 GROUP BY 1)
SELECT u AS user_id, coalesce(role, CASE WHEN u % 3 = 0 THEN 'current' ELSE 'default' END) AS role FROM (SELECT DISTINCT s_suppkey % 40 AS u FROM supplier) LEFT JOIN b ON u = user_id""")
def role_resolution(spark, sf_dir):
    """The highest mapped role of a user's groups, else the current one, else the default."""
    groups = table(spark, sf_dir, "supplier").select(F.pmod("s_suppkey", F.lit(40)).alias("user_id"), F.col("s_nationkey").alias("group"))
    roles = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("group"), F.col("n_name").alias("role"), F.pmod("n_nationkey", F.lit(5)).alias("rank")).where("rank > 0")
    users = groups.select("user_id").distinct().withColumn("current", F.when(F.pmod("user_id", F.lit(3)) == 0, "current"))
    return upkeep.resolve_roles(users, groups, roles, "default")


@query(r"""SELECT doc_id, len(vs)::BIGINT AS n_values, array_to_string(list_sort(list_distinct(list_transform(vs, lambda v: replace(v, ',', '')))), ' ') AS distinct_values
FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*%?') AS vs FROM documents)""")
def value_extract(spark, sf_dir):
    """Numbers of a text, with thousands separators dropped."""
    vs = F.regexp_extract_all(F.col("text"), F.lit(r"([0-9]+(?:[.,][0-9]+)*%?)"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(vs).cast("long").alias("n_values"), F.array_join(F.array_sort(F.array_distinct(F.transform(vs, lambda v: F.replace(v, F.lit(","), F.lit(""))))), " ").alias("distinct_values"))


@query(r"""WITH t AS (SELECT conv_id, role, len(regexp_extract_all(text, '\S+')) AS n FROM conversations)
SELECT conv_id, sum(n) FILTER (role <> 'assistant')::BIGINT AS n_in, sum(n) FILTER (role = 'assistant')::BIGINT AS n_out, round(coalesce(sum(n) FILTER (role <> 'assistant'), 0) * 0.000003 + coalesce(sum(n) FILTER (role = 'assistant'), 0) * 0.000015, 8) AS cost FROM t GROUP BY conv_id""")
def cost_rollup(spark, sf_dir):
    n = F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1))).cast("long")
    t = table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("role") != "assistant", n).alias("i"), F.when(F.col("role") == "assistant", n).alias("o"))
    sums = t.groupBy("conv_id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return sums.withColumn("cost", F.round(F.coalesce("n_in", F.lit(0)) * F.lit(0.000003) + F.coalesce("n_out", F.lit(0)) * F.lit(0.000015), 8))


@query("""WITH d AS (SELECT DISTINCT o_orderdate::DATE AS as_of FROM orders), v AS (SELECT c_custkey, DATE '1995-01-01' + (c_custkey % 1200)::INT AS s FROM customer)
SELECT strftime(as_of, '%Y-%m-%d') AS as_of, count(c_custkey) AS n FROM d LEFT JOIN v ON s <= as_of AND s + 90 >= as_of GROUP BY as_of""")
def effective_on(spark, sf_dir):
    """How many versions are in effect on each day: intervals become days, so that the join is an equi-join."""
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("as_of")).distinct()
    start = F.date_add(F.lit("1995-01-01").cast("date"), F.pmod("c_custkey", F.lit(1200)).cast("int"))
    steps = table(spark, sf_dir, "customer").select(start.alias("s"))
    counts = upkeep.in_effect(steps, "s", 90)
    return days.join(counts, days["as_of"] == counts["day"], "left").select(F.date_format("as_of", "yyyy-MM-dd").alias("as_of"), F.coalesce("n", F.lit(0)).alias("n"))


@query()
def html_sections(spark, sf_dir):
    """Heading paths of every block of a page, and the size of each section."""
    blocks = upkeep.heading_paths(html_blocks(table(spark, sf_dir, "pages")).where("kind <> 'title'"), "page_id")
    return blocks.groupBy("page_id", "path").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(T.approx_tokens(F.col("text"))).alias("n_tokens"))


@query()
def chunks(spark, sf_dir):
    """Parents and children of every page, with their text."""
    return chunking.chunk(html_blocks(table(spark, sf_dir, "pages")), "page_id")
