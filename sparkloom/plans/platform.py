"""Queries over conversations, events and relational tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import access, jobs
from ..sources.tables import table
from .registry import registry

QUERIES, SQL, query = registry()


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


PARTS = """c AS (SELECT c_custkey, 'tenant' || (c_nationkey % 3) AS tenant_id, c_acctbal > 0 AS is_active, 10 * (1 + c_custkey % 4) AS visibility_rank, c_mktsegment AS seg, c_custkey % 11 = 0 AS old,
 DATE '2024-01-01' + (c_custkey % 365)::INT AS day FROM customer)"""


def chunks(spark, sf_dir) -> DataFrame:
    """Customers as access-controlled rows."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("c_custkey", F.lit(365)).cast("int"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("tenant"), F.pmod("c_nationkey", F.lit(3))).alias("tenant_id"), (F.col("c_acctbal") > 0).alias("is_active"), (10 * (1 + F.pmod("c_custkey", F.lit(4)))).cast("int").alias("visibility_rank"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("*"))).otherwise(F.array("c_mktsegment")).alias("access_groups"),
        F.when(F.pmod("c_custkey", F.lit(13)) == 0, F.array(F.lit("MACHINERY"))).otherwise(F.array().cast("array<string>")).alias("denied_groups"),
        (F.pmod("c_custkey", F.lit(11)) == 0).alias("is_superseded"), day.alias("effective_from"), F.date_add(day, 90).alias("effective_to"),
        F.array().cast("array<string>").alias("allowed_users"), F.array().cast("array<string>").alias("denied_users"),
    )


@query(f"""WITH {PARTS} SELECT c_custkey, visibility_rank::INT AS visibility_rank FROM c WHERE tenant_id = 'tenant1' AND is_active AND visibility_rank <= 30 AND seg IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')
 AND NOT (c_custkey % 13 = 0) AND NOT old AND day <= DATE '2024-06-01' AND day + 90 >= DATE '2024-06-01'""")
def acl_filter(spark, sf_dir):
    scope = access.Scope("tenant1", 30, ("AUTOMOBILE", "MACHINERY"))
    return chunks(spark, sf_dir).where(access.predicate(scope)).select("c_custkey", "visibility_rank")


JOBS = """j AS (SELECT event_id AS id, 'tenant' || (user_id % 5) AS tenant_id, CASE event_type WHEN 'error' THEN 10 WHEN 'purchase' THEN 100 ELSE 500 END AS priority, ts AS run_after,
 CASE WHEN event_type = 'signup' AND event_id % 401 = 7 THEN 'running' ELSE 'queued' END AS status FROM events)"""


def job_table(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("id"), F.concat(F.lit("tenant"), F.pmod("user_id", F.lit(5))).alias("tenant_id"), F.when(kind == "error", 10).when(kind == "purchase", 100).otherwise(500).alias("priority"),
        F.col("ts").alias("run_after"), F.when((kind == "signup") & (F.pmod("event_id", F.lit(401)) == 7), "running").otherwise("queued").alias("status"),
    )


@query(f"""WITH {JOBS}, r AS (SELECT tenant_id, count(*) AS running FROM j WHERE status = 'running' GROUP BY tenant_id),
q AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY priority, run_after, id) AS rn FROM j WHERE status = 'queued')
SELECT id, q.tenant_id, priority, rn FROM q LEFT JOIN r USING (tenant_id) WHERE rn + coalesce(running, 0) <= 400 ORDER BY priority, run_after, id LIMIT 50""")
def queue_claim(spark, sf_dir):
    return jobs.claim(job_table(spark, sf_dir), 400, 50)


@query(f"WITH {JOBS} SELECT tenant_id, status, count(*) AS n, min(run_after) AS oldest FROM j GROUP BY ALL")
def queue_depth(spark, sf_dir):
    return job_table(spark, sf_dir).groupBy("tenant_id", "status").agg(F.count(F.lit(1)).alias("n"), F.min("run_after").alias("oldest"))


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n_recent FROM events")
def rate_window(spark, sf_dir):
    return jobs.rate(events(spark, sf_dir), "user_id", 3600).select("event_id", "user_id", "n_recent")


@query("""WITH s AS (SELECT user_id, ts AS t, 1 AS d FROM events UNION ALL SELECT user_id, ts + INTERVAL 30 MINUTE, -1 FROM events), g AS (SELECT user_id, t, sum(d) AS d FROM s GROUP BY ALL),
o AS (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY t) AS n FROM g) SELECT user_id, max(n)::BIGINT AS peak FROM o GROUP BY user_id""")
def concurrency_peak(spark, sf_dir):
    spans = events(spark, sf_dir).select("user_id", F.col("ts").alias("begin"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("end"))
    return jobs.peak(spans, "user_id")


@query("SELECT user_id, count(*)::INT AS n, list_reduce(list(event_type || props ORDER BY event_id), lambda h, x: sha256(h || x), '') AS head FROM events GROUP BY user_id")
def audit_chain(spark, sf_dir):
    return jobs.chain(events(spark, sf_dir).withColumn("entry", F.concat("event_type", "props")), "user_id", "entry", "event_id")


UPLOADS = """e AS (SELECT doc_id, source || ':' || (doc_id // 2) AS external_id, sha256(text) AS sha, 10 * (1 + doc_id % 4) AS rank, doc_id % 2 = 0 AS old FROM documents)"""


@query(f"""WITH {UPLOADS}, x AS (SELECT * FROM e WHERE old), s AS (SELECT sha, min(doc_id) AS m, arg_min(rank, doc_id) AS mr FROM x GROUP BY sha)
SELECT u.doc_id AS upload_id, CASE WHEN x.doc_id IS NOT NULL AND x.sha = u.sha THEN 'reuse' WHEN x.doc_id IS NOT NULL THEN 'new_version' WHEN mr > u.rank THEN 'reject' WHEN m IS NOT NULL THEN 'share_content' ELSE 'create' END AS decision,
 coalesce(x.doc_id, CASE WHEN NOT mr > u.rank THEN m END) AS document_id FROM e u LEFT JOIN x USING (external_id) LEFT JOIN s ON s.sha = u.sha WHERE NOT u.old""")
def upload_decision(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(":", "source", F.expr("doc_id div 2")).alias("external_id"), F.sha2("text", 256).alias("sha"), (10 * (1 + F.pmod("doc_id", F.lit(4)))).alias("rank"))
    old = F.pmod("doc_id", F.lit(2)) == 0
    return jobs.decide(rows.where(~old).withColumnRenamed("doc_id", "upload_id"), rows.where(old).withColumnRenamed("doc_id", "document_id"))


@query("""WITH l AS (SELECT DISTINCT source, doc_id, sha256(line) AS h FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
v AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM (SELECT DISTINCT source, doc_id FROM documents)),
n AS (SELECT v.doc_id, l.h FROM v JOIN l USING (doc_id) WHERE before IS NOT NULL), o AS (SELECT v.doc_id, l.h FROM v JOIN l ON l.doc_id = v.before)
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, count(*) FILTER (n.h IS NOT NULL AND o.h IS NOT NULL) AS kept, count(*) FILTER (o.h IS NULL) AS added, count(*) FILTER (n.h IS NULL) AS removed
FROM n FULL JOIN o ON n.doc_id = o.doc_id AND n.h = o.h GROUP BY 1""")
def chunk_diff(spark, sf_dir):
    """Each document against the one before it in its source, line by line, as sets of hashes."""
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.sha2("line", 256).alias("h")).distinct()
    before = d.select("doc_id", F.lag("doc_id").over(W.partitionBy("source").orderBy("doc_id")).alias("before")).where("before IS NOT NULL")
    new = before.join(lines, "doc_id").select("doc_id", "h", F.lit(1).alias("new"), F.lit(0).alias("old"))
    old = before.join(lines.withColumnRenamed("doc_id", "before"), "before").select("doc_id", "h", F.lit(0).alias("new"), F.lit(1).alias("old"))
    each = new.unionByName(old).groupBy("doc_id", "h").agg(F.max("new").alias("new"), F.max("old").alias("old"))
    return each.groupBy("doc_id").agg(F.count_if((F.col("new") == 1) & (F.col("old") == 1)).alias("kept"), F.count_if(F.col("old") == 0).alias("added"), F.count_if(F.col("new") == 0).alias("removed"))


@query("""SELECT doc_id, 'upload:' || substr(sha256(source || '/' || lower(lang) || doc_id), 1, 32) AS external_id, substr(sha256('t1' || chr(31) || doc_id || chr(31) || 0), 1, 32) AS chunk_id,
 substr(sha256(lang || chr(31) || 'm1'), 1, 16) AS fingerprint, (('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 8)::INT AS pool FROM documents""")
def derived_ids(spark, sf_dir):
    pool = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8), 16, 10).cast("long") % 8
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("upload:"), F.substring(F.sha2(F.concat("source", F.lit("/"), F.lower("lang"), F.col("doc_id").cast("string")), 256), 1, 32)).alias("external_id"),
        T.short_hash(F.lit("t1"), F.col("doc_id"), F.lit(0)).alias("chunk_id"), T.short_hash(F.col("lang"), F.lit("m1"), length=16).alias("fingerprint"), pool.cast("int").alias("pool"),
    )


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    from ..streaming.windows import tumbling

    return tumbling(events(spark, sf_dir))


@query("""SELECT event_type, s AS start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE,
 time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts)]) AS s FROM events) GROUP BY ALL""")
def sliding_windows(spark, sf_dir):
    from ..streaming.windows import sliding

    return sliding(events(spark, sf_dir))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    from ..streaming.windows import sessions

    return sessions(events(spark, sf_dir))
