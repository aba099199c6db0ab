"""Operational tables: fair claims, rate windows, concurrency, audit chains, upload decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def claim(jobs: DataFrame, cap: int, batch: int) -> DataFrame:
    """Next jobs to run: per tenant no more than ``cap`` with those in flight, by priority, then waiting time, then id."""
    running = jobs.where("status = 'running'").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("running"))
    order = W.partitionBy("tenant_id").orderBy("priority", "run_after", "id")
    waiting = jobs.where("status = 'queued'").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= cap)
    ready = waiting.join(running, "tenant_id", "left").where(F.col("rn") + F.coalesce("running", F.lit(0)) <= cap)
    return ready.orderBy("priority", "run_after", "id").limit(batch).select("id", "tenant_id", "priority", "rn")


def rate(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """Events of the key within the last ``seconds``, this one included."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.withColumn("n_recent", F.count(F.lit(1)).over(W.partitionBy(key).orderBy(t).rangeBetween(-seconds * 1_000_000, 0)))


def peak(spans: DataFrame, key: str) -> DataFrame:
    """Most spans (``begin``, ``end``) open at once; one that ends as another begins does not overlap it."""
    steps = spans.select(key, F.col("begin").alias("t"), F.lit(1).alias("d")).unionAll(spans.select(key, F.col("end").alias("t"), F.lit(-1).alias("d")))
    steps = steps.groupBy(key, "t").agg(F.sum(F.when(F.col("d") < 0, F.col("d"))).alias("down"), F.sum(F.when(F.col("d") > 0, F.col("d"))).alias("up"))
    before = F.sum(F.coalesce("down", F.lit(0)) + F.coalesce("up", F.lit(0))).over(W.partitionBy(key).orderBy("t").rowsBetween(W.unboundedPreceding, 0))
    return steps.withColumn("open", before).groupBy(key).agg(F.max("open").alias("peak"))


def chain(log: DataFrame, key: str, body: str, order: str) -> DataFrame:
    """``key, n, head``: the last hash of each key's log, every entry hashed with the one before."""
    rows = log.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.col(body).alias("body")))).alias("xs"))
    return rows.select(key, F.size("xs").alias("n"), F.aggregate("xs", F.lit(""), lambda h, x: F.sha2(F.concat(h, x["body"]), 256)).alias("head"))


def decide(uploads: DataFrame, existing: DataFrame) -> DataFrame:
    """What an upload does: reuse, new version, reject, share content, or create, in that order.

    uploads: ``upload_id, external_id, sha, rank``; existing: ``document_id, external_id, sha, rank``.
    """
    same_id = existing.select(F.col("external_id").alias("e"), F.col("sha").alias("old_sha"), F.col("document_id").alias("old_id"))
    by_sha = existing.groupBy(F.col("sha").alias("s")).agg(F.min(F.struct("document_id", "rank")).alias("m"))
    rows = uploads.join(same_id, F.col("external_id") == F.col("e"), "left").join(by_sha, F.col("sha") == F.col("s"), "left")
    case = (
        F.when(F.col("old_id").isNotNull() & (F.col("old_sha") == F.col("sha")), "reuse")
        .when(F.col("old_id").isNotNull(), "new_version")
        .when(F.col("m.rank") > F.col("rank"), "reject")
        .when(F.col("m").isNotNull(), "share_content").otherwise("create")
    )
    return rows.select("upload_id", case.alias("decision"), F.coalesce("old_id", F.when(case == "share_content", F.col("m.document_id"))).alias("document_id"))
