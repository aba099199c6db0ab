"""Retrieval metrics and regression gates as aggregates over run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def metrics(run: DataFrame, gold: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, recall, precision, rr, ndcg`` at ``k``. Without relevant documents recall and nDCG are 1.

    run: ``query_id, doc_id, rank``; gold: ``query_id, doc_id, grade``; queries: ``query_id``.
    """
    rel = gold.where("grade > 0")
    ideal = rel.withColumn("i", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")))
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / (F.ln(F.coalesce(F.col("i"), F.lit(1)) + 1) / F.ln(F.lit(2.0)))
    ideal = ideal.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"), F.sum(F.when(F.col("i") <= k, gain)).alias("best"))
    found = run.where(F.col("rank") <= k).join(rel, ["query_id", "doc_id"]).withColumn("i", F.col("rank"))
    found = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"), F.sum(gain).alias("got"))
    rows = queries.select("query_id").join(ideal, "query_id", "left").join(found, "query_id", "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select(
        "query_id",
        F.round(F.when(F.col("n_rel").isNull(), 1.0).otherwise(n / F.col("n_rel")), 6).alias("recall"),
        F.round(n / k, 6).alias("precision"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"),
        F.round(F.when(F.col("n_rel").isNull(), 1.0).otherwise(F.coalesce("got", F.lit(0.0)) / F.col("best")), 6).alias("ndcg"),
    )


def summary(by_query: DataFrame, category: str) -> DataFrame:
    """Means over all queries and by category in one pass."""
    means = [F.round(F.avg(c), 6).alias(c) for c in ("recall", "precision", "rr", "ndcg")]
    return by_query.groupingSets([[category], []], category).agg(F.grouping(category).cast("int").alias("is_total"), F.count(F.lit(1)).alias("n"), *means)


def regressions(now: DataFrame, before: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """``metric, value, baseline, failed``: a drop beyond the tolerance, or a metric that is gone, fails."""
    rows = before.select("metric", F.col("value").alias("baseline")).join(now.select("metric", "value"), "metric", "left")
    return rows.withColumn("failed", F.col("value").isNull() | (F.col("value") < F.col("baseline") - tolerance))
