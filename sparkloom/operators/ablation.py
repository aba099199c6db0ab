"""Configurations of search compared out of one plan, head and tail of a reranking, labels bound to chunks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import squeeze
from .evals import metrics

#: How many fused hits a reranking reads, and the constant of rank fusion.
HEAD, RRF = 24, 60


@dataclass(frozen=True)
class Configuration:
    name: str
    legs: tuple[str, ...]
    weights: dict[str, float] = field(default_factory=dict)
    rerank: bool = False


def head_tail(fused: DataFrame, scores: DataFrame, by: list[str], head: int = HEAD) -> DataFrame:
    """``fused`` with ``rank`` of the first ``head`` hits by ``rerank_score``; the tail keeps its places behind them.

    fused: ``*by, doc_id, rank``; scores: ``query_id, doc_id, rerank_score``. A hit of the head without a score comes
    after those that have one; ties keep the order of fusion. So what is among the first k is the same for any k from
    ``head`` on.
    """
    rows = fused.join(scores, ["query_id", "doc_id"], "left").withColumn("__tail", F.col("rank") > head)
    order = [F.col("__tail"), F.when(~F.col("__tail"), F.col("rerank_score")).desc_nulls_last(), F.col("rank")]
    return rows.withColumn("fused_rank", F.col("rank")).withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).drop("__tail")


def fused(hits: DataFrame, configurations: list[Configuration], k: int = RRF) -> DataFrame:
    """``config, rerank, query_id, doc_id, score, rank``: the legs' hits fused for every configuration at once.

    hits: ``query_id, leg, doc_id, rank``. Every hit meets the configurations that use its leg; they are a stated list.
    """
    rows = [(c.name, c.rerank, leg, float(c.weights.get(leg, 1.0))) for c in configurations for leg in c.legs]
    use = hits.sparkSession.createDataFrame(rows, "config string, rerank boolean, leg string, w double")
    met = hits.groupBy("query_id", "leg", "doc_id").agg(F.min("rank").alias("r")).join(F.broadcast(use), "leg").where("w > 0")
    by = met.groupBy("config", "rerank", "query_id", "doc_id").agg(F.round(F.sum(F.col("w") / (k + F.col("r"))), 9).alias("score"), F.min("r").alias("best"))
    return by.withColumn("rank", F.row_number().over(W.partitionBy("config", "query_id").orderBy(F.desc("score"), "best", "doc_id"))).drop("best")


def grid(hits: DataFrame, configurations: list[Configuration], gold: DataFrame, queries: DataFrame, scores: DataFrame, hidden: DataFrame, k: int = 10) -> DataFrame:
    """``config`` with means over all questions: recall, precision, rr, ndcg, and leak, silent, first_p50, first_p95.

    gold: ``query_id, doc_id, grade``; scores: ``query_id, doc_id, rerank_score``; hidden: ``query_id, doc_id`` that a
    question must not be shown. ``leak`` is the share of the first ``k`` hits that are hidden, ``silent`` the share of
    questions without any hit, ``first_p50`` and ``first_p95`` are percentiles of the best relevant hit's rank. All
    configurations come out of one pass over the hits, so each leg is searched once.
    """
    run = fused(hits, configurations)
    plain = run.where("NOT rerank").select("config", "query_id", "doc_id", "rank")
    shown = plain.unionByName(head_tail(run.where("rerank"), scores, ["config", "query_id"]).select("config", "query_id", "doc_id", "rank")).where(F.col("rank") <= k)
    names = F.broadcast(hits.sparkSession.createDataFrame([(c.name,) for c in configurations], "config string"))
    both = lambda df: df.crossJoin(names).withColumn("query_id", F.struct("config", "query_id")).drop("config")
    by = metrics(shown.withColumn("query_id", F.struct("config", "query_id")).drop("config"), both(gold), both(queries.select("query_id")), k)
    seen = shown.join(hidden.select("query_id", "doc_id", F.lit(1).alias("hid")), ["query_id", "doc_id"], "left").groupBy("config").agg(F.round(F.avg(F.coalesce("hid", F.lit(0))), 6).alias("leak"), F.count_distinct("query_id").alias("heard"))
    means = by.groupBy(F.col("query_id.config").alias("config")).agg(
        F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in ("recall", "precision", "rr", "ndcg")),
        *(F.percentile(F.when(F.col("rr") > 0, F.round(1 / F.col("rr"))), F.lit(p)).alias(f"first_p{int(100 * p)}") for p in (0.5, 0.95)),
    )
    out = means.join(seen, "config", "left")
    return out.select("config", "n", "recall", "precision", "rr", "ndcg", F.coalesce("leak", F.lit(0.0)).alias("leak"), F.round((F.col("n") - F.coalesce("heard", F.lit(0))) / F.col("n"), 6).alias("silent"), "first_p50", "first_p95")


def resolved(labels: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels bound to the chunks that hold their marker: ``query_id, chunk_id, grade``, and the labels that none holds.

    labels: ``query_id, doc, contains, grade``; chunks: ``chunk_id, doc, text``. Blanks and case don't count. A marker in
    several chunks makes all of them relevant; a chunk with several markers of a question gets the highest grade.
    """
    asked = labels.withColumn("__want", squeeze(F.col("contains"))).withColumn("__label", F.struct("query_id", "doc", "contains", "grade"))
    met = asked.join(chunks.select("doc", "chunk_id", squeeze(F.col("text")).alias("__text")), "doc").where(F.contains("__text", "__want"))
    found = met.groupBy("query_id", "chunk_id").agg(F.max("grade").alias("grade"))
    return found, asked.join(met.select("__label").distinct(), "__label", "left_anti").select("query_id", "doc", "contains", "grade")
