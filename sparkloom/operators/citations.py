"""Claims against the blocks they cite: verdicts, summaries, and what a stricter second pass is given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .evidence import comparable, entailment, supported, values

#: The share of a claim's words that one cited block must have, and the reasons of a refusal.
LEAST = 0.35
UNCITED, VALUE, WORDS = "no resolvable citation", "cited evidence does not contain the stated value", "cited evidence does not entail the claim"


def verdicts(claims: DataFrame, blocks: DataFrame, least: float = LEAST) -> DataFrame:
    """``answer_id, n, kind, ids, supported, reason, missing, entailment, unknown, known``: one row a sentence.

    claims: ``answer_id, n, kind, text, ids`` (cited block ids); blocks: ``answer_id, block_id, text``. A claim needs a
    citation that resolves, all of its values in the blocks it cites together, and enough of its words in one of them.
    A sentence that is no claim is supported. Each citation meets its own block in an equi-join; ids that no block of
    the answer has are ``unknown``. Null ids and texts count as none and as empty.
    """
    cited = claims.select("answer_id", "n", F.posexplode(F.array_compact(F.coalesce("ids", F.array().cast("array<string>")))).alias("at", "block_id"), F.coalesce("text", F.lit("")).alias("claim"))
    met = cited.join(blocks.select("answer_id", "block_id", F.coalesce("text", F.lit("")).alias("ground"), F.lit(True).alias("there")), ["answer_id", "block_id"], "left")
    by = met.groupBy("answer_id", "n").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("there"), F.struct("at", "ground")))), lambda x: x["ground"]), " ").alias("ground"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.struct("at", "block_id")))), lambda x: x["block_id"])).alias("unknown"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("there"), F.struct("at", "block_id")))), lambda x: x["block_id"])).alias("known"),
        F.max(F.when(F.col("there"), entailment(F.col("claim"), F.col("ground")))).alias("entailment"),
    )
    none = F.array().cast("array<string>")
    rows = claims.join(by, ["answer_id", "n"], "left").withColumns({"known": F.coalesce("known", none), "unknown": F.coalesce("unknown", none), "flat": comparable(F.coalesce("ground", F.lit("")))})
    claim = F.col("kind") == "claim"
    gone = F.when(claim & (F.size("known") > 0), F.filter(values(F.coalesce("text", F.lit(""))), lambda v: ~supported(v, F.col("flat")))).otherwise(none)
    rows = rows.withColumn("missing", gone)
    reason = F.when(~claim, F.lit(None)).when(F.size("known") == 0, UNCITED).when(F.size("missing") > 0, VALUE).when(F.col("entailment") < least, WORDS)
    return rows.withColumn("reason", reason).select("answer_id", "n", "kind", "ids", F.col("reason").isNull().alias("supported"), "reason", "missing", F.round("entailment", 6).alias("entailment"), "unknown", "known")


def summary(checked: DataFrame) -> DataFrame:
    """``answer_id, n_claims, n_unsupported, n_uncited, support, unknown, failure``: one row an answer.

    ``support`` is the share of claims that hold, 1 without claims. ``failure`` names the first fault of: unknown ids,
    claims without a citation, up to five missing values, other claims that do not hold; null where there is none.
    """
    claim = F.col("kind") == "claim"
    by = checked.groupBy("answer_id").agg(
        F.count_if(claim).alias("n_claims"), F.count_if(~F.col("supported")).alias("n_unsupported"), F.count_if(claim & (F.size("known") == 0)).alias("n_uncited"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "unknown"))), lambda x: x["unknown"]))).alias("unknown"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("missing")))).alias("missing"),
    )
    failure = (
        F.when(F.size("unknown") > 0, F.concat(F.lit("cited unknown evidence ids: "), F.array_join("unknown", ", ")))
        .when(F.col("n_uncited") > 0, F.concat("n_uncited", F.lit(" claim(s) carried no citation")))
        .when(F.size("missing") > 0, F.concat(F.lit("values not present in the cited evidence: "), F.array_join(F.slice("missing", 1, 5), ", ")))
        .when(F.col("n_unsupported") > 0, F.concat("n_unsupported", F.lit(" claim(s) were not supported by their cited evidence")))
    )
    support = F.when(F.col("n_claims") == 0, 1.0).otherwise((F.col("n_claims") - F.col("n_unsupported")) / F.col("n_claims"))
    return by.select("answer_id", "n_claims", "n_unsupported", "n_uncited", F.round(support, 6).alias("support"), "unknown", failure.alias("failure"))


def second_pass(checked: DataFrame, summaries: DataFrame, blocks: DataFrame) -> DataFrame:
    """``answer_id, block_id, pos, text``: blocks that claims which hold cite, of answers with a fault, in the order cited.

    This is all the evidence that the one stricter retry of a failed answer is given; answers without a fault have none.
    """
    failed = summaries.where("failure IS NOT NULL").select("answer_id")
    kept = checked.where("supported").join(failed, "answer_id", "left_semi").select("answer_id", "n", F.posexplode("known").alias("at", "block_id"))
    first = kept.groupBy("answer_id", "block_id").agg(F.min(F.struct("n", "at")).alias("first"))
    return first.withColumn("pos", F.row_number().over(W.partitionBy("answer_id").orderBy("first"))).join(blocks, ["answer_id", "block_id"]).select("answer_id", "block_id", "pos", "text")
