"""Chains of versions that replace each other, by pointers that double."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def chains(relations: DataFrame) -> DataFrame:
    """``doc_id, latest, n_steps, in_cycle``: where following the replacements of each document ends.

    relations: ``doc_id, replaced_by``. A document that several replace follows the smallest; rows with a null are
    none, and a document that replaces itself is a cycle. A document that is only named as a replacement is its own
    latest, in 0 steps. Documents on a cycle, or whose chain leads into one, have ``in_cycle`` and no latest.

    Every round doubles how far the pointers reach, so a chain of n versions takes about log2(n) rounds. As long as any
    chain has an end that is not found yet, a round finds the end of one more document at least; when a round finds
    none, what is left leads into cycles. Rounds are written to the shared folder.
    """
    pairs = relations.where("doc_id IS NOT NULL AND replaced_by IS NOT NULL")
    step = pairs.groupBy("doc_id").agg(F.min("replaced_by").alias("at"))
    named = pairs.select(F.col("replaced_by").alias("doc_id")).distinct().join(step, "doc_id", "left_anti")
    at = written(step.select("doc_id", "at", F.lit(1).cast("long").alias("n"), F.lit(False).alias("ended")).unionByName(named.select("doc_id", F.col("doc_id").alias("at"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("ended"))))
    left = at.where("NOT ended").count()
    while left:
        on = at.select(F.col("doc_id").alias("__at"), F.col("at").alias("__on"), F.col("n").alias("__n"), F.col("ended").alias("__ended"))
        moved = at.where("NOT ended").join(on, F.col("at") == F.col("__at")).select("doc_id", F.col("__on").alias("at"), (F.col("n") + F.col("__n")).alias("n"), F.col("__ended").alias("ended"))
        at = written(at.where("ended").unionByName(moved))
        before, left = left, at.where("NOT ended").count()
        if left == before:
            break
    return at.select("doc_id", F.when(F.col("ended"), F.col("at")).alias("latest"), F.when(F.col("ended"), F.col("n")).alias("n_steps"), (~F.col("ended")).alias("in_cycle"))
