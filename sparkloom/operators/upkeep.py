"""Incremental maintenance, grants and roles, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(feed: DataFrame, key: str, order: list[str], deleted: str) -> DataFrame:
    """The last change of each key by ``order``, unless it deletes. Only the winner of a key is shuffled from a task."""
    last = feed.groupBy(key).agg(F.max_by(F.struct(*[c for c in feed.columns if c != key]), F.struct(*order)).alias("last"))
    return last.select(key, "last.*").where(~F.coalesce(F.col(deleted), F.lit(False)))


def reuse(rows: DataFrame, by: str) -> DataFrame:
    """``computed, reused, ratio`` by group: a hash is computed where it is met first (smallest ``place``)."""
    first = rows.groupBy("h").agg(F.min("place").alias("first"))
    new = F.count_if(F.col("place") == F.col("first"))
    out = rows.join(first, "h").groupBy(by).agg(new.alias("computed"), F.count(F.lit(1)).alias("n"))
    return out.select(by, "computed", (F.col("n") - F.col("computed")).alias("reused"), F.round((F.col("n") - F.col("computed")) / F.col("n"), 6).alias("ratio"))


def narrowest(operators: DataFrame, grants: DataFrame, need: int) -> DataFrame:
    """The active grant of the lowest sufficient scope; ties by id."""
    best = grants.where(F.col("active") & (F.col("scope_rank") >= need)).groupBy("operator_id").agg(F.min(F.struct("scope_rank", "grant_id")).alias("g"))
    return operators.join(best, "operator_id", "left").select("operator_id", F.col("g.grant_id").alias("grant_id"), F.when(F.col("g").isNull(), "no_grant").otherwise("allowed").alias("verdict"))


def resolve_roles(users: DataFrame, groups: DataFrame, roles: DataFrame, default: str) -> DataFrame:
    best = groups.join(roles, "group").groupBy("user_id").agg(F.max(F.struct("rank", "role")).alias("r"))
    return users.join(best, "user_id", "left").select("user_id", F.coalesce("r.role", "current", F.lit(default)).alias("role"))


def in_effect(starts: DataFrame, start: str, days: int) -> DataFrame:
    """``day, n``: intervals of ``days`` and one more that hold each day. Starts are counted before they spread."""
    per = starts.groupBy(start).agg(F.count(F.lit(1)).alias("k"))
    spread = per.select("k", F.explode(F.sequence(F.col(start), F.date_add(F.col(start), days))).alias("day"))
    return spread.groupBy("day").agg(F.sum("k").alias("n"))


def heading_paths(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks with the path of headings above them: a heading ends all deeper ones before it."""
    order = W.partitionBy(key).orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    out = blocks.withColumn("l", F.when(F.col("kind") == "heading", F.col("level")))
    for depth in range(1, 7):
        # the last heading of this depth, and where the last shallower one stands
        here = F.when(F.col("l") == depth, F.struct("position", "text"))
        out = out.withColumns({f"h{depth}": F.last(here, ignorenulls=True).over(order), f"u{depth}": F.last(F.when(F.col("l") < depth, F.col("position")), ignorenulls=True).over(order)})
    parts = [F.when(F.col(f"h{d}.position") > F.coalesce(F.col(f"u{d}"), F.lit(-1)), F.col(f"h{d}.text")) for d in range(1, 7)]
    return out.withColumn("path", F.concat_ws(" > ", *parts)).select(key, "position", "kind", "level", "text", "path")
