"""Joins of a stream with a table and with another stream; both run on tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_table(stream: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """Every event with its row of a table; events without one stay."""
    return stream.join(static, key, "left")


def followed_by(first: DataFrame, then: DataFrame, key: str, minutes: int, late: str = "10 minutes") -> DataFrame:
    """``key, first_id, then_id``: events of a key that another follows within ``minutes``.

    first and then: ``key, event_id, ts``. Watermarks bound what either side must remember.
    """
    a = first.select(F.col(key).alias("k1"), F.col("event_id").alias("first_id"), F.col("ts").alias("t1")).withWatermark("t1", late)
    b = then.select(F.col(key), F.col("event_id").alias("then_id"), F.col("ts").alias("t2")).withWatermark("t2", late)
    inside = (F.col("k1") == F.col(key)) & (F.col("t2") > F.col("t1")) & (F.col("t2") <= F.col("t1") + F.expr(f"INTERVAL {minutes} MINUTES"))
    return a.join(b, inside).select(key, "first_id", "then_id")
