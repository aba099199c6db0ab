"""The one place where access is decided: a predicate over chunk columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """Who asks, as of when; an unset tenant sees nothing."""

    tenant_id: str | None
    rank: int
    groups: tuple[str, ...] = ()
    user_id: str | None = None
    as_of: str = "2024-06-01"
    include_superseded: bool = False
    narrow: dict[str, tuple] = field(default_factory=dict)


def predicate(s: Scope) -> Column:
    """Tenant, activity, rank, groups (deny wins), effective window, and narrowing filters."""
    if s.tenant_id is None:
        return F.lit(False)
    groups = F.array(*[F.lit(g) for g in (*s.groups, "*")]).cast("array<string>")
    allowed, denied = F.arrays_overlap("access_groups", groups), F.arrays_overlap("denied_groups", F.array(*[F.lit(g) for g in s.groups]).cast("array<string>"))
    if s.user_id is not None:
        allowed, denied = allowed | F.array_contains("allowed_users", s.user_id), denied | F.array_contains("denied_users", s.user_id)
    out = (F.col("tenant_id") == s.tenant_id) & F.col("is_active") & (F.col("visibility_rank") <= s.rank)
    out = out & F.coalesce(allowed, F.lit(False)) & ~F.coalesce(denied, F.lit(False))
    if not s.include_superseded:
        day = F.lit(s.as_of).cast("date")
        out = out & ~F.col("is_superseded") & (F.col("effective_from").isNull() | (F.col("effective_from") <= day)) & (F.col("effective_to").isNull() | (F.col("effective_to") >= day))
    for column, values in s.narrow.items():
        out = out & F.col(column).isin(*values)
    return out


def visible_to(chunks: DataFrame, users: DataFrame, key: str) -> DataFrame:
    """``user_id, key``: what each user of a table may see. Groups meet by equi-joins; a denied group takes a row away.

    users: ``user_id, tenant_id, rank, groups``. ``*`` is everybody's group. Only rows of a user's generation and
    collections count where the table of users names them (``generation``, ``collections``).
    """
    asks = users.select("user_id", "tenant_id", "rank", *(c for c in ("generation", "collections") if c in users.columns), F.explode(F.concat("groups", F.array(F.lit("*")))).alias("group"))
    rows = chunks.where("is_active").select("*", F.explode("access_groups").alias("group"))
    ok = F.col("visibility_rank") <= F.col("rank")
    if "generation" in users.columns:
        ok = ok & (rows["generation"] == asks["generation"])
    if "collections" in users.columns:
        ok = ok & (F.col("collections").isNull() | F.array_contains("collections", F.col("collection_id")))
    seen = rows.join(asks, ["tenant_id", "group"]).where(ok).select("user_id", key).distinct()
    denied = chunks.select(key, "tenant_id", F.explode("denied_groups").alias("group")).join(users.select("user_id", "tenant_id", F.explode("groups").alias("group")), ["tenant_id", "group"])
    return seen.join(denied.select("user_id", key).distinct(), ["user_id", key], "left_anti")


def capabilities(roles: DataFrame, granted: DataFrame) -> DataFrame:
    """``role, capability``: a role has what roles of its rank or lower are granted. Both tables hold one row a role."""
    of = granted.join(roles.withColumnRenamed("rank", "from_rank"), "role").select("capability", "from_rank")
    return roles.join(F.broadcast(of), F.col("from_rank") <= F.col("rank")).select("role", "capability").distinct()
