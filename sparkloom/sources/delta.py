"""A feed of changes as a stream: cursor tokens as offsets, tombstones, a table kept up to date, access from folders."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.upkeep import latest
from .shared import written

CHANGES = "seq bigint, id string, parent_id string, name string, folder boolean, deleted boolean, shared boolean, modified timestamp, permissions string"
PAGE = re.compile(r"page-(\d+)\.json")
#: Fixed value: roles that let somebody read.
READ = ["read", "write", "owner", "sp.read", "sp.write", "sp.full control"]
IDENTITY = "struct<group:struct<id:string>,siteGroup:struct<id:string>,user:struct<id:string>,siteUser:struct<id:string>>"
PERMISSIONS = f"array<struct<roles:array<string>,link:struct<scope:string>,grantedToIdentitiesV2:array<{IDENTITY}>,grantedToV2:{IDENTITY},grantedTo:{IDENTITY}>>"


class _Pages(InputPartition):
    def __init__(self, page: int):
        self.page = page


class _Reader(DataSourceStreamReader):
    """Pages ``page-<token>.json`` (one change a line) of a folder that the driver and all executors can read."""

    def __init__(self, folder: str):
        self.folder = folder

    def tokens(self) -> list[int]:
        return sorted(int(m[1]) for m in map(PAGE.fullmatch, os.listdir(self.folder)) if m)

    def initialOffset(self) -> dict:
        return {"token": 0}

    def latestOffset(self) -> dict:
        return {"token": max(self.tokens(), default=0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Pages(p) for p in self.tokens() if start["token"] < p <= end["token"]]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        from datetime import datetime

        name = next(n for n in os.listdir(self.folder) if (m := PAGE.fullmatch(n)) and int(m[1]) == partition.page)
        with open(os.path.join(self.folder, name), encoding="utf-8") as lines:
            for line in lines:
                if line.strip():
                    x = json.loads(line)
                    modified = datetime.fromisoformat(x["modified"]) if x.get("modified") else None
                    shared = x.get("permissions")
                    yield x["seq"], x["id"], x.get("parent_id"), x.get("name"), bool(x.get("folder")), bool(x.get("deleted")), bool(x.get("shared")), modified, None if shared is None else json.dumps(shared)


class DeltaFeed(DataSource):
    """``spark.readStream.format("delta_feed").load(folder)``: a restart goes on behind the token of its checkpoint."""

    @classmethod
    def name(cls) -> str:
        return "delta_feed"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"])


def changes(spark: SparkSession, folder: str, late: str = "1 day") -> DataFrame:
    """The feed as a stream; a change that is sent again within ``late`` comes once."""
    spark.dataSource.register(DeltaFeed)
    feed = spark.readStream.format("delta_feed").load(folder)
    return feed.withWatermark("modified", late).dropDuplicatesWithinWatermark(["id", "seq"])


def _versions(spark: SparkSession, folder: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    done = [p.getName() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n[2:]) for n in done if re.fullmatch(r"v=\d+", n))


def upserts(folder: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch writes the next version of a table of the last change of every id.

    A version is named after its batch and made of the one before it, so a batch that runs again writes the same
    version again. Tombstones stay in the table, so an older change that comes later brings nothing back.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, folder) if v < number]
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{folder}/v={before[-1]}")) if before else batch
        last = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), "seq").alias("x")).select("id", "x.*")
        last.select(batch.columns).write.mode("overwrite").parquet(f"{folder}/v={number}")

    return upsert


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The items of the newest version that are not deleted."""
    return latest(spark.read.parquet(f"{folder}/v={_versions(spark, folder)[-1]}"), "id", ["seq"], "deleted")


def permissions(text: Column) -> Column:
    """``groups, users, tenant_wide, anonymous`` of a JSON list of permissions; a list that cannot be read is null.

    Entries whose roles don't let anybody read don't count. A link for everybody is anonymous and tenant-wide, one for
    the organization tenant-wide; other entries name groups, or else users, each once in order.
    """
    entries = F.filter(F.from_json(text, PERMISSIONS), lambda p: p["roles"].isNull() | (F.size(p["roles"]) == 0) | F.exists(F.coalesce(p["roles"], F.array().cast("array<string>")), lambda r: F.lower(r).isin(READ)))
    scope = lambda p: F.lower(F.coalesce(p["link"]["scope"], F.lit("")))
    named = F.filter(entries, lambda p: ~scope(p).isin("anonymous", "organization"))
    none = F.array().cast(f"array<{IDENTITY}>")
    who = F.flatten(F.transform(named, lambda p: F.concat(F.coalesce(p["grantedToIdentitiesV2"], none), F.filter(F.array(p["grantedToV2"], p["grantedTo"]), lambda x: x.isNotNull()))))
    group = lambda x: F.coalesce(x["group"]["id"], x["siteGroup"]["id"])
    user = lambda x: F.coalesce(x["user"]["id"], x["siteUser"]["id"])
    return F.when(entries.isNotNull(), F.struct(
        F.array_distinct(F.array_compact(F.transform(who, group))).alias("groups"),
        F.array_distinct(F.array_compact(F.transform(who, lambda x: F.when(group(x).isNull(), user(x))))).alias("users"),
        F.exists(entries, lambda p: scope(p).isin("anonymous", "organization")).alias("tenant_wide"),
        F.exists(entries, lambda p: scope(p) == "anonymous").alias("anonymous"),
    ))


def inherited(nodes: DataFrame) -> DataFrame:
    """``id, holder, n_up``: the nearest of an item and its folders that has permissions of its own.

    nodes: ``id, parent_id, own`` (boolean; null is no). ``holder`` is null where nobody up the tree has any, or where
    the folders form a cycle: such an item must not be indexed. Pointers double each round, so a tree of depth n takes
    about log2(n) rounds, each written to the shared folder; one row an id is expected.
    """
    own = F.coalesce("own", F.lit(False))
    at = written(nodes.select("id", F.when(own, F.col("id")).otherwise(F.col("parent_id")).alias("at"), F.when(own, 0).otherwise(1).cast("long").alias("n"), own.alias("found")))
    left = at.where("NOT found AND at IS NOT NULL").count()
    while left:
        on = at.select(F.col("id").alias("__id"), F.col("at").alias("__at"), F.col("n").alias("__n"), F.col("found").alias("__found"))
        # a folder that is not in the table ends the search: its item has nobody above
        moved = at.where("NOT found AND at IS NOT NULL").join(on, F.col("at") == F.col("__id"), "left").select("id", F.col("__at").alias("at"), (F.col("n") + F.coalesce("__n", F.lit(0))).alias("n"), F.coalesce("__found", F.lit(False)).alias("found"))
        at = written(at.where("found OR at IS NULL").unionByName(moved))
        before, left = left, at.where("NOT found AND at IS NOT NULL").count()
        if left == before:  # every open chain with an end gets one node closer to it in each round
            break
    return at.select("id", F.when(F.col("found"), F.col("at")).alias("holder"), F.when(F.col("found"), F.col("n")).alias("n_up"))
