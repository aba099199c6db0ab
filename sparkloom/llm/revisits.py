"""WARC: resolve not-modified revisits to the full response they stand for.

An as-of join by canonical URL finds the latest earlier full response. A URL's captures are cut into time buckets: the
last response inside a revisit's own bucket comes from a window over that bucket, the last one before it from a window
over one row a bucket, so that no task holds all captures of a common URL. Payloads are never moved, only their digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: Header fields that a not-modified answer may renew: fixed values.
RENEWED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def canonical_url(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without a last slash, sorted query without tracking fields; null stays null."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"#[\s\S]*$", "")
    host = F.regexp_replace(ascii_lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    fields = F.filter(F.split(F.regexp_extract(rest, r"\?([\s\S]*)$", 1), "&"), lambda x: (x != "") & ~x.startswith("utm_") & ~x.startswith("ref="))
    query = F.array_join(F.array_sort(fields), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def resolve_revisits(records: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Resolve every revisit of ``record_id, url, at, kind, headers, digest`` records.

    ``at`` is epoch seconds, ``kind`` is ``response`` or ``revisit``, ``headers`` maps lower-case field names, ``digest``
    names a response's payload. Returns a row per revisit: ``record_id, canonical_url, status, response_id, digest,
    headers``. The response is the latest of the URL by (at, record_id) before the revisit's own. ``status`` is
    ``resolved`` if the entity tags (weakly compared) agree, or without a tag on either side the modification dates;
    ``changed`` if they differ; ``unchecked`` if no validator is on both sides; ``missing`` without an earlier response.
    Only resolved rows carry the digest and the merged headers: the response's, with the permitted fields of the
    revisit on top. Null URLs, times or kinds have no partner: such revisits are ``missing``. Repeated records stay,
    each resolved alike; an empty table gives an empty result; other columns are not read.
    """
    rows = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "at", F.coalesce("kind", F.lit("")).alias("kind"),
        F.floor(F.col("at") / bucket_seconds).alias("bucket"), F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "digest",
    )
    whole = F.when((F.col("kind") == "response") & F.col("at").isNotNull() & F.col("canonical_url").isNotNull(), F.struct("record_id", "headers", "digest"))
    rows = rows.withColumn("whole", whole)
    order = W.partitionBy("canonical_url", "bucket").orderBy("at", "record_id").rowsBetween(W.unboundedPreceding, -1)
    usable = rows.where("kind IN ('response', 'revisit') AND at IS NOT NULL AND canonical_url IS NOT NULL")
    near = usable.withColumn("near", F.last("whole", ignorenulls=True).over(order)).where("kind = 'revisit'")
    last = usable.groupBy(F.col("canonical_url").alias("u"), F.col("bucket").alias("b")).agg(F.max_by("whole", F.when(F.col("whole").isNotNull(), F.struct("at", "record_id"))).alias("whole"))
    before = last.withColumn("far", F.last("whole", ignorenulls=True).over(W.partitionBy("u").orderBy("b").rowsBetween(W.unboundedPreceding, -1))).select("u", "b", "far")
    found = near.join(before, (F.col("canonical_url") == F.col("u")) & (F.col("bucket") == F.col("b")), "left").withColumn("found", F.coalesce("near", "far"))
    alone = rows.where("kind = 'revisit' AND (at IS NULL OR canonical_url IS NULL)").withColumn("found", F.lit(None).cast(near.schema["near"].dataType))
    all_ = found.select("record_id", "canonical_url", "headers", "found").unionByName(alone.select("record_id", "canonical_url", "headers", "found"))

    def tag(headers: str) -> Column:
        return F.regexp_replace(F.element_at(headers, "etag"), "^W/", "")

    mine, theirs = tag("headers"), tag("found.headers")
    dates = F.element_at("headers", "last-modified"), F.element_at("found.headers", "last-modified")
    status = (
        F.when(F.col("found").isNull(), "missing")
        .when(mine.isNotNull() & theirs.isNotNull(), F.when(mine == theirs, "resolved").otherwise("changed"))
        .when(dates[0].isNotNull() & dates[1].isNotNull(), F.when(dates[0] == dates[1], "resolved").otherwise("changed"))
        .otherwise("unchecked")
    )
    renewed = F.map_filter("headers", lambda k, v: k.isin(RENEWED))
    merged = F.map_concat(F.map_filter("found.headers", lambda k, v: ~F.array_contains(F.map_keys(renewed), k)), renewed)
    return all_.withColumn("status", status).select(
        "record_id", "canonical_url", "status", F.col("found.record_id").alias("response_id"),
        F.when(F.col("status") == "resolved", F.col("found.digest")).alias("digest"), F.when(F.col("status") == "resolved", merged).alias("headers"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """Two captures of each page: its full response, and a revisit 500 minutes later that names what was seen first."""
    at = F.col("page_id") * 60
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    response = F.create_map(F.lit("etag"), tag, F.lit("date"), at.cast("string"), F.lit("content-length"), F.length("html").cast("string"))
    revisit = F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("date"), (at + 30000).cast("string"), F.lit("content-length"), F.lit("0"))
    full = pages.select((F.col("page_id") * 2).alias("record_id"), "url", at.alias("at"), F.lit("response").alias("kind"), response.alias("headers"), F.sha2("html", 256).alias("digest"))
    again = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (at + 30000).alias("at"), F.lit("revisit").alias("kind"), revisit.alias("headers"), F.lit(None).cast("string").alias("digest"))
    return full.unionByName(again)


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(page_records(table(spark, sf_dir, "pages")))
    merged = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return found.select("record_id", "canonical_url", "status", "response_id", "digest", merged.alias("merged_headers"))


SQL = r"""
WITH p AS (SELECT page_id, html, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\-]*://', ''), '#.*$', '') AS rest FROM pages),
q AS (SELECT page_id, html,
  regexp_replace(translate(regexp_extract(rest, '^[^/?]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^(www|m)\.', '')
  || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_') AND NOT starts_with(x, 'ref='))), '&') AS fields FROM p),
c AS (SELECT page_id, html, base || CASE WHEN fields <> '' THEN '?' || fields ELSE '' END AS canonical_url FROM q),
seen AS (SELECT r.page_id, r.canonical_url, r.html, max(f.page_id) AS f FROM c r LEFT JOIN c f ON f.canonical_url = r.canonical_url AND f.page_id * 60 <= r.page_id * 60 + 30000 AND (f.page_id * 60 < r.page_id * 60 + 30000 OR f.page_id * 2 < r.page_id * 2 + 1) GROUP BY ALL)
SELECT s.page_id * 2 + 1 AS record_id, s.canonical_url,
  CASE WHEN md5(s.html) = md5(c.html) THEN 'resolved' ELSE 'changed' END AS status, s.f * 2 AS response_id,
  CASE WHEN md5(s.html) = md5(c.html) THEN sha256(c.html) END AS digest,
  CASE WHEN md5(s.html) = md5(c.html) THEN 'content-length=' || length(c.html) || ';date=' || (s.page_id * 60 + 30000) || ';etag=W/"' || md5(s.html) || '"' END AS merged_headers
FROM seen s JOIN c ON c.page_id = s.f
"""
