"""Tables that are kept up to date: content addresses, versions, bulk writes and their outcome, counts that must agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: First bytes of file kinds in hex, and the kind of a name's ending.
MAGIC = {"255044462D": "application/pdf", "504B0304": "application/zip", "89504E47": "image/png", "FFD8FF": "image/jpeg", "D0CF11E0": "application/x-ole-storage"}
ENDINGS = {"md": "text/markdown", "txt": "text/plain", "html": "text/html", "htm": "text/html", "csv": "text/csv", "json": "application/json", "pdf": "application/pdf"}
#: Answers of a bulk write that are worth another try.
RETRYABLE = [429, 502, 503, 504]


def ending(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def mime(content: Column, name: Column) -> Column:
    """By the first bytes, else by the name's ending, else unknown."""
    kind = F.lit("application/octet-stream")
    for e, k in ENDINGS.items():
        kind = F.when(ending(name) == e, k).otherwise(kind)
    for m, k in MAGIC.items():
        kind = F.when(F.startswith(content, F.unhex(F.lit(m))), k).otherwise(kind)
    return kind


def loader(kind: Column) -> Column:
    """The cheapest loader for a kind of file; none for what nothing reads."""
    return F.when(kind.isin("text/markdown"), "markdown").when(kind == "text/html", "html").when(kind.startswith("text/"), "plain").when(kind.isin("application/pdf", "image/png", "image/jpeg"), "parser")


def title_of(name: Column) -> Column:
    """A file name without folders and ending, marks as blanks."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"\.[A-Za-z0-9]+$", "")
    out = F.trim(F.regexp_replace(stem, r"[_\-]+", " "))
    return F.when(F.length(out) > 0, out).otherwise("Document")


def blob_key(digest: Column) -> Column:
    return F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def cursor(*parts: Column) -> Column:
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def action(index: Column, body: Column, update: Column) -> Column:
    """Two lines of a bulk request: what to do, and with what. An update inserts where nothing is."""
    head = F.when(update, F.to_json(F.struct(F.struct(index.cast("string").alias("_id")).alias("update")))).otherwise(F.to_json(F.struct(F.struct(index.cast("string").alias("_id")).alias("index"))))
    tail = F.when(update, F.to_json(F.struct(body.alias("doc"), F.lit(True).alias("doc_as_upsert")))).otherwise(F.to_json(body))
    return F.concat_ws("\n", head, tail)


def outcome(status: Column) -> Column:
    return F.when(status < 300, "succeeded").when(status.isin(RETRYABLE), "retryable").otherwise("permanent")


def activate(versions: DataFrame, key: str, order: str) -> DataFrame:
    """``version_no`` in order, and whether it is the active one: the last of its document."""
    w = W.partitionBy(key).orderBy(order)
    last = F.lead(order).over(w).isNull()
    return versions.withColumns({"version_no": F.row_number().over(w), "is_active": last, "superseded_by": F.lead(order).over(w)})


def reconcile(expected: DataFrame, actual: DataFrame, key: str, tolerance: float = 0.001) -> DataFrame:
    """``key, expected, actual, ok``: whether no key lacks more than the tolerated share of what is expected of it.

    A side that lacks a key has none; more than expected is no fault.
    """
    n = F.count(F.lit(1))
    both = expected.groupBy(key).agg(n.alias("expected")).join(actual.groupBy(key).agg(n.alias("actual")), key, "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select(key, zero("expected").alias("expected"), zero("actual").alias("actual"), (zero("expected") - zero("actual") <= tolerance * zero("expected")).alias("ok"))


def carried_over(new: DataFrame, old: DataFrame, by: str, position: str) -> DataFrame:
    """New rows with what to do: equal content at its place is kept, elsewhere only its place is updated, other content is computed."""
    before = old.groupBy(by).agg(F.collect_set(position).alias("__at"))
    what = F.when(F.col("__at").isNull(), "compute").when(F.array_contains("__at", F.col(position)), "keep").otherwise("move")
    return new.join(before, by, "left").withColumn("todo", what).drop("__at")


def transitions(log: DataFrame, key: str, state: str, order: list[str], allowed: list[tuple[str, str]]) -> DataFrame:
    """Steps from one state to the next that are not allowed."""
    steps = log.withColumn("before", F.lag(state).over(W.partitionBy(key).orderBy(*order))).where("before IS NOT NULL")
    return steps.where(~F.concat_ws(">", "before", state).isin([f"{a}>{b}" for a, b in allowed]))


def rate_decision(counted: DataFrame, key: str, limit: int, seconds: int) -> DataFrame:
    """``allowed`` and ``retry_after``: seconds until the oldest event of the window is out of it. ``counted`` has ``n_recent``."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    oldest = F.min(t).over(W.partitionBy(key).orderBy(t).rangeBetween(-seconds * 1_000_000, 0))
    ok = F.col("n_recent") <= limit
    return counted.withColumns({"allowed": ok, "retry_after": F.when(~ok, F.ceil((oldest + seconds * 1_000_000 - t) / 1_000_000)).otherwise(0).cast("long")})
