"""URL filters [native]: host-suffix and path-prefix expressions joined on short digest prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: The rules of the registered query: action, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: A rule with a longer path is refused with an error, never dropped.
MAX_RULE_PATH = 4096


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([Row(action=a, host=h, path=p) for a, h, p in rules], "action string, host string, path string")


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Replace or add ``host`` and ``path``. Null, or without ``://``: both empty.

    The host ends at the first ``/``, ``?`` or ``#`` and has A-Z lower-cased; the path ends at ``?`` or ``#``.
    """
    rest = f"substring(`{url}`, instr(`{url}`, '://') + 3)"
    known = F.expr(f"coalesce(instr(`{url}`, '://'), 0) > 0")
    empty = F.lit("")
    return df.withColumns({
        "host": F.when(known, ascii_lower(F.regexp_extract(F.expr(rest), r"^[^/?#]*", 0))).otherwise(empty),
        "path": F.when(known, F.regexp_extract(F.expr(rest), r"^[^/?#]*([^?#]*)", 1)).otherwise(empty),
    })


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", prefix_hex: int = 8) -> DataFrame:
    """Judge every URL by the longest rule that fits: ``key, host, path, rule, verdict``.

    Each URL is expanded into (host suffix + path prefix) expressions; rules and expressions meet on the first
    ``prefix_hex`` hex digits of their SHA-256, and the full digests then confirm. A rule fits its host and all
    subdomains if the path starts with the rule's. Longest rule text wins; ties go to the longer host, then to block.
    No rule: ``rule`` is null and the verdict is ``default``. Repeated rows stay repeated, a null key stays null, an
    empty table gives an empty result; other input columns are not read. Rules with a null part never fit; repeated
    rules count once. The rules are broadcast only if Spark's size estimate is under its threshold, else both sides
    are shuffled on the digest prefix and skewed prefixes are split by adaptive execution.
    """
    named = rules.select(F.col("action"), F.lower("host").alias("r_host"), F.col("path").alias("r_path")).dropna().distinct()
    lengths = sorted(r[0] for r in named.select(F.length("r_path").alias("n")).distinct().limit(MAX_RULE_PATH + 2).collect())
    if lengths and lengths[-1] > MAX_RULE_PATH:
        raise ValueError(f"a rule's path is longer than {MAX_RULE_PATH} characters")
    digest = F.sha2(F.concat("r_host", "r_path"), 256)
    named = named.select("action", F.concat("r_host", "r_path").alias("rule"), F.length("r_host").alias("r_len"), digest.alias("r_digest"), F.substring(digest, 1, prefix_hex).alias("short"))

    rows = url_parts(pages.select(F.col(key).alias("key"), F.col(url).alias("url")), "url")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    said = (
        rows.where(F.length("host") > 0)
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .select("key", "url", F.sha2(F.concat("suffix", "prefix"), 256).alias("digest"))
        .withColumn("short", F.substring("digest", 1, prefix_hex))
        .join(named, "short")
        .where(F.col("digest") == F.col("r_digest"))
        .groupBy(F.col("key").alias("k"), F.col("url").alias("u"))
        .agg(F.max(F.struct(F.length("rule").alias("n"), "r_len", (F.col("action") == "block").alias("block"), "rule", "action")).alias("best"))
    )
    return rows.join(said, F.col("key").eqNullSafe(F.col("k")) & (F.col("url") == F.col("u")), "left").select(
        F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rules_frame(spark))


SQL = """
WITH rules(action, host, path) AS (VALUES {rules}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
               row_number() OVER () AS rid FROM pages),
parts AS (SELECT rid, page_id,
  translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT p.rid, r.host || r.path AS rule, r.action,
  row_number() OVER (PARTITION BY p.rid ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.action DESC) AS k
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.rid = p.rid AND f.k = 1
""".format(rules=", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES))
