"""Benchmark decontamination [native]: a positional inverted index of the rarest test terms.

Only DataFrame functions run here. Term counts over the whole corpus pick each test window's rarest term; the index
stores the postings of those terms (document, position, neighbouring words); lists are intersected with the test
items offset by offset from the rarest term outwards, which leaves exact phrase matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table

WINDOW = 10
#: Test terms sent to every executor at once; more terms are looked up in several passes.
BROADCAST_TERMS = 500_000


def words_of(text: Column) -> Column:
    """ASCII digits and letters (lower-cased) and everything beyond ASCII; null has no words."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), ""), F.array().cast("array<string>"))


def lookups(terms: DataFrame, n: int) -> list[DataFrame]:
    """The terms in as many blocks as the broadcast bound asks for."""
    blocks = max(1, -(-n // BROADCAST_TERMS))
    return [terms] if blocks == 1 else [terms.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b) for b in range(blocks)]


def occurrences(docs: DataFrame, terms: DataFrame, n: int, *keep: str | Column) -> DataFrame:
    """Every position of the terms in the documents; ``keep`` is evaluated for these positions only."""
    spread = docs.select("*", F.posexplode("words").alias("pos", "term"))
    return reduce(DataFrame.unionAll, [spread.join(F.broadcast(b), "term").select("term", *keep) for b in lookups(terms, n)])


def equal_run(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same)).cast("int")


def phrase_matches(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """``doc, mark, item, first, last``: spans of document words that a test window covers.

    docs: ``doc, mark, words``; items: ``item, item_words``. Every occurrence of a window lies in one span at least.
    """
    each = items.select("item", "item_words", F.posexplode("item_words").alias("at", "term"))
    vocabulary = cut(each.select("term").distinct())
    n_terms = vocabulary.count()
    counts = occurrences(docs, vocabulary, n_terms).groupBy("term").agg(F.count(F.lit(1)).alias("n"))

    size = F.size("item_words")
    length = F.least(size, F.lit(window))
    # a window may occur only if each of its words does; its anchor is the rarest of them
    ranked = each.join(F.broadcast(counts) if n_terms <= BROADCAST_TERMS else counts, "term", "left").select("item", "item_words", "at", "term", F.coalesce("n", F.lit(0)).alias("n"))
    starts = F.explode(F.sequence(F.greatest(F.col("at") - length + 1, F.lit(0)), F.least(F.col("at"), size - length)))
    anchors = (
        ranked.select("*", starts.alias("start"))
        .groupBy("item", "item_words", "start")
        .agg(F.min(F.struct("n", "term", "at")).alias("rarest"))
        .where("rarest.n > 0")
        .select("item", "item_words", F.col("rarest.term").alias("term"), F.col("rarest.at").alias("at"))
        .distinct()
    )
    anchors = cut(anchors)
    rare = anchors.select("term").distinct()

    # the stored index: postings of the anchor terms, with the words around them
    reach = window - 1
    around = F.slice("words", F.greatest(F.col("pos") - reach + 1, F.lit(1)), F.least(F.col("pos"), F.lit(reach)) + 1 + reach)
    postings = cut(occurrences(docs, rare, n_terms, "doc", "mark", "pos", around.alias("near")))

    left_doc = F.reverse(F.slice("near", 1, F.least(F.col("pos"), F.lit(reach))))
    left_item = F.reverse(F.slice("item_words", F.greatest(F.col("at") - reach + 1, F.lit(1)), F.least(F.col("at"), F.lit(reach))))
    right_doc = F.slice("near", F.least(F.col("pos"), F.lit(reach)) + 2, reach)
    right_item = F.slice("item_words", F.col("at") + 2, reach)
    aligned = postings.join(anchors, "term").select("doc", "mark", "item", "pos", length.alias("need"), equal_run(left_doc, left_item).alias("before"), equal_run(right_doc, right_item).alias("after"))
    return aligned.where("before + 1 + after >= need").select("doc", "mark", "item", (F.col("pos") - F.col("before")).alias("first"), (F.col("pos") + F.col("after")).alias("last"))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Find the words of each document that lie in an occurrence of a benchmark window.

    A window is ``window`` consecutive item words; an item of fewer words (but not none) is one window. Returns
    ``key, n_words, n_hit, n_items, items_sha256, contaminated``, one row per input row. Null and empty texts have no
    words and no hits; items without words never match; repeated items count once, items with a null id hit words but
    are not counted or named. Repeated document rows get equal results; a null key stays null; empty tables work; other
    columns are not read. Texts of any length are searched whole. A very common passage costs a row per anchor and
    occurrence, never a pair of documents.
    """
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("mark"), words_of(F.col(text)).alias("words"))
    spans = phrase_matches(rows, items.select(F.col(item_key).cast("string").alias("item"), words_of(F.col(item_text)).alias("item_words")).where(F.size("item_words") > 0).distinct(), window)
    ordered = W.partitionBy("doc", "mark").orderBy("first", "last")
    so_far = F.coalesce(F.max("last").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))
    found = (
        spans.select("*", F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, so_far)).alias("fresh"))
        .groupBy("doc", "mark")
        .agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("names"))
    )
    found = found.select(F.col("doc").alias("d"), F.col("mark").alias("m"), "n_hit", "names")
    return rows.select("doc", "mark", F.size("words").cast("long").alias("n_words")).join(found, F.col("doc").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left").select(
        F.col("doc").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("names", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


WORD_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH iw AS (SELECT DISTINCT item_id, {WORD_SQL} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[s:s + least(len(w), {WINDOW}) - 1], ' ') AS phrase
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS s FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, {WORD_SQL} AS w FROM documents),
lens AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM dw),
cand AS (SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS phrase FROM pos, lens WHERE p + k - 1 <= len(w)),
occ AS (SELECT doc_id, item_id, p, k FROM cand JOIN win USING (k, phrase)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
