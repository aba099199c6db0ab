"""From hits to an answer: what is missing, contained or repeated, what supports a claim, and what is said instead."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import jaccard, squeeze, tokens

# What counts as a value, longest forms first, what is quoted, and the numbers that are words.
VALUES = [
    r"\b\d{1,2}\s+[A-Z][a-z]+\s+\d{4}\b", r"\b\d{4}-\d{2}-\d{2}\b", r"\b[A-Z]{2,6}[-_]\d{2,}(?:[-_]\d+)*\b", r"\b\d+\.\d+(?:\.\d+)*\b", r"\b\d+(?:\.\d+)?\s*%",
    r"(?i)\b\d[\d,]*(?:\.\d+)?\s*(?:EUR|USD|GBP|€|\$|£)\b", r"(?i)\b\d+\s*(?:seconds?|minutes?|hours?|days?|weeks?|months?|years?)\b", r"\b\d{1,2}:\d{2}\b", r"\b\d[\d,]*(?:\.\d+)?\b",
]
QUOTED = '["“]([^"”]{4,})["”]'
NUMBERS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12",
    "fourteen": "14", "fifteen": "15", "twenty": "20", "thirty": "30", "sixty": "60", "ninety": "90", "hundred": "100",
}


def values(text: Column) -> Column:
    """Values that an answer must not change; a longer form hides the shorter ones inside it. Quoted phrases and words of numbers count."""
    found, rest = [], text
    for pattern in VALUES:
        # a group of its own around the whole form, behind any flag
        whole = f"(?i)({pattern[4:]})" if pattern.startswith("(?i)") else f"({pattern})"
        found.append(F.transform(F.regexp_extract_all(rest, F.lit(whole), F.lit(1)), lambda v: F.trim(v)))
        rest = F.regexp_replace(rest, pattern, " ")
    found.append(F.transform(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1)), lambda v: F.trim(v)))
    named = [F.when(text.rlike(rf"(?i)\b{w}\b"), F.array(F.lit(w), F.lit(n))).otherwise(F.array().cast("array<string>")) for w, n in NUMBERS.items()]
    return F.array_distinct(F.concat(*found, *named))


def comparable(text: Column) -> Column:
    """One form for prose and table cells: single blanks, lower case, no thousands separators, digits for words."""
    flat = F.replace(squeeze(text), F.lit(","), F.lit(""))
    return reduce(lambda t, x: F.regexp_replace(t, rf"\b{x[0]}\b", x[1]), NUMBERS.items(), flat)


def supported(value: Column, ground: Column) -> Column:
    """Whether a comparable text has a value, or its digits where these are two or more."""
    digits = F.regexp_replace(value, r"[^\d.]", "")
    return F.contains(ground, comparable(value)) | ((F.length(digits) >= 2) & F.contains(ground, digits))


def missing(ids: Column, ground: Column) -> Column:
    """Identifiers of a question that no part of its evidence has."""
    return F.filter(ids, lambda i: ~F.contains(F.lower(ground), F.lower(i)))


def uncontained(hits: DataFrame, by: str = "query_id", rank: str = "rank", text: str = "text") -> DataFrame:
    """Hits whose text no better hit of their question contains. A contained text is contained in a kept one, too."""
    flat = hits.withColumn("__flat", squeeze(F.col(text)))
    better = flat.select(F.col(by).alias("__by"), F.col(rank).alias("__rank"), F.col("__flat").alias("__other"))
    inside = (F.col(by) == F.col("__by")) & (F.col("__rank") < F.col(rank)) & F.contains("__other", "__flat")
    return flat.join(better, inside, "left_anti").drop("__flat")


def unlike(hits: DataFrame, most: float, by: str = "query_id", rank: str = "rank", text: str = "text") -> DataFrame:
    """Hits that share less than ``most`` of their words (Jaccard) with every better hit of their question."""
    words = hits.withColumn("__ts", F.array_distinct(tokens(F.col(text))))
    better = words.select(F.col(by).alias("__by"), F.col(rank).alias("__rank"), F.col("__ts").alias("__other"))
    close = (F.col(by) == F.col("__by")) & (F.col("__rank") < F.col(rank)) & (jaccard(F.col("__ts"), F.col("__other")) >= most)
    return words.join(better, close, "left_anti").drop("__ts")


def first_of_parent(hits: DataFrame, by: str = "query_id", parent: str = "parent_id", rank: str = "rank") -> DataFrame:
    """``expands``: the best hit of a parent stands for it, its siblings stay as they are."""
    return hits.withColumn("expands", F.row_number().over(W.partitionBy(by, parent).orderBy(rank)) == 1)


def entailment(claim: Column, ground: Column) -> Column:
    """Share of a claim's words that its evidence has; a claim without words is entailed."""
    ts = F.array_distinct(tokens(claim))
    return F.when(F.size(ts) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(ts, tokens(ground))) / F.size(ts))


def sentences(text: Column) -> Column:
    """Sentences by their marks and line ends."""
    return F.filter(F.transform(F.split(text, r"(?:[.!?]\s+|\n)"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def extract(hits: DataFrame, questions: DataFrame, top: int = 3) -> DataFrame:
    """``query_id, pos, sentence, score``: the distinct sentences of a question's hits that share most words with it.

    Half a point for a digit, and the hit's own score; a sentence that shares no word is no answer.
    """
    asked = questions.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("asked"))
    rows = hits.select("query_id", "score", F.explode(F.array_distinct(sentences(F.col("text")))).alias("sentence")).join(asked, "query_id")
    shared = F.size(F.array_intersect("asked", F.array_distinct(tokens(F.col("sentence")))))
    best = rows.withColumn("shared", shared).where("shared > 0").withColumn("s", F.col("shared") + F.when(F.col("sentence").rlike(r"[0-9]"), 0.5).otherwise(0.0) + F.col("score"))
    best = best.groupBy("query_id", "sentence").agg(F.round(F.max("s"), 6).alias("score"))
    return best.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "sentence"))).where(F.col("pos") <= top)
