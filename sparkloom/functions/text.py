"""Text columns: tokens, counts, normal forms, similarity. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-cased words; words with an underscore are left out."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1)), lambda t: ~t.contains("_"))


def approx_tokens(text: Column) -> Column:
    """1.15 tokens a word or mark, at least one; none for an empty text."""
    n = F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), F.lit(1)))
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n * F.lit(1.15)))).cast("long")


def squeeze(text: Column) -> Column:
    """Lower-cased, with single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token sets; both empty are equal."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def heading_tree(path: Column) -> Column:
    """``a > b > c`` as a, ``a > b``, ``a > b > c``, lower-cased."""
    parts = F.transform(F.split(F.lower(path), ">"), lambda p: F.trim(p))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), " > "))


def short_hash(*parts: Column, length: int = 32) -> Column:
    """Hex digest of parts joined by the unit separator."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *[p.cast("string") for p in parts]), 256), 1, length)


def exact_terms(token: Column) -> Column:
    """A code as it is, its runs of letters and of digits, and all of them in one, each once, lower-cased."""
    low = F.lower(token)
    parts = F.regexp_extract_all(low, F.lit(r"([a-z]+|[0-9]+)"), F.lit(1))
    return F.array_distinct(F.concat(F.array(low), parts, F.array(F.array_join(parts, ""))))
