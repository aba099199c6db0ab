"""Benchmark decontamination by proximity [native]: test windows whose words lie near their places in a document.

The same positional index as for exact phrases: postings of each window's rarest term, with the words around them. A
window's words are looked for at their distance from that term, give or take a slop, so that a passage with words
inserted, dropped or swapped is found too. Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .decontamination import BROADCAST_TERMS, WINDOW, occurrences, words_of


def anchored_windows(docs: DataFrame, items: DataFrame, window: int) -> tuple[DataFrame, int]:
    """``item, start, window_words, term, at``: every window with its rarest term that occurs at all, and how many terms there are.

    Ties go to the smallest term, then to its first place (``at``, in the window).
    """
    each = items.select("item", "item_words", F.posexplode("item_words").alias("at", "term"))
    vocabulary = cut(each.select("term").distinct())
    n_terms = vocabulary.count()
    counts = occurrences(docs, vocabulary, n_terms).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    size = F.size("item_words")
    length = F.least(size, F.lit(window))
    starts = F.explode(F.sequence(F.greatest(F.col("at") - length + 1, F.lit(0)), F.least(F.col("at"), size - length)))
    placed = each.join(F.broadcast(counts) if n_terms <= BROADCAST_TERMS else counts, "term").select("*", starts.alias("start"))
    rarest = placed.groupBy("item", "item_words", "start").agg(F.min(F.struct("n", "term", "at")).alias("rarest"))
    found = rarest.select("item", "start", F.slice("item_words", F.col("start") + 1, length).alias("window_words"), F.col("rarest.term").alias("term"), (F.col("rarest.at") - F.col("start")).alias("at"))
    return cut(found), n_terms


def words_in_place(slop: int) -> Column:
    """How many words of a window lie within ``slop`` of their place; ``centre`` is the anchor's index in ``near``."""

    def there(word: Column, i: Column) -> Column:
        place = F.col("centre") + i - F.col("at")
        first = F.greatest(place - slop, F.lit(0))
        return F.array_contains(F.slice("near", first + 1, F.greatest(place + slop - first + 1, F.lit(0))), word)

    return F.size(F.filter(F.transform("window_words", there), lambda x: x))


def proximity_matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = 2, share: float = 0.8) -> DataFrame:
    """Where documents hold a benchmark window exactly or nearly.

    A window is ``window`` consecutive item words; an item of fewer words (but not none) is one window. It matches at
    an occurrence of its rarest term if at least ``share`` of its words (rounded up) occur at most ``slop`` words from
    their place beside that term; equal words of a window may be met by one word of the document. Returns ``key, item,
    start`` (of the window in the item), ``pos`` (of the term in the document), ``n_found`` and ``exact`` (every word in
    its own place). Null and empty texts match nothing, nor do items without words or with no word that occurs; a null
    key or item id stays null; repeated items count once, and repeated document rows give one match together; ties
    between terms go to the smallest. Other columns are not read; empty tables give no rows. Texts of any length count
    whole. A very common passage costs a row per window and occurrence, never a pair of documents.
    """
    rows = docs.select(F.col(key).alias("doc"), words_of(F.col(text)).alias("words"))
    tests = items.select(F.col(item_key).cast("string").alias("item"), words_of(F.col(item_text)).alias("item_words")).where(F.size("item_words") > 0).distinct()
    windows, n_terms = anchored_windows(rows, tests, window)
    reach = window - 1 + slop
    centre = F.least(F.col("pos"), F.lit(reach))
    near = F.slice("words", F.col("pos") - centre + 1, centre + 1 + reach)
    postings = cut(occurrences(rows, windows.select("term").distinct(), n_terms, "doc", "pos", centre.alias("centre"), near.alias("near")))
    begin = F.col("centre") - F.col("at")
    met = postings.join(windows, "term").withColumns({
        "n_found": words_in_place(slop).cast("long"),
        "exact": (begin >= 0) & (F.slice("near", F.greatest(begin, F.lit(0)) + 1, F.size("window_words")) == F.col("window_words")),
    })
    return met.where(F.col("n_found") >= F.ceil(F.lit(share) * F.size("window_words"))).select(F.col("doc").alias(key), "item", "start", "pos", "n_found", "exact").distinct()
