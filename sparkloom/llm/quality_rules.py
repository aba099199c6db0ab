"""Quality rules: a suffix array over each document's words finds repeated substrings.

Longest-common-prefix intervals of the suffix array give, for every word position, the longest run that starts there
and also starts elsewhere in the document. The union of those runs is the repeated share; the longest is the longest
repeat. Documents are independent, so the work is one map over Arrow batches without any shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SYMBOLS, BLANKS = b"#*$%&|<>", b" \t\n\r\x0b\f"
#: Production parameters. A repeated run counts towards the covered share from MIN_REPEAT words on; a document is
#: rejected when runs cover more than MAX_COVERED of its words or one run is longer than MAX_REPEAT words.
MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 10, 0.4, 200
#: Words whose suffixes are sorted together; bounds the memory of a task.
CHUNK_WORDS = 600_000


def longest_repeats(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest run from it that also starts at another position of its document.

    Prefix doubling refines the order of suffixes until none is tied; only tied ones are sorted again. Then the common
    prefix of neighbours in suffix order is found by halving over the kept ranks.
    """
    n = len(words)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    key = doc.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    sk = key[order]
    first = np.concatenate(([True], sk[1:] != sk[:-1]))
    start = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    rank = np.empty(n, np.int64)
    rank[order] = start[group]
    sizes = np.diff(np.append(start, n))
    tied = order[sizes[group] > 1]
    small = np.int32 if n < 1 << 31 else np.int64  # one array a doubling is kept
    ranks, h = [rank.astype(small)], 1
    suffix = order
    end = np.searchsorted(doc, doc, side="right")  # where the document of a position ends
    while len(tied):
        at = tied + h
        inside = at < end[tied]
        then = np.where(inside, rank[np.minimum(at, n - 1)], -1)
        o = np.lexsort((then, rank[tied]))
        t, r, s = tied[o], rank[tied][o], then[o]
        new_group = np.concatenate(([True], r[1:] != r[:-1]))
        new_part = new_group | np.concatenate(([True], s[1:] != s[:-1]))
        # a group keeps the slots from its rank on; parts take the slots in their order
        base = np.flatnonzero(new_group)[np.cumsum(new_group) - 1]
        slot = r + (np.arange(len(t)) - base)
        part = np.flatnonzero(new_part)[np.cumsum(new_part) - 1]
        suffix[slot] = t
        rank[t] = slot[part]
        sizes = np.diff(np.append(np.flatnonzero(new_part), len(t)))
        tied = t[sizes[np.cumsum(new_part) - 1] > 1]
        ranks.append(rank.astype(small))
        h *= 2
    # neighbours in suffix order that share at least one word
    pair = np.flatnonzero(ranks[0][suffix[1:]] == ranks[0][suffix[:-1]])
    a, b = suffix[pair].copy(), suffix[pair + 1].copy()
    a0, b0, ea, eb = a.copy(), b.copy(), end[a], end[b]
    lcp = np.zeros(len(pair), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        live = (a < ea) & (b < eb)
        same = live & (ranks[level][np.minimum(a, n - 1)] == ranks[level][np.minimum(b, n - 1)])
        # equal ranks at a level mean that 2**level words are equal and inside the document
        step = same << level
        a, b, lcp = a + step, b + step, lcp + step
    np.maximum.at(best, a0, lcp)
    np.maximum.at(best, b0, lcp)
    return best


def covered(best: np.ndarray, at_least: int, bounds: np.ndarray) -> np.ndarray:
    """Words of each document inside the union of its repeated runs of ``at_least`` words or more."""
    n = len(best)
    hit = np.flatnonzero(best >= at_least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + best[hit], -1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(edge[:n]) > 0)))
    return inside[bounds[1:]] - inside[bounds[:-1]]


def measures(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measures of whole texts (UTF-8)."""
    ids: defaultdict[bytes, int] = defaultdict(count().__next__)
    rows, sizes, dup_lines = [], [], []
    for text in texts:
        words = text.split()
        sizes.append(len(words))
        rows.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        dup_lines.append(len(lines) - len(set(lines)))
    sizes = np.array(sizes, np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    words = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    best = longest_repeats(words, np.repeat(np.arange(len(texts)), sizes))
    top = np.zeros(len(texts), np.int64)
    if len(best):
        full = sizes > 0
        top[full] = np.maximum.reduceat(best, bounds[:-1][full])
    return {
        "n_words": sizes,
        "n_symbols": np.array([len(x) - len(x.translate(None, SYMBOLS)) for x in texts], np.int64),
        "n_dup_lines": np.array(dup_lines, np.int64),
        "n_repeat_words": covered(best, 3, bounds),
        "longest_repeat": top,
        "runs": best,
        "bounds": bounds,
    }


def chunks(raw: list[bytes]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts whose words are sorted together."""
    at = 0
    while at < len(raw):
        stop, room = at, CHUNK_WORDS * 6
        while stop < len(raw) and (stop == at or room > 0):
            room -= len(raw[stop])
            stop += 1
        yield at, stop
        at = stop


def verdicts(texts: list[bytes], min_repeat: int, max_covered: float, max_repeat: int, min_words: int, max_repeat_words_pct: int) -> dict[str, np.ndarray]:
    m = measures(texts)
    n, cover = m["n_words"], covered(m.pop("runs"), min_repeat, m.pop("bounds"))
    failed = (n < min_words) | (100 * m["n_repeat_words"] > max_repeat_words_pct * n)
    return m | {"base_failed": failed, "kept": ~failed & ~((cover > max_covered * n) | (m["longest_repeat"] > max_repeat)), "n_covered_words": cover}


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT, min_words: int = 50, max_repeat_words_pct: int = 50) -> DataFrame:
    """Measure and judge every document by its repetition.

    Returns ``key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_covered_words,
    longest_repeat``, one row per input row. Null and empty texts have no words, zero measures and fail the base rule
    (fewer than ``min_words``). Texts of any length are sorted whole; ties between equal suffixes are refined until none
    is left. Repeated rows stay, a null key stays null, an empty table gives an empty result; other columns aren't read.
    """
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered_words", "longest_repeat"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            points = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            raw = column.cast(pa.binary()).to_pylist()
            for at, stop in chunks(raw):
                v = verdicts(raw[at:stop], min_repeat, max_covered, max_repeat, min_words, max_repeat_words_pct)
                v["word_chars"] = points[at:stop] - np.array([len(x) - len(x.translate(None, BLANKS)) for x in raw[at:stop]], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, stop - at), *(pa.array(v[x]) for x in numbers)], names=[key, *numbers])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(
        judge, f"`{key}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered_words long, longest_repeat long",
    )


def quality_filter(docs: DataFrame, text: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT, min_words: int = 50, max_repeat_words_pct: int = 50) -> DataFrame:
    """The rows, with all their columns, that ``quality_rules`` keeps; null and empty texts go."""
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = pc.fill_null(batch.column(at), "").cast(pa.binary()).to_pylist()
            kept = [verdicts(raw[x:y], min_repeat, max_covered, max_repeat, min_words, max_repeat_words_pct)["kept"] for x, y in chunks(raw)]
            yield batch.filter(pa.array(np.concatenate(kept))) if kept else batch

    return docs.mapInArrow(keep, docs.schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")  # SQL can't express its value


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS p, unnest(list_transform(range(1, len(ws) - k + 2), lambda p: array_to_string(ws[p:p + k - 1], ' '))) AS gram
      FROM w, (VALUES (3), ({MIN_REPEAT})) AS v(k) WHERE len(ws) >= k),
win AS (SELECT doc_id, k, p, count(*) OVER (PARTITION BY doc_id, k, gram) AS n FROM g),
again AS (SELECT doc_id, ws FROM w WHERE doc_id IN (SELECT doc_id FROM win WHERE k = {MIN_REPEAT} AND n > 1) AND len(ws) > {MAX_REPEAT}),
gl AS (SELECT doc_id, unnest(range(1, len(ws) - {MAX_REPEAT} + 1)) AS p, unnest(list_transform(range(1, len(ws) - {MAX_REPEAT} + 1), lambda p: md5(array_to_string(ws[p:p + {MAX_REPEAT}], ' ')))) AS gram FROM again),
long AS (SELECT doc_id, {MAX_REPEAT + 1} AS k, p, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM gl),
hit AS (SELECT DISTINCT doc_id, k, unnest(range(p, p + k)) AS p FROM (FROM win UNION ALL FROM long) WHERE n > 1),
r AS (SELECT doc_id, count(*) FILTER (k = 3) AS r3, count(*) FILTER (k = {MIN_REPEAT}) AS rc, count(*) FILTER (k = {MAX_REPEAT + 1}) AS rl FROM hit GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM ln WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
levels AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
       length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
       coalesce(r3, 0)::BIGINT AS n_repeat_words, coalesce(rc, 0)::BIGINT AS n_covered_words, coalesce(rl, 0) AS rl
       FROM w LEFT JOIN r USING (doc_id) LEFT JOIN dl USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_covered_words > {MAX_COVERED} * n_words OR rl > 0) AS kept,
  n_covered_words
FROM levels
"""
