"""Periodic runs of words: online dyadic square catching.

Words are appended one by one. Whenever a block of 2, 4, 8, ... words is complete, a catcher waits behind it for the
block to come again at a distance that only this block size watches. An appended word is compared with the last words
of the few waiting blocks; where it is the same, the suffix of the text is compared with the block. A block that comes
again at distance q is a square of period q in the making: it is followed to the left at once and to the right with
each appended word, and ends as a maximal run. Squares of the same period that one run covers merge into it.

With ``times`` periods asked for, a run of period q has an aligned block of S words within its first ``times - 1``
periods when ``2 S - 1 <= (times - 1) q``; the largest such power of two is the block size that watches q. So a catcher
of size S waits for fewer than S distances, at most one a size at any time, and nothing is ever missed. Work is about
n log n comparisons for n words, memory is linear in one document; documents are independent, so nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_sql, table, utf8_sql

#: Production parameters: a run has at least TIMES periods and LEAST words.
TIMES, LEAST = 4, 6
#: At most so many bytes of text go into one result batch.
BATCH_BYTES = 4 << 20


def watched(times: int, longest: int) -> list[tuple[int, int, int]]:
    """``(S, q from, q to)`` of each block size whose periods can run in ``longest`` words."""
    out, s = [], 1
    while (low := max(1, -(-(2 * s - 1) // (times - 1)))) * times <= longest:
        high = (4 * s - 2) // (times - 1)  # the last q for which 2 S is still too long
        if (4 * s - 1) <= (times - 1) * high:
            high -= 1
        if high >= low:
            out.append((s, low, high))
        s *= 2
    return out


class Catchers:
    """Words in, maximal runs out; ``extend`` appends words one by one, ``end`` closes what is open.

    Blocks of up to NEAR words wait for a few words only, so which of them do follows from the number of the appended
    word; larger blocks are entered under their last word while they wait.
    """

    NEAR = 8

    def __init__(self, longest: int, times: int = TIMES, least: int = LEAST):
        self.times, self.least = times, least
        sizes = watched(times, longest)
        self.far = [x for x in sizes if x[0] > self.NEAR]
        near = [(q, s) for s, low, high in sizes if s <= self.NEAR for q in range(low, high + 1)]
        self.near = [[(q, s) for q, s in near if (i - q + 1) % s == 0] for i in range(self.NEAR)]
        self.reach = max((q for q, _ in near), default=0)
        self.words: list[bytes] = []
        self.last: dict[bytes, int] = {}  # where a word was last
        self.runs: dict[tuple[int, int], int] = {}  # start, end: smallest period
        self.open: dict[int, int] = {}  # period: start of a repetition that reaches the last word
        self.waiting: dict[bytes, list[tuple[int, int]]] = {}  # last word of a block: (where it ends, block size)
        self.turns: dict[int, list[tuple[int, int, bool]]] = {}  # when catchers begin (True) and stop waiting

    def turn(self, i: int) -> None:
        for r, s, begins in self.turns.pop(i):
            word = self.words[r]
            if begins:
                self.waiting.setdefault(word, []).append((r, s))
            else:
                left = self.waiting[word]
                left.remove((r, s))
                if not left:
                    del self.waiting[word]

    def complete(self, i: int) -> None:
        """Larger blocks that end with word i get their catchers."""
        for s, low, high in self.far:
            if (i + 1) % s:
                break
            self.turns.setdefault(i + low, []).append((i, s, True))
            self.turns.setdefault(i + high + 1, []).append((i, s, False))

    def catch(self, i: int, r: int, s: int) -> None:
        """Word i is the last word of the block of s words that ends with word r: is the whole block there again?"""
        w, q, first, m = self.words, i - r, r - s + 1, 1
        if first < 0:
            return
        for d, start in self.open.items():
            if start <= first and q % d == 0:
                return  # inside a run of this period or of one that divides it
        while m < s:
            m = min(4 * m, s)
            if w[i - m + 1 : i + 1] != w[r - m + 1 : r + 1]:
                return
        while first and w[first - 1] == w[first - 1 + q]:
            first -= 1
        self.open[q] = first

    def close(self, q: int, end: int) -> None:
        start = self.open.pop(q)
        if end - start >= max(self.least, self.times * q):
            key = (start, end)
            self.runs[key] = min(q, self.runs.get(key, q))

    def extend(self, words: list[bytes]) -> None:
        text, last, waiting, turns, still, near, reach = self.words, self.last, self.waiting, self.turns, self.open, self.near, self.reach
        wide = self.NEAR - 1
        for i, word in enumerate(words, len(text)):
            text.append(word)
            if still:
                for q in [q for q in still if text[i - q] != word]:
                    self.close(q, i)
            if i in turns:
                self.turn(i)
            if word in last and i - last[word] <= reach:
                for q, s in near[i & wide]:
                    if q <= i and text[i - q] == word:
                        self.catch(i, i - q, s)
            last[word] = i
            if word in waiting:
                for r, s in waiting[word]:
                    self.catch(i, r, s)
            if not (i + 1) & wide:
                self.complete(i)

    def end(self) -> list[tuple[int, int, int]]:
        """``start, length, period`` of every run, by start and period."""
        for q in list(self.open):
            self.close(q, len(self.words))
        return sorted(((start, end - start, q) for (start, end), q in self.runs.items()), key=lambda x: (x[0], x[2]))


def runs_of(words: list[bytes], times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All maximal runs of a list of words."""
    catchers = Catchers(len(words), times, least)
    catchers.extend(words)
    return catchers.end()


def dropped(runs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Stretches of words that runs repeat after their first period, joined where they meet."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((start + q, start + n) for start, n, q in runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", times: int = TIMES, least: int = LEAST, words_of: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Runs of repeated words in whole texts: ``key, n_words, runs, collapsed``.

    ``runs`` has every maximal stretch of at least ``times`` (2 or more) periods and ``least`` words as (start, length,
    smallest period), by start and period. ``collapsed`` is the text's words joined by one blank, without those that a
    run repeats after its first period. ``words_of(key, words)`` may change a document's words first. Words lie between
    ASCII blanks. Null and empty texts have no words, no runs and an empty ``collapsed``; a null key stays null;
    repeated rows and equal texts are judged each for itself; an empty table gives an empty result; other columns are
    not read, whatever their names. Runs of one start are ordered by period, runs of one stretch are one run.
    """
    if times < 2:
        raise ValueError("a run has at least two periods")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = pc.fill_null(batch.column(1), "").cast(pa.large_binary())
            ids, begin, held = batch.column(0).to_pylist(), 0, 0
            rows: list[tuple] = []
            for at, whole in enumerate(raw):
                words = (body := whole.as_py()).split()
                if words_of:
                    words = words_of(ids[at], words)
                runs = runs_of(words, times, least)
                kept, last = [], 0
                for a, b in dropped(runs):
                    kept += words[last:a]
                    last = b
                rows.append((len(words), [{"start": s, "length": n, "period": q} for s, n, q in runs], b" ".join(kept + words[last:])))
                held += len(body)
                if held >= BATCH_BYTES or at + 1 == len(ids):
                    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                    columns = [batch.column(0).slice(begin, len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "n_words", "runs", "collapsed"])
                    begin, held, rows = at + 1, 0, []

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(of_batches, f"`{key}` {kind}, n_words long, runs {RUNS}, collapsed string")


def planted(key: object, words: list[bytes]) -> list[bytes]:
    """The words that the query judges: a tenth of the documents, by the checksum of the id, repeats a stretch to its end."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of whole documents, with digests of the runs and of what is left."""
    found = periodic_runs(table(spark, sf_dir, "documents"), words_of=planted)
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    found = found.withColumn("best", longest)
    length = -F.col("best.shorter")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )


#: Two places of four equal words are q apart for every word of a run but the last q + 3, so runs are islands of such pairs.
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc32_sql(utf8_sql("doc_id::VARCHAR"))} AS h FROM documents),
a AS (SELECT doc_id, w, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
b AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_concat(w[1:a], list_transform(range(a, n), lambda i: w[a + (i - a) % p + 1])) END AS w FROM p),
t AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM b),
f AS (SELECT doc_id, n, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o AS gram FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.gram = y.gram AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + 3 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest({LEAST}, {TIMES} * q) GROUP BY doc_id, start, length),
c AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM t ANTI JOIN c USING (doc_id, i) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed, min(struct_pack(l := -length, s := start, p := period)) AS best FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s AS start, -best.l AS length, best.p AS period, (1000 * -best.l) // best.p AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)
"""
