"""Spelling variant grouping: a relational trie frontier.

Words with one edit between them meet in a trie that is a table of edges. The frontier is a table of states (word,
position, node, edits): a state joins the edges of its node and moves on to their ends, level by level. Two words part
at a node of the trie, so that is where a state without edits takes an edge beside its own, with one letter replaced or
left out; a state with one edit only follows edges that spell what is left of its word. A state that ends its word at
the end of another one has found a neighbour.

Each word is in the trie twice, forwards and backwards. Either the first or the last half of a word is the same in its
neighbour, so states begin at the middle of a word, where few words share a node, never at the crowded root, and the
halves before it are not in the trie at all. Chains of nodes with one way on are one edge with several letters, so the
number of levels is that of partings, whatever the length of the words. A node is the 128-bit hash of its letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import U64, mix
from .common import LOWER, UPPER, crc32_sql, cut, drop, table, utf8_sql

RUN = re.compile("[a-zÀ-ÿ]+")
#: Production parameters: code points and occurrences that make a word, and how many times more its form has.
LENGTH, OCCURRENCES, RATIO = 6, 5, 5
#: A run of letters loses one where its checksum is divided by this.
DAMAGE = 199
#: Distinct words that a task holds before it passes their counts on.
HELD = 200_000
#: Letters of the words that are hashed at once.
LETTERS = 1 << 20


def word_counts(docs: DataFrame, key: str, text: str, length: int, damage: int) -> DataFrame:
    """``word, n``: runs of Latin letters of whole texts, A-Z in lower case; ``damage`` 0 leaves runs as they are."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = body.as_py()
                if not whole:
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in Counter(RUN.findall(whole.encode().lower().decode())).items():
                    if damage and (h := zlib.crc32(run.encode(), start)) % damage == 0:
                        k = h % len(run)
                        run = run[:k] + run[k + 1 :]
                    if len(run) >= length:
                        found[run] = found.get(run, 0) + n
                if len(found) >= HELD:
                    yield flushed()
        yield flushed()

    return docs.select(F.col(key), F.col(text)).mapInArrow(of_batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


PREFIX = [("d", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("next", pa.int32())]


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word both ways (``>`` or ``<`` and the letters) with its prefixes from the middle on: length, hash, next letter."""
    for batch in batches:
        words, counts = batch.column(0).to_pylist(), batch.column(1)
        begin = 0
        while begin < len(words):
            end, letters = begin, 0
            while end < len(words) and (end == begin or letters + len(words[end]) <= LETTERS):
                letters += len(words[end])
                end += 1
            for way in "><":
                spelt = [way + (w if way == ">" else w[::-1]) for w in words[begin:end]]
                # of n letters, the first half is left out: forwards it is the shorter one, backwards the longer one
                first = np.array([1 + (len(w) // 2 if way == ">" else -(-len(w) // 2)) for w in words[begin:end]])
                size = np.array([len(s) for s in spelt])
                code = np.frombuffer("".join(spelt).encode("utf-32-le"), np.uint32)
                owner, start = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
                place = np.arange(len(code)) - start[owner]
                at = mix(code.astype(U64) << U64(32) | place.astype(U64))
                sums = []
                for salt in (1, 2):
                    run = np.cumsum(mix(at + U64(salt)))
                    sums.append((run - np.concatenate(([U64(0)], run))[start][owner]).view(np.int64))
                following = np.append(code[1:], 0).astype(np.int32)
                last = start + size - 1
                following[last] = -1  # the word ends
                keep = np.flatnonzero(place + 1 >= first[owner])
                prefix = pa.StructArray.from_arrays([pa.array(x, t) for x, (_, t) in zip(((place[keep] + 1).astype(np.int32), sums[0][keep], sums[1][keep], following[keep]), PREFIX, strict=True)], names=[n for n, _ in PREFIX])
                offsets = np.concatenate(([0], np.cumsum(size - first + 1))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sums[0][last]), pa.array(sums[1][last]), pa.array(spelt, pa.string()), counts.slice(begin, end - begin), pa.ListArray.from_arrays(pa.array(offsets), prefix)], names=["w1", "w2", "s", "n", "prefix"],
                )
            begin = end


def _at(begin: Column, length: Column) -> Column:
    """``length`` letters of the word from position ``begin`` (from 0) on."""
    return F.substring(F.col("s"), (begin + 1).cast("int"), length.cast("int"))


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges ``p1, p2, letter, label, c1, c2, word, word_n`` and first states of a table ``word, n``.

    A node has two ways on, or is a word's end: ``word``. The node of a word's end has the word's hash.
    """
    spelt = cut(words.select("word", "n").mapInArrow(_spell, "w1 long, w2 long, s string, n long, prefix array<struct<d:int,h1:bigint,h2:bigint,next:int>>"))
    prefixes = spelt.select("w1", "w2", F.inline("prefix"))
    ways = prefixes.groupBy("h1", "h2").agg(F.min("next").alias("least"), F.max("next").alias("most"))
    nodes = ways.where("least <> most OR least = -1").select("h1", "h2")
    # a word's own nodes, in order: as many as its letters at most
    own = prefixes.select("w1", "w2", "d", "h1", "h2").join(nodes, ["h1", "h2"]).groupBy("w1", "w2").agg(F.sort_array(F.collect_list(F.struct("d", "h1", "h2"))).alias("path"))
    ends = spelt.select("w1", "w2", "s", "n")
    paths = cut(ends.join(own, ["w1", "w2"]).select("s", "n", "path"))
    steps = paths.select("s", "n", F.posexplode("path").alias("i", "from"), "path").where("i + 1 < size(path)").select("s", "n", "from", F.expr("path[i + 1]").alias("to"), (F.col("i") + 2 == F.size("path")).alias("last"))
    edges = steps.groupBy(F.col("from.h1").alias("p1"), F.col("from.h2").alias("p2"), F.col("to.h1").alias("c1"), F.col("to.h2").alias("c2")).agg(
        F.min(_at(F.col("from.d"), F.col("to.d") - F.col("from.d"))).alias("label"), F.max(F.when(F.col("last"), F.struct("s", "n"))).alias("end"),
    )
    edges = cut(edges.select("p1", "p2", F.substring("label", 1, 1).alias("letter"), "label", "c1", "c2", F.col("end.s").alias("word"), F.col("end.n").alias("word_n")))
    first = paths.select("s", "n", F.col("path")[0]["d"].alias("pos"), F.col("path")[0]["h1"].alias("h1"), F.col("path")[0]["h2"].alias("h2"), F.lit(0).alias("edits"))
    ends = ends.select(F.col("w1").alias("h1"), F.col("w2").alias("h2"), F.col("s").alias("word"), F.col("n").alias("word_n"))
    first = cut(first.where(F.col("pos") < F.length("s")).join(ends, ["h1", "h2"], "left").select(STATE))
    drop(spelt, paths)
    return edges, first


#: A word, its count, how many letters of it are spelt, the node, the edits, and the word that ends at the node.
STATE = ["s", "n", "pos", "h1", "h2", "edits", "word", "word_n"]


def step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States one level on: along their own edge, or, without edits so far, along another with a letter replaced or left out."""
    pos, size = F.col("pos"), F.length("label")
    mine = _at(pos, F.lit(1))
    on = states.select("s", "n", "pos", "h1", "h2", "edits").join(edges, (F.col("h1") == F.col("p1")) & (F.col("h2") == F.col("p2")) & ((mine == F.col("letter")) | (F.col("edits") == 0)))
    along = F.when((mine == F.col("letter")) & (_at(pos, size) == F.col("label")), F.struct((pos + size).alias("pos"), F.col("edits").alias("edits")))
    replaced = F.when((mine < F.col("letter")) & (_at(pos + 1, size - 1) == F.expr("substring(label, 2)")), F.struct((pos + size).alias("pos"), F.lit(1).alias("edits")))
    left_out = F.when((mine != F.col("letter")) & (_at(pos + 1, size) == F.col("label")), F.struct((pos + size + 1).alias("pos"), F.lit(1).alias("edits")))
    return on.select("s", "n", "c1", "c2", "word", "word_n", F.inline(F.array_compact(F.array(along, replaced, left_out)))).select("s", "n", "pos", F.col("c1").alias("h1"), F.col("c2").alias("h2"), "edits", "word", "word_n")


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: every two words of a table ``word, n`` (distinct) with exactly one edit between them, both ways."""
    edges, moved = trie(words)
    found, levels = [], []
    done = (F.col("edits") == 1) & (F.col("pos") == F.length("s")) | (F.col("edits") == 0) & (F.col("pos") == F.length("s") - 1)
    while True:
        levels.append(moved)
        found.append(moved.where(done & F.col("word").isNotNull()))
        states = moved.where(F.col("pos") < F.length("s"))
        if states.isEmpty():
            break
        moved = cut(step(states, edges))
    plain = lambda c: F.when(F.col(c).startswith(">"), F.expr(f"substring({c}, 2)")).otherwise(F.reverse(F.expr(f"substring({c}, 2)")))
    pairs = cut(reduce(DataFrame.unionAll, found).select(plain("s").alias("word"), "n", plain("word").alias("other"), F.col("word_n").alias("other_n")))
    drop(edges, *levels)
    return pairs.unionAll(pairs.select("other", "other_n", "word", "n")).distinct()


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """``word, root`` of a table ``word, form`` whose chains have at most ``longest`` steps, by pointers that double."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    done = 1
    while done < longest:
        on = at.select(F.col("word").alias("__op_at"), F.col("root").alias("__op_on"))
        at, done = cut(at.join(on, F.col("root") == F.col("__op_at"), "left").select("word", F.coalesce("__op_on", "root").alias("root"))), 2 * done
    return at


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, occurrences: int = OCCURRENCES, ratio: int = RATIO, damage: int = 0) -> DataFrame:
    """Words of whole texts with their more frequent spelling: ``word, form, root, n, n_near, form_n``.

    A word is a run of Latin letters of at least ``length`` code points that occurs ``occurrences`` times or more over
    all documents. Its form is the most frequent word one inserted, deleted or replaced code point away (ties: the
    smallest), if that occurs at least ``ratio`` (2 or more) times as often; its root is where its forms end. With
    ``damage``, the runs of a document lose a letter where the checksum of the id and the run is divided by it; a null
    id counts as empty. Null and empty texts have no words; repeated rows count each; an empty table gives an empty
    result; other columns are not read, whatever their names. Words may be of any length.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their words")
    words = cut(word_counts(docs, key, text, length, damage).where(F.col("n") >= occurrences))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = neighbours(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    judged = cut(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    most = judged.agg(F.max("n")).first()[0] or 1
    longest = 1
    while occurrences * ratio**longest <= most:
        longest += 1
    ends = roots(judged.where(F.col("form").isNotNull()), longest)
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), damage=DAMAGE)


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS n FROM d GROUP BY doc_id, run),
h AS (SELECT run, n, {crc32_sql(utf8_sql("doc_id || ':' || run"))} AS h FROM u),
l AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM l WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(n) >= {OCCURRENCES}),
x AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS other FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT x.word, v.word FROM x JOIN v ON x.rest = v.word UNION SELECT v.word, x.word FROM x JOIN v ON x.rest = v.word),
k AS (SELECT near.word, other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS place FROM near JOIN v o ON o.word = other),
j AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {RATIO} * v.n THEN other END AS form, CASE WHEN other_n >= {RATIO} * v.n THEN other_n END AS form_n FROM v LEFT JOIN k ON k.word = v.word AND place = 1),
r AS (SELECT word, word AS spot, 0 AS steps FROM j UNION ALL SELECT r.word, j.form, steps + 1 FROM r JOIN j ON j.word = r.spot WHERE j.form IS NOT NULL),
z AS (SELECT word, max_by(spot, steps) AS root FROM r GROUP BY word)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM j JOIN z USING (word)
"""
