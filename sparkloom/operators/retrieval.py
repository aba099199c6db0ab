"""Ranked retrieval for whole tables of queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrow import pieces
from ..functions.text import tokens

#: Rows of a query table that may be sent to every executor.
BROADCAST_ROWS = 200_000


#: Text of a question table that is sent to every executor, and vectors of a block of them.
QUESTION_BYTES, QUERY_BLOCK = 16 << 20, 4096
#: Cells (question, vector) that a task scores at once, and questions of such a tile.
CELLS, TILE = 1 << 19, 512


def sized(df: DataFrame) -> DataFrame:
    """The table with a broadcast hint if a count proves it small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, n_terms``: distinct terms."""
    q = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("ts"))
    return q.select("query_id", F.size("ts").alias("n_terms"), F.explode("ts").alias("term"))


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """``doc_id, dl, term, tf``; with ``terms``, of those terms only (the filter runs before any shuffle)."""
    rows = docs.select("doc_id", tokens(F.col("text")).alias("ts")).select("doc_id", F.size("ts").alias("dl"), F.explode("ts").alias("term"))
    if terms is not None:
        rows = rows.join(sized(terms.select("term").distinct()), "term", "left_semi")
    return rows.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def top(df: DataFrame, k: int, score: str = "score", key: str = "doc_id", by: str = "query_id") -> DataFrame:
    """The best ``k`` rows of each query with their rank; ties by key."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), key))).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 0.9, b: float = 0.4, min_match: bool = False) -> DataFrame:
    """``query_id, doc_id, score, matched, n_terms, rank``: the best ``k``. ``matched``: the question's terms that occur.

    ``min_match``: up to two terms all must occur, of more 70 % (rounded down). This is the search over fields with one
    field and without its phrase clause: documents are cut once, only numbers of what is asked for are dealt, scores are
    held in blocks of bounded size, and no document is read before an action.
    """
    from .fielded import bm25_fields  # which ranks with ``top``

    return bm25_fields(docs, queries, {"text": 1.0}, k, k1=k1, b=b, min_match=min_match, phrase_weight=0, terms=tokens, term=None, empty=True)


def bm25_joined(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 0.9, b: float = 0.4, min_match: bool = False) -> DataFrame:
    """The same by joins, for question tables of any size."""
    qt = query_terms(queries)
    hits = postings(docs, qt)
    stats = docs.select(F.size(tokens(F.col("text"))).alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = qt.join(df, "term").crossJoin(F.broadcast(stats)).withColumn("idf", F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    tf = F.col("tf")
    part = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    scored = hits.join(weighted, "term").groupBy("query_id", "doc_id", F.col("n_terms").cast("long").alias("n_terms")).agg(F.round(F.sum(part), 6).alias("score"), F.count(F.lit(1)).alias("matched"))
    if min_match:
        need = F.when(F.col("n_terms") <= 2, F.col("n_terms")).otherwise(F.floor(F.col("n_terms") * 0.7))
        scored = scored.where(F.col("matched") >= need)
    return top(scored, k).select("query_id", "doc_id", "score", "matched", "n_terms", "rank")


def phrase(docs: DataFrame, queries: DataFrame, length: int) -> DataFrame:
    """``query_id, doc_id, n``: places in a document where a run of ``length`` tokens of the question stands.

    Questions with fewer tokens are not sought as phrases. A document's runs are looked up inside its row, all at once by
    a rolling hash and the few that match by their words; a question table beyond ``QUESTION_BYTES`` is cut in blocks.
    """
    kind = lambda t, c: t.schema[c].dataType.simpleString()
    size = queries.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, found = -(-max(1, size) // QUESTION_BYTES), None
    rows = docs.select("doc_id", tokens(F.col("text")).alias("ts")).where(F.size("ts") >= length)
    for i in range(blocks):
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        part = rows.mapInArrow(_runs(block.select("query_id", tokens(F.col("text")).alias("ts")).toArrow(), length), f"query_id {kind(queries, 'query_id')}, doc_id {kind(docs, 'doc_id')}, n long")
        found = part if found is None else found.unionAll(part)
    return found


def _runs(questions: pa.Table, length: int):
    ids, number, wanted = questions.column("query_id").combine_chunks(), {}, {}
    for q, ts in enumerate(questions.column("ts").to_pylist()):
        codes = [number.setdefault(t, len(number)) for t in ts]
        for at in range(len(codes) - length + 1):
            wanted.setdefault(tuple(codes[at : at + length]), set()).add(q)
    powers = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(length)], np.uint64)
    hashes = np.unique((np.array(list(wanted), np.uint64).reshape(-1, length) * powers).sum(1, dtype=np.uint64))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, [1]):
            offsets, code = batch.column(1).offsets.to_numpy(), batch.column(1).flatten().dictionary_encode()
            known = np.array([number.get(t, -1) for t in code.dictionary.to_pylist()], np.int64)
            c = known[code.indices.to_numpy()] if len(code) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(batch)), np.diff(offsets))
            n = max(0, len(c) - length + 1)
            h, ok = np.zeros(n, np.uint64), np.ones(n, bool)
            for j in range(length):
                h += c[j : j + n].astype(np.uint64) * powers[j]
                ok &= c[j : j + n] >= 0
            if n:
                ok &= doc[:n] == doc[length - 1 :]
            counts: dict[tuple[int, int], int] = {}
            for at in np.flatnonzero(ok)[np.isin(h[ok], hashes)].tolist():
                for q in wanted.get(tuple(c[at : at + length].tolist()), ()):
                    counts[q, int(doc[at])] = counts.get((q, int(doc[at])), 0) + 1
            q, d = (pa.array([x[i] for x in counts], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([ids.take(q), batch.column(0).take(d), pa.array(list(counts.values()), pa.int64())], names=["query_id", "doc_id", "n"])

    return look


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10, keep: Column | None = None) -> DataFrame:
    """Exact inner-product search: ``query_id, vec_id, score, rank``; a vector doesn't find itself.

    ``keep`` filters before the ranking. Rows meet blocks of the stated query set in matrix products of bounded size, and
    only the best ``k`` of each question leave a task. A null vector, and one of another length than the question's, is no hit.
    """
    rows = (vectors if keep is None else vectors.where(keep)).where("embedding IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", "embedding")
    asked = queries.where("embedding IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", "embedding")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    found = None
    blocks = -(-max(1, asked.count()) // QUERY_BLOCK)
    for i in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i)
        part = rows.mapInArrow(_nearest(block.toArrow(), k), f"query_id {kind}, vec_id {kind}, score double")
        found = part if found is None else found.unionAll(part)
    return top(found.withColumn("score", F.round("score", 5)), k, key="vec_id")


def _nearest(questions: pa.Table, k: int):
    ids = questions.column("vec_id").combine_chunks()
    lists = questions.column("embedding").combine_chunks()
    level = lambda s: np.where(np.isnan(s), np.inf, np.round(s, 5))  # noqa: E731  Spark and SQL put NaN above all numbers

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = ids.to_numpy(zero_copy_only=False)
        widths = np.diff(lists.offsets.to_numpy())
        best: dict[tuple[int, int], list[np.ndarray]] = {}  # of a tile of questions: question, vector, score
        for batch in batches:
            size = np.diff(batch.column(1).offsets.to_numpy())
            for width in np.unique(widths):
                these = np.flatnonzero(widths == width)
                if not len(here := np.flatnonzero(size == width)):
                    continue
                for lo in range(0, len(these), TILE):
                    asked = these[lo : lo + TILE]
                    q = lists.take(pa.array(asked)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(asked), width)
                    for at in range(0, len(here), CELLS // TILE):
                        rows = pa.array(here[at : at + CELLS // TILE])
                        name = batch.column(0).take(rows).to_numpy(zero_copy_only=False)
                        v = batch.column(1).take(rows).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(name), width)
                        score = q @ v.T
                        own = mine[asked][:, None] == name[None, :]
                        rank = np.where(own, -np.inf, level(score))
                        # the k-th best of each question; those level with it are weighed by their names
                        edge = np.partition(rank, len(name) - k, 1)[:, len(name) - k] if len(name) > k else np.full(len(asked), -np.inf)
                        i, j = np.nonzero((rank >= edge[:, None]) & ~own)
                        new = [asked[i], name[j], score[i, j]]
                        old = best.get((int(width), lo))
                        i, names, s = new if old is None else [np.concatenate(x) for x in zip(old, new, strict=True)]
                        o = np.lexsort((names, -level(s), i))
                        i, names, s = i[o], names[o], s[o]
                        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                        best[int(width), lo] = [i[keep], names[keep], s[keep]]
        for i, names, s in best.values():
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), pa.array(names, ids.type), pa.array(s)], names=["query_id", "vec_id", "score"])

    return search


def children(parent_hits: DataFrame, chunks: DataFrame, per_parent: int = 3) -> DataFrame:
    """At most ``per_parent`` children of each parent hit, ranked by (parent rank, ordinal).

    Children are cut inside their parent first, in each task before the shuffle, so no question meets a whole parent.
    """
    first = chunks.withColumn("n", F.row_number().over(W.partitionBy("parent_id").orderBy("doc_id"))).where(F.col("n") <= per_parent)
    rows = first.join(parent_hits.select("query_id", "parent_id", F.col("rank").alias("parent_rank")), "parent_id")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("parent_rank", "n"))).select("query_id", "parent_id", "doc_id", "rank")


def rrf(hits: DataFrame, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal-rank fusion of ``query_id, leg, doc_id, rank``: score, legs, rank; ties by best rank, then key."""
    if k <= 0:
        raise ValueError("k must be positive")
    w = F.lit(1.0)
    for leg, x in (weights or {}).items():
        w = F.when(F.col("leg") == leg, F.lit(float(x))).otherwise(w)
    best = hits.groupBy("query_id", "leg", "doc_id").agg(F.min("rank").alias("r")).withColumn("w", w).where("w > 0")
    fused = best.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") / (k + F.col("r"))), 9).alias("score"), F.min("r").alias("best_rank"), F.count(F.lit(1)).alias("n_legs"))
    return fused.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "best_rank", "doc_id")))


def rrf_parts(hits: DataFrame, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Fusion of ``query_id, part, leg, doc_id, rank``: each leg of each part of a question is a list of its own.

    A document that several parts find gets a share from each of them, so it comes before one that a single part finds
    as well. ``n_parts`` counts the parts that found it. Weights are those of the legs.
    """
    lists = hits.withColumn("list", F.concat_ws("\u001f", "leg", F.col("part").cast("string")))
    w = F.lit(1.0)
    for leg, x in (weights or {}).items():
        w = F.when(F.col("leg") == leg, F.lit(float(x))).otherwise(w)
    best = lists.groupBy("query_id", "list", "leg", "part", "doc_id").agg(F.min("rank").alias("r")).withColumn("w", w).where("w > 0")
    fused = best.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") / (k + F.col("r"))), 9).alias("score"), F.min("r").alias("best_rank"), F.count_distinct("part").alias("n_parts"))
    return fused.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "best_rank", "doc_id")))


def contribution(hits: DataFrame) -> DataFrame:
    """Documents that one leg alone finds, by leg."""
    alone = hits.groupBy("query_id", "doc_id").agg(F.count_distinct("leg").alias("n"), F.min("leg").alias("leg")).where("n = 1")
    return alone.groupBy("leg").agg(F.count(F.lit(1)).alias("n_unique"))


def priors(fused: DataFrame, as_of: str, authority: float = 0.15, recency: float = 0.10, half_life: int = 730, superseded: float = 0.25) -> DataFrame:
    """Multiply fused scores by authority and recency; superseded documents keep a quarter."""
    age = F.greatest(F.lit(0), F.date_diff(F.lit(as_of).cast("date"), F.coalesce("effective_from", "publication_date")))
    fresh = F.coalesce(F.pow(F.lit(0.5), age / half_life), F.lit(0.0))
    trust = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("authority", F.lit(0.0))))
    score = F.col("score") * (1 + authority * trust + recency * fresh) * F.when(F.col("is_superseded"), superseded).otherwise(1.0)
    out = fused.withColumn("prior_score", F.round(score, 9))
    return out.withColumn("prior_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("prior_score"), "doc_id")))


def identifiers_in(docs: DataFrame, asked: DataFrame, runs: Callable[[Column], Column], k: int = 50) -> DataFrame:
    """``query_id, doc_id, n_identifiers, n_places, rank``: the best ``k`` documents that name any identifier of a question.

    asked: ``query_id, identifiers``. ``runs`` cuts a text into its runs of letters and of digits; a document names an
    identifier where the runs of it stand one after another. A document is found by the first two runs of an
    identifier, then searched for the whole. More identifiers count before more places, then the smaller ``doc_id``. Questions of the
    same identifiers are ranked once, and of an identifier's documents those that name no other one of a question meet it
    only if they are among the identifier's best ``k``, which loses no hit. An identifier without any letter or digit, a question without identifiers and a null text name nothing.
    """
    ids = asked.select("query_id", F.explode(F.array_distinct("identifiers")).alias("identifier")).withColumn("want", runs(F.col("identifier"))).where("size(want) > 0")
    pairs = lambda ts: F.transform(F.slice(ts, 1, F.size(ts) - 1), lambda t, i: F.concat_ws(" ", t, F.get(ts, i + 1)))
    wanted = sized(ids.select("want").distinct().select("want", F.coalesce(F.get(pairs(F.col("want")), F.lit(0)), F.col("want")[0]).alias("key")))
    # a document is cut once; of its runs and pairs, only those that begin an identifier get a row with its text
    known = wanted.agg(F.collect_set("key").alias("known"))
    rows = docs.select("doc_id", runs(F.col("text")).alias("ts")).where("size(ts) > 0").crossJoin(F.broadcast(known))
    rows = rows.select("doc_id", F.concat(F.lit(" "), F.array_join("ts", " "), F.lit(" ")).alias("flat"), F.explode(F.array_intersect(F.concat("ts", pairs(F.col("ts"))), "known")).alias("key"))
    times = F.regexp_count("flat", F.concat(F.lit("(?= "), F.array_join("want", " "), F.lit(" )")))
    # both readers of the counts take all their columns and rows, or Spark would cut the documents once for each
    places = rows.join(wanted, "key").select("doc_id", "want", times.alias("n")).where("n > 0 AND want IS NOT NULL")
    counted = places.groupBy("doc_id", "want").agg(F.sum("n").alias("n"))
    # questions that want the same are answered once, in the name of the smallest
    mine = ids.groupBy("query_id", "want").agg(F.count(F.lit(1)).alias("times"))
    asked_for = mine.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("want", "times"))).alias("all"))
    leads = asked_for.groupBy("all").agg(F.min("query_id").alias("lead"))
    wants = leads.select("lead", F.size("all").alias("size"), F.explode("all").alias("x")).select("lead", "size", "x.want", "x.times")
    # documents that name one want of a question: none behind the best k of that want can be among the question's best
    best = counted.withColumn("place", F.row_number().over(W.partitionBy("want").orderBy(F.desc("n"), "doc_id"))).where(F.col("place") <= k)
    single = wants.join(best, "want").select("lead", "doc_id", F.col("times").alias("n_identifiers"), (F.col("times") * F.col("n")).alias("n_places"))
    # documents that name several wants, for questions that have several
    several = wants.where("size > 1")
    many = counted.withColumn("named", F.count(F.lit(1)).over(W.partitionBy("doc_id"))).where("named > 1")
    both = several.join(many, "want").groupBy("lead", "doc_id").agg(F.sum("times").alias("n_identifiers"), F.sum(F.col("times") * F.col("n")).alias("n_places"), F.count(F.lit(1)).alias("wants"))
    both = both.where("wants > 1").drop("wants")
    by = single.unionByName(both).groupBy("lead", "doc_id").agg(F.max("n_identifiers").alias("n_identifiers"), F.max("n_places").alias("n_places"))
    order = W.partitionBy("lead").orderBy(F.desc("n_identifiers"), F.desc("n_places"), "doc_id")
    found = by.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return asked_for.join(leads, "all").select("query_id", "lead").join(found, "lead").select("query_id", "doc_id", "n_identifiers", "n_places", "rank")
