"""BM25 over several fields: the best field of each document counts, and a sloppy phrase counts on top.

One scan cuts the fields into terms and keeps what the questions ask for, in a row of numbers a document. Those rows are
dealt once and read twice: document frequencies and mean lengths are counted from them into one small row, which is
broadcast, and every document is then scored in its own row. Both readers take all columns of the rows, or Spark would
cut the texts once for each. Nothing but the stated questions is read before an action. Tasks hold pieces of bounded
size, however many rows a batch has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import english_stem, english_words
from ..functions.arrow import pieces
from .retrieval import top

#: Cells (question, document, field), or terms met, that a task holds at once, and bytes of questions that are sent to every task.
CELLS, QUESTION_BYTES = 1 << 19, 16 << 20
#: The weights of the fields, of the phrase, and how far its words may be out of place in all.
WEIGHTS = {"content": 1.0, "context_line": 0.7, "heading_path": 1.6, "title": 2.0}
PHRASE_WEIGHT, SLOP = 2.0, 2


class Asked:
    """A stated set of questions as numbers: a coordinate for each field and term."""

    def __init__(self, rows: pa.Table, fields: int, term: Callable[[str], str] | None):
        self.ids, self.term = rows.column("query_id").combine_chunks(), term
        lists = [x if term is None else list(map(term, x)) for x in rows.column("ts").to_pylist()]
        self.number = {t: i for i, t in enumerate(sorted({t for x in lists for t in x if t}))}
        self.width, self.fields = max(1, len(self.number)), fields
        places = [[(self.number[t], p) for p, t in enumerate(x) if t] for x in lists]
        self.places = [np.array(x, np.int64).reshape(-1, 2) for x in places]
        terms = [np.unique(x[:, 0]) for x in self.places]
        self.n_terms = np.array([len(x) for x in terms], np.int64)
        owner = np.repeat(np.arange(len(terms)), self.n_terms)
        flat = np.concatenate(terms) if terms else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.askers, self.begin = owner[order], np.searchsorted(flat[order], np.arange(self.width + 1))


def _hits(asked: Asked, places: bool):
    """Rows ``doc, keep, field arrays of terms`` to numbers: lengths of the fields, coordinates, counts, and places of what is asked for."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = asked.width
        for batch in pieces(batches, range(2, 2 + asked.fields)):
            n, found = batch.num_rows, []
            lengths = np.zeros((n, asked.fields), np.int32)
            for f in range(asked.fields):
                column = batch.column(2 + f)
                offsets, code = column.offsets.to_numpy().astype(np.int64), column.flatten().dictionary_encode()
                words = code.dictionary.to_pylist()
                words = words if asked.term is None else list(map(asked.term, words))
                term = np.array([asked.number.get(w, -1) for w in words] or [-1], np.int64)
                real = np.array([w != "" for w in words] or [False])
                at = code.indices.to_numpy()
                doc = np.repeat(np.arange(n), np.diff(offsets))
                place = np.arange(len(at)) - (offsets[:-1] - offsets[0])[doc]
                lengths[:, f] = np.bincount(doc[real[at]], minlength=n)
                hit = np.flatnonzero(term[at] >= 0)
                found.append((doc[hit], f * width + term[at[hit]], place[hit]))
            doc, c, place = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(doc * (width * asked.fields) + c, kind="stable")  # places already rise
            doc, c, place = doc[order], c[order], place[order]
            new = np.ones(len(c), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (c[1:] != c[:-1])
            first = np.flatnonzero(new)
            tf = np.diff(np.append(first, len(c)))
            cut = lambda owner, x: pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(x.astype(np.int32)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * asked.fields), pa.array(lengths.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat, cut(doc[first], c[first]), cut(doc[first], tf), cut(doc, place) if places else cut(doc[:0], place[:0])], names=["doc_id", "keep", "dl", "c", "tf", "place"])

    return look


def _counts(asked: Asked, empty: bool):
    """Rows of ``_hits`` to ``c, n, length``: documents that have a coordinate; below 0, those that have a field, and its words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(asked.width * asked.fields, np.int64)
        n, length = np.zeros(asked.fields, np.int64), np.zeros(asked.fields, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(3).flatten().to_numpy(), minlength=len(df))
            dl = batch.column(2).flatten().to_numpy().reshape(-1, asked.fields)
            n += len(dl) if empty else (dl > 0).sum(0)
            length += dl.sum(0, dtype=np.int64)
        c, field = np.flatnonzero(df), np.arange(asked.fields)
        rows = (np.append(c, -1 - field), np.append(df[c], n), np.append(0 * c, length))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["c", "n", "length"])

    return count


def phrase_frequency(words: np.ndarray, places: list[np.ndarray], slop: int) -> float:
    """How often words stand as asked: 1 for each place where all do, less where they are up to ``slop`` places off.

    ``words``: place in the question of each word; ``places``: where it stands in the text.
    """
    off = [np.sort(p - w) for w, p in zip(words, places, strict=True)]
    starts = np.unique(np.concatenate(off))
    width = np.zeros(len(starts), np.int64)
    for o in off:
        at = np.searchsorted(o, starts)
        near = np.where(at < len(o), o[np.minimum(at, len(o) - 1)] - starts, slop + 1)
        width = np.maximum(width, near)
    width = width[width <= slop]
    return float((1 / (1 + width)).sum())


def _scores(asked: Asked, weights: list[float], k: int, k1: float, min_match: bool, phrase_weight: float, slop: int):
    n_terms, width, fields = asked.n_terms, asked.width, asked.fields
    need = np.where(n_terms <= 2, n_terms, np.floor(n_terms * 0.7)) if min_match else np.ones(len(n_terms))
    need = np.maximum(need, 1)
    boost = np.array(weights)

    def block(doc: np.ndarray, n: int, c: np.ndarray, tf: np.ndarray, idf: np.ndarray, norm: np.ndarray, place: np.ndarray, begin: np.ndarray):
        """Documents 0 to n: (question, document, score, terms found in its best field)."""
        term, field = c % width, c // width
        count = asked.begin[term + 1] - asked.begin[term]
        row = np.repeat(np.arange(len(c)), count)
        q = asked.askers[np.repeat(asked.begin[term], count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)]
        part = idf * tf * (k1 + 1) / (tf + norm[doc, field])
        cell = (q * n + doc[row]) * fields + field[row]
        shape = (len(n_terms), n, fields)
        total = np.bincount(cell, part[row], len(n_terms) * n * fields).reshape(shape)
        met = np.bincount(cell, minlength=len(n_terms) * n * fields).reshape(shape)
        ok = (met > 0) & (met >= need[:, None, None])
        best = np.where(ok, total * boost, 0).max(2)
        if phrase_weight:
            extra = np.zeros(shape)
            key = doc * (fields * width) + c
            for i, d, f in zip(*np.nonzero(ok & (met == n_terms[:, None, None])), strict=True):
                mine = np.searchsorted(key, d * fields * width + f * width + asked.places[i][:, 0])
                freq = phrase_frequency(asked.places[i][:, 1], [place[begin[m] : begin[m] + tf[m]] for m in mine], slop)
                if freq:
                    extra[i, d, f] = boost[f] * idf[mine].sum() * freq * (k1 + 1) / (freq + norm[d, f])
            best = best + phrase_weight * extra.max(2)
        q, d = np.nonzero(ok.any(2))
        return q, d, best[q, d], np.where(ok, met, 0).max(2)[q, d]

    def best(q: np.ndarray, d: np.ndarray, s: np.ndarray, m: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
        """The best ``k`` of each question; ties by ``order``."""
        o = np.lexsort((order[d], -s, q))
        q = q[o]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return [q[keep], *(x[o][keep] for x in (d, s, m))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, range(1, 6)):
            batch = batch.filter(batch.column(6))
            names = batch.column(0)
            order = np.argsort(np.argsort(names.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
            lists = [batch.column(i) for i in range(1, 6)]  # c, tf, idf, norm, place
            c, tf, idf, norm, place = (x.flatten().to_numpy() for x in lists)
            at, spots = lists[0].offsets.to_numpy().astype(np.int64) - lists[0].offsets[0].as_py(), lists[4].offsets.to_numpy().astype(np.int64) - lists[4].offsets[0].as_py()
            norm = norm.reshape(len(names), fields)
            step = max(1, CELLS // max(1, len(n_terms) * fields))
            met = np.concatenate(([0], np.cumsum(np.diff(asked.begin)[c % width])))[at]  # terms of questions met before each document
            q, d, s, m = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.int64))
            lo = 0
            while lo < len(names):
                hi = min(len(names), lo + step, max(lo + 1, int(np.searchsorted(met, met[lo] + CELLS, "right")) - 1))
                part = slice(at[lo], at[hi])
                doc = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
                begin = np.cumsum(tf[part]) - tf[part]
                more = block(doc, hi - lo, c[part].astype(np.int64), tf[part], idf[part], norm[lo:hi], place[spots[lo] : spots[hi]], begin)
                q, d, s, m = best(*(np.concatenate(x) for x in zip((q, d, s, m), (more[0], more[1] + lo, np.round(more[2], 6), more[3]), strict=True)), order)
                lo = hi
            yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(q)), names.take(pa.array(d)), pa.array(s.astype(np.float64)), pa.array(m.astype(np.int64)), pa.array(n_terms[q])], names=["query_id", "doc_id", "score", "matched", "n_terms"])

    return score


def bm25_fields(
    docs: DataFrame, queries: DataFrame, weights: dict[str, float] | None = None, k: int = 200, scope: Column | None = None, k1: float = 0.9, b: float = 0.4,
    min_match: bool = True, phrase_weight: float = PHRASE_WEIGHT, slop: int = SLOP, terms: Callable[[Column], Column] = english_words,
    term: Callable[[str], str] | None = english_stem, empty: bool = False,
) -> DataFrame:
    """``query_id, doc_id, score, matched, n_terms, rank``: the best ``k`` of each question.

    A document scores its best field (``weights``: column to weight), and ``phrase_weight`` times the best field in
    which all words of the question stand in order, at most ``slop`` places off. ``min_match``: a field counts where
    up to two terms all occur, of more 70 % (rounded down). ``scope`` decides which documents may be hits at all; it is
    part of the scan, before any ranking, and doesn't change the statistics, which are those of all documents that have
    the field, or with ``empty`` of all documents. A null
    field is empty, a null scope is no hit; ties go to the smaller ``doc_id``; no questions give no rows. Questions of
    more than ``QUESTION_BYTES`` in all are answered in blocks of that size. ``terms`` cuts a text into words, and
    ``term`` says which term a word is, once for each distinct word of a piece; an empty term only holds its place.
    """
    weights = WEIGHTS if weights is None else weights
    size = queries.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, parts = -(-max(1, size) // QUESTION_BYTES), []
    for i in range(blocks):
        some = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        parts.append(_block(docs, some, weights, k, scope, k1, b, min_match, phrase_weight, slop, terms, term, empty))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    return top(found, k)


def _block(docs, queries, weights, k, scope, k1, b, min_match, phrase_weight, slop, terms, term, empty) -> DataFrame:
    kind = lambda t, c: t.schema[c].dataType.simpleString()
    asked = Asked(queries.select("query_id", terms(F.col("text")).alias("ts")).toArrow(), len(weights), term)
    keep = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    rows = docs.select("doc_id", keep.alias("keep"), *(terms(F.col(f)).alias(f"__f{i}") for i, f in enumerate(weights)))
    hits = rows.mapInArrow(_hits(asked, phrase_weight > 0), f"doc_id {kind(docs, 'doc_id')}, keep boolean, dl array<int>, c array<int>, tf array<int>, place array<int>").repartition("doc_id")
    # one row: the weight of every coordinate by its document frequency, and the fields' mean lengths
    counts = hits.mapInArrow(_counts(asked, empty), "c long, n long, length long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
    every = docs.sparkSession.range(-len(weights), asked.width * len(weights)).select(F.col("id").alias("c")).join(counts, "c", "left")
    row = every.agg(F.sort_array(F.collect_list(F.struct("c", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("length", F.lit(0)).alias("length")))).alias("all"))
    # the fields, of which the last comes first, then the coordinates
    row = row.select(F.reverse(F.slice("all", 1, len(weights))).alias("field"), F.slice("all", len(weights) + 1, asked.width * len(weights)).alias("term"))
    n = lambda x: F.get(F.col("field"), F.floor(x["c"] / asked.width).cast("int"))["n"]
    stats = row.select(
        F.transform("term", lambda x: F.log1p((n(x) - x["n"] + 0.5) / (x["n"] + 0.5))).alias("idf"), F.transform("field", lambda x: x["length"] / F.greatest(x["n"], F.lit(1))).alias("mean"),
    )
    weighed = hits.crossJoin(F.broadcast(stats)).select(
        "doc_id", "c", "tf", F.transform("c", lambda c: F.get("idf", c)).alias("w"), F.transform("dl", lambda d, i: k1 * (1 - b + b * d / F.greatest(F.get("mean", i), F.lit(1e-9)))).alias("norm"), "place", "keep",
    )
    names = "query_id {}, doc_id {}, score double, matched long, n_terms long".format(kind(queries, "query_id"), kind(docs, "doc_id"))
    return weighed.mapInArrow(_scores(asked, list(weights.values()), k, k1, min_match, phrase_weight, slop), names)
