"""Packing: lexical retrieval over a sharded BM25 inverted index fills fixed training windows.

Tokenizing maps over the documents; whole windows of long documents are complete at once, and what is left of each
document goes to the shard of its weightiest term, so that neighbours meet. Every shard has a BM25 inverted index over
its token terms, with statistics over all documents. A seed's weightiest terms retrieve its unused neighbours, which
greedily fill the seed's window; the neighbour that no longer fits is cut and its rest seeds the next window.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: The pre-token pattern of byte-level tokenizers: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoders of this worker process by file.
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Token ids of whole texts.

    A byte-level vocabulary whose ids follow the order of its merges means the same as ranks, which encode several
    times faster; texts with one of its special tokens, and any other tokenizer file, are encoded by ``tokenizers``.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.ranks = _ranks(json.loads(self.tokenizer.to_str()))

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def __call__(self, text: str) -> np.ndarray:
        if self.ranks is None or any(s in text for s in self.special):
            return self.plain(text)
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype(self.dtype)


def _ranks(spec: dict):
    """The vocabulary as ranks, or None if it does not mean the same."""
    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    if (model["type"], cut.get("type"), cut.get("use_regex", True), cut.get("add_prefix_space"), spec["normalizer"]) != ("BPE", "ByteLevel", True, False, None):
        return None
    if any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    letters = sorted(ByteLevel.alphabet())
    # the alphabet keeps printable bytes and moves the others, in their order, beyond them
    bytes_of = {c: ord(c) for c in letters if ord(c) < 256}
    bytes_of |= dict(zip((c for c in letters if ord(c) >= 256), sorted(set(range(256)) - set(bytes_of.values())), strict=True))
    vocabulary, merges = model["vocab"], model["merges"]
    added = {t["content"] for t in spec["added_tokens"]}
    try:
        ranks = {bytes(bytes_of[c] for c in piece): i for piece, i in vocabulary.items() if piece not in added}
    except KeyError:
        return None
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    if len(ranks) != 256 + len(pairs) or any(vocabulary.get("".join(p)) != 256 + i for i, p in enumerate(pairs)):
        return None
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(file: str) -> Encoder:
    if file not in _ENCODERS:
        _ENCODERS[file] = Encoder(file)
    return _ENCODERS[file]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def numbers(raw: bytes, n: int) -> np.ndarray:
    """``n`` ids of two or four bytes each."""
    return np.frombuffer(raw, f"<u{len(raw) // n}")


def terms_of(units: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each unit, one unit after the other, how often each occurs, and each unit's number of them."""
    terms, counts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for u in units:
        s = np.sort(u, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        terms.append(s[first].astype(np.int64))
        counts.append(np.diff(np.append(first, len(s))))
        sizes.append(len(first))
    return np.concatenate(terms), np.concatenate(counts), np.array(sizes, np.int64)


class Statistics:
    """What BM25 counts over all documents: as many numbers as the vocabulary has entries."""

    def __init__(self, df: np.ndarray, units: int, ids: int, k1: float, b: float):
        self.idf, self.mean, self.k1, self.b = np.log1p((units - df + 0.5) / (df + 0.5)), max(1.0, ids / max(1, units)), k1, b

    def weights(self, t: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self.idf[t] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * lengths / self.mean))


class Shard:
    """A BM25 inverted index over units (arrays of token ids)."""

    def __init__(self, units: list[np.ndarray], stats: Statistics, query_terms: int):
        self.n, self.query_terms = len(units), query_terms
        t, tf, sizes = terms_of(units)
        unit = np.repeat(np.arange(self.n), sizes)
        weight = stats.weights(t, tf, np.array([len(u) for u in units], np.float64)[unit])
        self.by_unit, self.unit_terms, self.unit_weight = np.concatenate(([0], np.cumsum(sizes))), t, weight
        order = np.argsort(t, kind="stable")
        self.names, begin = np.unique(t[order], return_index=True)
        self.by_term, self.post_unit, self.post_weight = np.append(begin, len(t)), unit[order], weight[order]

    def rankings(self, seed: int, unused: np.ndarray) -> Iterator[np.ndarray]:
        """Unused units that share a term with the seed, best first, ties by position: those that its weightiest terms
        retrieve, then those that the next ones do, until all its terms were asked for."""
        lo, hi = self.by_unit[seed], self.by_unit[seed + 1]
        place = np.searchsorted(self.names, self.unit_terms[lo:hi][np.argsort(-self.unit_weight[lo:hi], kind="stable")])
        for at in range(0, len(place), self.query_terms):
            spans = [slice(self.by_term[x], self.by_term[x + 1]) for x in place[at : at + self.query_terms]]
            score = np.bincount(np.concatenate([self.post_unit[s] for s in spans]), np.concatenate([self.post_weight[s] for s in spans]), self.n)
            found = np.flatnonzero((score > 0) & unused)
            if len(found):
                yield found[np.argsort(-score[found], kind="stable")]


def fill(units: list[np.ndarray], room_for: int, stats: Statistics, query_terms: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (unit, first id, ids). Every id of every unit lies in exactly one.

    A seed's neighbours follow it in the order of their rank; the one that no longer fits is cut, and its rest seeds the
    next window. When the seed retrieves nothing more, the units after it in the window are asked, one by one.
    """
    shard = Shard(units, stats, query_terms)
    sizes = [len(u) for u in units]
    unused = np.ones(len(units), bool)
    windows, seed, first, turn = [], None, 0, 0
    while True:
        while turn < len(units) and not unused[turn]:
            turn += 1
        if seed is None:
            if turn == len(units):
                return windows
            seed, first = turn, 0
            unused[seed] = False
        window = [(seed, first, sizes[seed] - first)]
        room, asked, seed = room_for - window[0][2], 0, None
        while room and seed is None and asked < len(window):
            for ranking in shard.rankings(window[asked][0], unused):
                for unit in ranking.tolist():
                    n = min(room, sizes[unit])
                    window.append((unit, 0, n))
                    unused[unit] = False
                    room -= n
                    if n < sizes[unit]:
                        seed, first = unit, n
                    if not room:
                        break
                if not room:
                    break
            asked += 1
            if room and asked == len(window):  # nothing left shares a term with this window
                while turn < len(units) and not unused[turn]:
                    turn += 1
                if turn < len(units):
                    n = min(room, sizes[turn])
                    window.append((turn, 0, n))
                    unused[turn] = False
                    room -= n
                    if n < sizes[turn]:
                        seed, first = turn, n
        windows.append(window)


def deal(loads: dict[int, int], most: int) -> tuple[dict[int, tuple[int, int]], int]:
    """First shard and number of shards of each term, and how many shards there are; a shard gets about ``most`` at once.

    A term with more takes several shards of its own; the others share, in the order of the vocabulary.
    """
    out, shards, used = {}, 0, most
    for term, load in sorted(loads.items()):
        if load > most:
            ways = -(-load // most)
            out[term], shards, used = (shards, ways), shards + ways, most
            continue
        if used + load > most:
            shards, used = shards + 1, 0
        out[term], used = (shards - 1, 1), used + load
    return out, max(1, shards)


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = 2048, end_id: int = 1, shard_ids: int = 3_000_000, k1: float = 0.9, b: float = 0.4, query_terms: int = 16) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` ids.

    Returns one row per piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset``. A document is its ids
    and then ``end_id``; null and empty texts are ``end_id`` alone. Only the last sequence of a shard can be short.
    Documents go to the shard of their weightiest term, by statistics over all documents; a shard gets about
    ``shard_ids`` ids, and a term with more is split over several by a hash of key and ids, so that equal rows and null
    keys are spread, too. Repeated rows are packed each, a null key stays null, an empty table gives an empty result,
    other columns are not read. ``query_terms`` is how many of a seed's terms are asked for at a time; every unit is
    indexed, retrieved and placed. The tokenizer file must be readable on every executor.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[key].dataType
    name, arrow = kind.simpleString(), to_arrow_type(kind)
    schema = pa.schema([("mark", pa.int64()), ("name", arrow), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64()), ("total", pa.int64()), ("ids", pa.binary())])
    result = pa.schema([(key, arrow), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])
    units_kind = f"mark long, name {name}, start long, length long, crc long, total long, ids binary"

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([end_id], encode.dtype)
        seen: dict[int, int] = {}
        for batch in batches:
            rows: list[tuple] = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate((encode(body or ""), end))
                n, whole = len(ids), len(ids) // window * window
                same = zlib.crc32(ids.tobytes(), zlib.crc32(repr(doc).encode())) << 32 | n & 0xFFFFFFFF
                seen[same] = times = seen.get(same, 0) + 1
                mark = zlib.crc32(repr((same, times)).encode())
                for at in range(0, whole, window):
                    rows.append((mark + at // window, doc, at, window, crc(ids[at : at + window]), n, None))
                if whole < n:
                    rows.append((mark, doc, whole, n - whole, None, n, ids[whole:].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)

    def ids_of(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [numbers(x, n) for x, n in zip(batch.column("ids").to_pylist(), batch.column("length").to_pylist(), strict=True)]

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(terms_of(ids_of(batch))[0])
            total = np.pad(total, (0, max(0, len(n) - len(total))))
            total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    units = cut(docs.select(F.col(key), F.col(text)).mapInArrow(tokenize, units_kind))
    rest = units.where("ids IS NOT NULL")
    # as many rows as the vocabulary has entries
    found = rest.select("length", "ids").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(max(found.column("term").to_pylist(), default=0) + 1)
    df[found.column("term").to_numpy()] = found.column("n").to_numpy()
    n_units, n_ids = rest.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    stats = Statistics(df, n_units, n_ids, k1, b)

    def weightiest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, tf, sizes = terms_of(ids_of(batch))
            length = batch.column("length").to_numpy().astype(np.float64)
            unit = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((t, -stats.weights(t, tf, length[unit]), unit))
            top = t[order][np.cumsum(sizes) - sizes]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(top)], names=[*batch.schema.names, "term"])

    # a unit's overhead counts, too: very short documents don't make a shard of millions of units
    placed = cut(rest.mapInArrow(weightiest, units_kind + ", term long"))
    loads = placed.groupBy("term").agg(F.sum(F.col("length") + 64).alias("load")).toArrow()
    shard_of, shards = deal(dict(zip(*(loads.column(c).to_pylist() for c in ("term", "load")), strict=True)), shard_ids)
    plan = docs.sparkSession.createDataFrame([(t, *x) for t, x in shard_of.items()], "term long, first int, ways int")
    whole = units.where("ids IS NULL").withColumn("shard", F.pmod("mark", F.lit(shards)).cast("int"))
    dealt = whole.unionByName(placed.join(F.broadcast(plan), "term").withColumn("shard", F.col("first") + F.pmod("mark", "ways").cast("int")).drop("term", "first", "ways"))

    def fill_shard(group: pa.Table) -> pa.Table:
        left = group.column("ids").to_pylist()
        names, starts, sizes, sums, totals = (group.column(c).to_pylist() for c in ("name", "start", "length", "crc", "total"))
        base, out, sequence = group.column("shard")[0].as_py() << 32, [], 0
        for i in (i for i, x in enumerate(left) if x is None):
            out.append((names[i], starts[i], sizes[i], sums[i], totals[i], base + sequence, 0))
            sequence += 1
        rest = [i for i, x in enumerate(left) if x is not None]
        rest.sort(key=lambda i: (names[i] is None, names[i] or 0, starts[i], left[i]))
        units = [numbers(left[i], sizes[i]) for i in rest]
        for one in fill(units, window, stats, query_terms) if units else []:
            offset = 0
            for unit, first, n in one:
                i = rest[unit]
                out.append((names[i], starts[i] + first, n, crc(units[unit][first : first + n]), totals[i], base + sequence, offset))
                offset += n
            sequence += 1
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), result, strict=True)], schema=result)

    return dealt.groupBy("shard").applyInArrow(fill_shard, f"`{key}` {name}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
