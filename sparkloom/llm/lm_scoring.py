"""LM scoring: a hierarchical Pitman-Yor bigram model over the whole corpus.

Every word has a restaurant for what follows it; all restaurants share one parent of single words, whose own base is
uniform. Customers of the parent are the tables of its children. Seating is sampled by Gibbs sweeps: all customers of a
dish are seated anew, one after the other, by the Chinese-restaurant rule, and the proposal is accepted by the ratio of
its normalisers. Predictive probabilities are averaged over the samples.

Documents are encoded once, in blocks. A block sends each bucket of contexts its distinct word pairs with their counts;
the bucket merges them, seats their customers and answers with probabilities. Restaurants of frequent words are split
over several buckets by the following word; what the parts must know of each other travels with the parent's messages.
Within a job the parent stays as it was seated from its children's first tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import U64, bucket_of, from_six, groups, mix, six_bytes
from .common import cut, cut_in_buckets, parts_for, table, volume
from .near_dedup import pieces, raw_texts

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
START, END = U64(xxhash.xxh3_64_intdigest(b"\0start")), U64(xxhash.xxh3_64_intdigest(b"\0end"))
LOW48 = U64((1 << 48) - 1)
#: Discount and strength of the restaurants and of their parent.
CHILD, PARENT = (0.8, 2.0), (0.6, 100.0)
#: Sweeps before sampling, and sampled sweeps.
BURN, SAMPLES = 2, 3
#: Text of a block: what a task holds at once.
BLOCK_BYTES = 16 << 20


def pack_tokens(x: np.ndarray) -> bytes:
    """Low and high halves apart: the high ones are mostly zero and compress well."""
    return x.astype("<u2").tobytes() + (x >> np.uint32(16)).astype("<u2").tobytes()


def unpack_tokens(raw: bytes) -> np.ndarray:
    n = len(raw) // 4
    return np.frombuffer(raw, "<u2", n).astype(np.int64) | np.frombuffer(raw, "<u2", n, 2 * n).astype(np.int64) << 16


def seat(c: np.ndarray, fresh: np.ndarray, growth: np.ndarray, discount: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Seat ``c`` customers of each dish one after the other: tables, and the log of the steps' normalisers.

    A new table weighs ``fresh`` and each table opened adds ``growth``. From the 33rd customer on, groups of customers
    that grow by an eighth are seated at once.
    """
    order = np.argsort(-c, kind="stable")
    cs, t, norm = c[order], np.minimum(c[order], 1).astype(np.float64), np.zeros(len(c))
    f, g = fresh[order], growth[order]
    have, step = 1, 1
    while len(cs) and have < cs[0]:
        step = 1 if have < 32 else have // 8
        live = np.searchsorted(-cs, -have, side="left")  # dishes with more than `have` customers
        now = np.minimum(step, cs[:live] - have)
        new = f[:live] + g[:live] * (t[:live] - 1)
        total = have - discount * t[:live] + new
        opened = rng.random(live) < new / total if step == 1 else rng.binomial(now, np.clip(new / total, 0, 1))
        t[:live] += opened
        norm[:live] += now * np.log(total)
        have += step
    tables, logs = np.empty(len(c)), np.empty(len(c))
    tables[order], logs[order] = t, norm
    return tables, logs


def resample(c, t, norm, fresh, growth, discount, rng):
    """One sweep: a proposal for every dish, accepted by Metropolis and Hastings."""
    t2, norm2 = seat(c, fresh, growth, discount, rng)
    take = np.log(rng.random(len(c))) < norm2 - norm
    return np.where(take, t2, t), np.where(take, norm2, norm)


def encode(docs: DataFrame) -> DataFrame:
    """A row a block: documents, their tokens as numbers into the block's words (0 the end), and training counts."""
    kind = docs.schema["doc"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            raw, held = raw_texts(batch.column(2)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for piece in pieces(raw, BLOCK_BYTES):
                ids: dict[bytes, int] = {b"": 0}
                flat, sizes = [], []
                for text in raw[piece]:
                    words = text.translate(_LOWER).split()
                    flat.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint32, len(words)))
                    flat.append(np.zeros(1, np.uint32))
                    sizes.append(len(words) + 1)
                tokens = np.concatenate(flat)
                train = np.repeat(~held[piece], sizes)
                count = np.bincount(tokens[train], minlength=len(ids)).astype(np.uint32)
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), U64, len(ids))
                hashes[0] = END
                row = [part << 32 | number, batch.column(0).slice(piece.start, piece.stop - piece.start).to_pylist(), np.packbits(held[piece]).tobytes(), np.array(sizes, np.uint32).tobytes(), pack_tokens(tokens), hashes.tobytes(), count.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)
                number += 1

    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("block", pa.int64()), ("docs", pa.list_(to_arrow_type(docs.schema["doc"].dataType))), *((x, pa.binary()) for x in ("held", "sizes", "tokens", "hashes", "counts"))])
    return docs.select("doc", "held", "text").mapInArrow(blocks, f"block long, docs array<{kind}>, held binary, sizes binary, tokens binary, hashes binary, counts binary")


def by_bucket(keys: np.ndarray, buckets: int, all_: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    bucket = bucket_of(keys, buckets)
    o = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[o], np.arange(buckets + 1))
    for b in range(buckets):
        if all_ or edges[b] < edges[b + 1]:
            yield b, o[edges[b] : edges[b + 1]]


def word_counts(blocks: DataFrame, buckets: int, hot_share: int) -> DataFrame:
    """Training counts of every block's words: ``block, bucket, counts``, and for each bucket its sums and frequent words."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, hashes, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                h, c = np.frombuffer(hashes, U64), np.frombuffer(counts, np.uint32)
                rows = [(b, block, h[at].tobytes(), c[at].tobytes()) for b, at in by_bucket(mix(h), buckets)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "hashes", "counts"])

    def answer(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, U64) for x in group.column("hashes").to_pylist()]
        words, where = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(where, np.concatenate([np.frombuffer(x, np.uint32) for x in group.column("counts").to_pylist()]), len(words)).astype(np.int64)
        said = [x.tobytes() for x in np.split(total[where], np.cumsum([len(p) for p in parts])[:-1])]
        # no more than `hot_share` times the buckets' number can be so frequent
        often = np.flatnonzero(total * hot_share > max(1, total.sum()))
        n = len(group)
        sums = [group.column("bucket")[0].as_py(), int(total.sum()), int((total > 0).sum()), words[often].view(np.int64).tolist(), total[often].tolist()]
        return pa.table([
            pa.array([*group.column("block").to_pylist(), None], pa.int64()), pa.array([sums[0]] * (n + 1), pa.int32()), pa.array([*said, None], pa.binary()),
            pa.array([None] * n + [sums[1]], pa.int64()), pa.array([None] * n + [sums[2]], pa.int64()),
            pa.array([None] * n + [sums[3]], pa.list_(pa.int64())), pa.array([None] * n + [sums[4]], pa.list_(pa.int64())),
        ], ["block", "bucket", "counts", "n", "v", "words", "often"])

    asked = blocks.select("block", "hashes", "counts").selectExpr("block", "hashes", "counts").mapInArrow(ask, "bucket int, block long, hashes binary, counts binary")
    return asked.groupBy("bucket").applyInArrow(answer, "block long, bucket int, counts binary, n long, v long, words array<long>, often array<long>")


class Pairs:
    """A block's distinct (context, word) pairs, dealt to buckets of contexts."""

    def __init__(self, sizes: bytes, tokens: bytes, held: bytes, hashes: bytes, ways: dict[int, int], buckets: int):
        self.sizes, token = np.frombuffer(sizes, np.uint32).astype(np.int64), unpack_tokens(tokens)
        self.held = np.unpackbits(np.frombuffer(held, np.uint8), count=len(self.sizes)).astype(bool)
        word = np.frombuffer(hashes, U64)
        n = len(word)
        before = np.empty(len(token), np.int64)
        before[1:] = token[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = n  # the start of a document
        key, self.where = np.unique(before * n + token, return_inverse=True)
        self.counts = np.bincount(self.where, np.repeat(~self.held, self.sizes), len(key)).astype(np.uint32)
        context = np.append(word, START)
        u, w = context[key // n], word[key % n] & LOW48
        split = np.array([ways.get(int(x), 1) for x in context.tolist()], U64)[key // n]
        self.u, self.w, self.split = u, w, split
        dealt = list(by_bucket(mix(u + (mix(w) % split) * U64(0xD6E8FEB86659FD93)), buckets))
        self.order = [(b, at[np.lexsort((w[at], u[at]))]) for b, at in dealt]


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, held_fold: int = 2, bucket_bytes: int = 12 << 20, seed: int = 11) -> DataFrame:
    """Score every document by a model of the training documents (all but fold ``held_fold`` of crc32(key) mod ``folds``).

    Returns ``key, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per input row; scores are
    log10 probabilities of the whole text with its end. Null and empty texts are the end alone. A null key is in
    training. Repeated rows count each time, texts of any length count whole, an empty table gives an empty result; with
    no training document every word is unknown. Other columns are not read. Words are told apart by 64-bit hashes, and
    by 48 bits behind one context. Samples depend on ``seed`` and the number of buckets alone.
    """
    fold = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)) == held_fold
    rows = docs.select(F.col(key).alias("doc"), F.coalesce(fold, F.lit(False)).alias("held"), F.col(text).alias("text"))
    buckets = parts_for(volume(docs, text)[1], bucket_bytes)
    hot_share = 4
    # the last step brings the answers to the blocks, not the blocks to the answers
    blocks = cut_in_buckets(encode(rows), "block", buckets)
    words = cut(word_counts(blocks, buckets, hot_share))
    n_train, n_words = (int(x or 0) for x in words.agg(F.sum("n"), F.sum("v")).first())
    # words with more than a quarter of a bucket's tokens: at most four a bucket
    frequent = words.where("n IS NOT NULL").select(F.explode(F.arrays_zip("words", "often")).alias("x")).select("x.words", "x.often").where(F.col("often") * hot_share * buckets > n_train).collect()
    share = max(1, n_train // (hot_share * buckets))
    c_of = {int(np.int64(w).astype(U64)): c for w, c in frequent}
    ways = {w: -(-c // share) for w, c in c_of.items()}
    starts = int(rows.where("NOT held").count())
    c_of[int(START)] = starts
    if starts > share:
        ways[int(START)] = -(-starts // share)
    (d1, s1), (d0, s0) = CHILD, PARENT

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, tokens, held, hashes in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                p = Pairs(sizes, tokens, held, hashes, ways, buckets)
                for b, at in p.order:
                    new = np.flatnonzero(groups(p.u[at]))
                    row = (b, block, p.u[at][new].tobytes(), np.diff(np.append(new, len(at))).astype(np.uint32).tobytes(), six_bytes(p.w[at]), p.counts[at].tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["bucket", "block", "contexts", "runs", "words", "counts"])

    def merged(group: pa.Table):
        group = group.take(group.column("block").to_numpy().argsort())
        col = lambda c, t: [np.frombuffer(x, t) for x in group.column(c).to_pylist()]
        u = np.concatenate([np.repeat(a, r) for a, r in zip(col("contexts", U64), col("runs", np.uint32), strict=True)])
        w = np.concatenate([from_six(x) for x in group.column("words").to_pylist()])
        parts = col("counts", np.uint32)
        o = np.lexsort((w, u))
        new = groups(u[o], w[o])
        where = np.empty(len(o), np.int64)
        where[o] = np.cumsum(new) - 1
        c = np.bincount(where, np.concatenate(parts)).astype(np.int64)
        return group, [len(p) for p in parts], u[o][new], w[o][new], c, where

    def split_tables(u: np.ndarray, t: np.ndarray) -> dict[int, float]:
        """Tables of this bucket's part of each split restaurant."""
        new = np.flatnonzero(groups(u))
        return {int(x): float(s) for x, s in zip(u[new].tolist(), np.add.reduceat(t, new) if len(new) else [], strict=True) if int(x) in ways}

    def dishes(group: pa.Table) -> pa.Table:
        """First tables, one for each pair that occurs: what the parent's customers are."""
        _, _, u, w, c, _ = merged(group)
        names, where = np.unique(w, return_inverse=True)
        tables = np.bincount(where, c > 0, len(names)).astype(np.uint32)
        parts = split_tables(u, (c > 0).astype(np.float64))
        number = group.column("bucket")[0].as_py()
        rows = [(b, number, six_bytes(names[at]), tables[at].tobytes(), list(parts) if b == 0 else [], list(parts.values()) if b == 0 else []) for b, at in by_bucket(mix(names), buckets, True)]
        rows = [(*r[:4], np.array(r[4], U64).tobytes(), np.array(r[5]).tobytes()) for r in rows]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], ["to", "bucket", "words", "tables", "split", "parts"])

    def parent(group: pa.Table) -> pa.Table:
        """Seat the parent's customers of this bucket's words; answer with customers and tables, and the bucket's sums."""
        group = group.take(group.column("bucket").to_numpy().argsort())
        parts = [from_six(x) for x in group.column("words").to_pylist()]
        names, where = np.unique(np.concatenate(parts), return_inverse=True)
        c = np.bincount(where, np.concatenate([np.frombuffer(x, np.uint32) for x in group.column("tables").to_pylist()]), len(names)).astype(np.int64)
        rng = np.random.default_rng([seed, 1, group.column("to")[0].as_py()])
        # words are dealt evenly, so this bucket's tables stand for its share of all
        t, norm, mean = np.minimum(c, 1).astype(np.float64), None, np.zeros(len(c))
        for sweep in range(BURN + SAMPLES):
            fresh = np.full(len(c), (s0 + d0 * t.sum() * buckets) / (n_words + 1))
            grow = np.full(len(c), d0 / (n_words + 1))
            t, norm = seat(c, fresh, grow, d0, rng) if norm is None else resample(c, t, norm, fresh, grow, d0, rng)
            mean += t * (sweep >= BURN) / SAMPLES
        split: dict[int, float] = {}
        for us, xs in zip(group.column("split").to_pylist(), group.column("parts").to_pylist(), strict=True):
            for u, x in zip(np.frombuffer(us, U64).tolist(), np.frombuffer(xs, np.float64).tolist(), strict=True):
                split[u] = split.get(u, 0.0) + x
        at = np.split(where, np.cumsum([len(p) for p in parts])[:-1])
        n = len(group)
        return pa.table([
            group.column("bucket"), group.column("to"), pa.array([c[i].astype(np.uint32).tobytes() for i in at], pa.binary()), pa.array([mean[i].astype(np.float32).tobytes() for i in at], pa.binary()),
            pa.array([float(c.sum())] * n), pa.array([float(mean.sum())] * n), pa.array([np.array(list(split), U64).tobytes()] * n, pa.binary()), pa.array([np.array(list(split.values())).tobytes()] * n, pa.binary()),
        ], ["bucket", "from", "customers", "tables", "all_customers", "all_tables", "split", "parts"])

    def sample(group: pa.Table, replies: pa.Table) -> pa.Table:
        """Gibbs sweeps over this bucket's restaurants; answer every block with averaged probabilities."""
        group, sizes, u, w, c, where = merged(group)
        replies = replies.take(replies.column("from").to_numpy().argsort())
        c0, t0 = (np.concatenate([np.frombuffer(x, t) for x in replies.column(n).to_pylist()]).astype(np.float64) for n, t in (("customers", np.uint32), ("tables", np.float32)))
        names, dish = np.unique(w, return_inverse=True)
        order = np.concatenate([at for _, at in by_bucket(mix(names), buckets, True)])
        base = np.empty(len(names))
        all_c, all_t = sum(replies.column("all_customers").to_pylist()), sum(replies.column("all_tables").to_pylist())
        base[order] = (np.maximum(c0 - d0 * t0, 0) + (s0 + d0 * all_t) / (n_words + 1)) / (s0 + all_c)
        p0 = base[dish]
        first = replies.column("split").to_pylist()[0], replies.column("parts").to_pylist()[0]
        whole = dict(zip(np.frombuffer(first[0], U64).tolist(), np.frombuffer(first[1], np.float64).tolist(), strict=True))
        room_at = np.flatnonzero(groups(u))
        room = np.cumsum(groups(u)) - 1
        customers = np.add.reduceat(c, room_at).astype(np.float64)
        t = np.minimum(c, 1).astype(np.float64)
        elsewhere = np.zeros(len(room_at))
        for k, x in enumerate(u[room_at].tolist()):
            if x in ways:  # a part of a restaurant: its other parts' first tables, and all customers
                elsewhere[k] = whole.get(x, 0.0) - t[room == k].sum()
                customers[k] = c_of[x]
        rng = np.random.default_rng([seed, 2, group.column("bucket")[0].as_py()])
        many = np.flatnonzero(c > 1)
        norm, mean = None, np.zeros(len(c))
        for sweep in range(BURN + SAMPLES):
            tables = np.bincount(room, t, len(room_at)) + elsewhere
            fresh, grow = (s1 + d1 * (tables[room[many]] - t[many] + 1)) * p0[many], d1 * p0[many]
            if norm is None:
                t[many], norm = seat(c[many], fresh, grow, d1, rng)
            else:
                t[many], norm = resample(c[many], t[many], norm, fresh, grow, d1, rng)
            if sweep >= BURN:
                tables = np.bincount(room, t, len(room_at)) + elsewhere
                mean += (np.maximum(c - d1 * t, 0) + (s1 + d1 * tables[room]) * p0) / (s1 + customers[room]) / SAMPLES
        said = np.split(mean.astype(np.float32)[where], np.cumsum(sizes)[:-1])
        return pa.table([group.column("block"), group.column("bucket"), pa.nulls(len(group), pa.binary()), pa.array([x.tobytes() for x in said], pa.binary())], ["block", "bucket", "counts", "chances"])

    def score(group: pa.Table, replies: pa.Table) -> pa.Table:
        names, totals, out = group.column("docs").to_pylist()[0], None, None
        one = [group.column(x).to_pylist()[0] for x in ("sizes", "tokens", "held", "hashes")]
        p = Pairs(*one, ways, buckets)
        rows_ = list(zip(*(replies.column(x).to_pylist() for x in ("bucket", "counts", "chances")), strict=True))
        counts = {b: x for b, x, _ in rows_ if x is not None}
        chances = {b: x for b, _, x in rows_ if x is not None}
        word = np.frombuffer(one[3], U64)
        c = np.empty(len(word), np.int64)
        for b, at in by_bucket(mix(word), buckets):
            c[at] = np.frombuffer(counts[b], np.int64)
        chance = np.empty(len(p.u))
        for b, at in p.order:
            chance[at] = np.frombuffer(chances[b], np.float32)
        token = unpack_tokens(one[1])
        begin = np.cumsum(p.sizes) - p.sizes
        base = np.log10((c + 1) / (n_train + n_words + 1))[token]
        add = lambda x: np.add.reduceat(x, begin)
        cols = [pa.array(names, group.schema.field("docs").type.value_type), pa.array(p.held), pa.array(p.sizes), pa.array(add((c > 0)[token].astype(np.int64))), pa.array(np.full(len(names), n_train)), pa.array(add(base)), pa.array(add(np.log10(chance)[p.where]))]
        return pa.table(cols, [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[key].dataType.simpleString()
    asked = blocks.select("block", "sizes", "tokens", "held", "hashes").mapInArrow(pairs_of, "bucket int, block long, contexts binary, runs binary, words binary, counts binary")
    shared = asked.groupBy("bucket").applyInArrow(dishes, "to int, bucket int, words binary, tables binary, split binary, parts binary")
    seated = shared.groupBy("to").applyInArrow(parent, "bucket int, from int, customers binary, tables binary, all_customers double, all_tables double, split binary, parts binary")
    chances = asked.groupBy("bucket").cogroup(seated.groupBy("bucket")).applyInArrow(sample, "block long, bucket int, counts binary, chances binary")
    replies = words.where("block IS NOT NULL").selectExpr("block", "bucket", "counts", "cast(null as binary) AS chances").unionByName(chances)
    return blocks.select("block", "docs", "sizes", "tokens", "held", "hashes").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        score, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
