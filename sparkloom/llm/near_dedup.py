"""MinHash near-dedup: an inverted join on signature coordinates.

Every distinct shingle set is posted under its coordinate-value pairs. A pair of sets that agrees in ``matches`` of
``coordinates`` values must meet among the rarest ``coordinates - matches + 1`` of either (prefix), so only those are
posted, rarest first, and values that one set has alone are skipped. Within a list the collisions are counted on whole
signatures; pairs above the threshold are confirmed on full sets. Lists are first joined to their most popular member,
which settles large groups in linear time; later, only sets that are still in different components are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import U64, bucket_of, from_six, groups, mix, six_bytes
from .common import cut, parts_for, table
from .components import components
from .shingles import new_words, shingle_sets, signatures

#: Lists with more members get the finer filter on shared shingles before their members are compared.
LONG_LIST = 64
#: Members of a list that are compared with as many others in one task.
TILE = 1024
#: A table of fewer rows (of some 30 bytes) is sent to every executor instead of shuffling the texts.
BROADCAST_ROWS = 300_000
#: Members that one task confirms against a list's centre.
STAR = 256


def raw_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def pieces(texts: list[bytes], room: int = 4 << 20) -> Iterator[slice]:
    """Slices of bounded size."""
    at = 0
    while at < len(texts):
        stop, left = at, room
        while stop < len(texts) and (stop == at or left > 0):
            left -= len(texts[stop])
            stop += 1
        yield slice(at, stop)
        at = stop


def profiles(docs: DataFrame, width: int, coordinates: int) -> DataFrame:
    """``doc, n, mark, sig``: set size, digest of the set, and its signature of 32-bit values; empty sets have neither."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = new_words()
        for batch in batches:
            raw = raw_texts(batch.column(1))
            for part in pieces(raw):
                if len(words) > 1_000_000:
                    words.clear()
                sets, bounds = shingle_sets(raw[part], width, words)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                sig = mix(signatures(sets, bounds[:-1][full], coordinates, 0)).astype("<u4")
                marks: list[bytes | None] = [None] * len(sizes)
                sigs: list[bytes | None] = [None] * len(sizes)
                for i, s in zip(full.tolist(), sig, strict=True):
                    marks[i] = hashlib.blake2b(sets[bounds[i] : bounds[i + 1]].tobytes(), digest_size=16).digest()
                    sigs[i] = s.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, part.stop - part.start), pa.array(sizes.astype(np.int64)), pa.array(marks, pa.binary()), pa.array(sigs, pa.binary())], names=["doc", "n", "mark", "sig"])

    return docs.mapInArrow(profile, "doc long, n long, mark binary, sig binary")


def postings(sets: DataFrame, n_sets: int, coordinates: int, matches: int) -> DataFrame:
    """``list, rep, n, sig, fame``: each set under the rarest of its values that another set shares.

    How often a value occurs is asked of its bucket; a block of sets asks once for each distinct value.
    """
    blocks = buckets = parts_for(n_sets * coordinates, 1 << 20)
    rows = sets.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int"))
    number = np.arange(coordinates, dtype=U64) << U64(32)

    def keys_of(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        group = group.sort_by("rep")
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u4").reshape(len(group), coordinates)
        keys = sig.astype(U64) | number
        distinct, where, times = np.unique(keys.reshape(-1), return_inverse=True, return_counts=True)
        return keys, distinct, where.reshape(keys.shape), times

    def by_bucket(distinct: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        bucket = bucket_of(mix(distinct), buckets)
        o = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[o], np.arange(buckets + 1))
        for b in range(buckets):
            if edges[b] < edges[b + 1]:
                yield b, o[edges[b] : edges[b + 1]]

    def ask(group: pa.Table) -> pa.Table:
        _, distinct, _, times = keys_of(group)
        out = [(b, group.column("block")[0].as_py(), distinct[at].tobytes(), times[at].astype(np.uint32).tobytes()) for b, at in by_bucket(distinct)]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "keys", "times"])

    def answer(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, U64) for x in group.column("keys").to_pylist()]
        times = np.concatenate([np.frombuffer(x, np.uint32) for x in group.column("times").to_pylist()])
        _, where = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(where, times).astype(np.uint32)[where]
        said = [x.tobytes() for x in np.split(total, np.cumsum([len(p) for p in parts])[:-1])]
        return pa.table([group.column("block"), group.column("bucket"), pa.array(said, pa.binary())], ["block", "bucket", "times"])

    def post(group: pa.Table, replies: pa.Table) -> pa.Table:
        group = group.sort_by("rep")
        keys, distinct, where, _ = keys_of(group)
        said = dict(zip(replies.column("bucket").to_pylist(), replies.column("times").to_pylist(), strict=True))
        often = np.zeros(len(distinct), np.uint32)
        for b, at in by_bucket(distinct):
            often[at] = np.frombuffer(said[b], np.uint32)
        often = often[where]
        fame = np.log(often).sum(1)
        rarest = np.lexsort((keys, often), axis=1)[:, : coordinates - matches + 1]
        row, col = np.nonzero(np.take_along_axis(often, rarest, 1) > 1)
        key = keys[row, rarest[row, col]].astype(np.int64)
        row = pa.array(row)
        return pa.table([pa.array(key), group.column("rep").take(row), group.column("n").take(row), group.column("sig").take(row), pa.array(fame[row.to_numpy()])], ["list", "rep", "n", "sig", "fame"])

    asked = rows.groupBy("block").applyInArrow(ask, "bucket int, block int, keys binary, times binary")
    replies = asked.groupBy("bucket").applyInArrow(answer, "block int, bucket int, times binary")
    return rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(post, "list long, rep long, n long, sig binary, fame double")


def star_pairs(posts: DataFrame, matches: int) -> DataFrame:
    """``a, b``: the most popular set of each list, and each other member whose signature has enough collisions."""
    centre = posts.groupBy("list").agg(F.max(F.struct("fame", (-F.col("rep")).alias("rank"), "rep")).alias("c"), F.count(F.lit(1)).alias("k"))
    centre = centre.where("k > 1").select(F.col("list").alias("l"), F.col("c.rep").alias("a"))
    pairs = posts.join(centre, F.col("list") == F.col("l")).where("a <> rep").select("a", F.col("rep").alias("b")).distinct()
    sigs = posts.select("rep", "sig").distinct()
    return (
        pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a")
        .join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
        .mapInArrow(collisions(matches), "a long, b long")
    )


def collisions(matches: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not len(t):
                continue
            x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), "<u4").reshape(len(t), -1) for c in ("sa", "sb"))
            t = t.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= matches))
            yield from t.to_batches()

    return keep


def confirm(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links among ``pairs`` (``a, b``): shared shingles are ``percent`` of all or more, on full sets.

    The sets of a pair meet at ``a``, whose pairs are dealt to tasks of bounded size.
    """
    pairs = cut(pairs.distinct())
    ways = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("ways"))
    dealt = pairs.join(ways, "a").withColumn("way", F.pmod(F.xxhash64("b"), F.col("ways")).cast("int"))
    centres = ways.select(F.col("a").alias("doc"), F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"), F.col("a").alias("centre"))
    wanted = cut(dealt.select(F.col("b").alias("doc"), "way", F.col("a").alias("centre")).unionByName(centres).groupBy("doc").agg(F.collect_list(F.struct("centre", "way")).alias("at")))
    small = wanted.count() <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(wanted) if small else wanted, "doc").select("doc", "text", "at")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = new_words()
        for batch in batches:
            raw, at = raw_texts(batch.column(1)), batch.column(2).to_pylist()
            names = batch.column(0).to_pylist()
            for part in pieces(raw):
                sets, bounds = shingle_sets(raw[part], width, words)
                rows = [(x["centre"], x["way"], names[i], six_bytes(sets[bounds[j] : bounds[j + 1]])) for j, i in enumerate(range(part.start, part.stop)) for x in at[i]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["centre", "way", "doc", "hashes"])

    def check(group: pa.Table) -> pa.Table:
        centre = group.column("centre")[0].as_py()
        names, raw = group.column("doc").to_pylist(), group.column("hashes").to_pylist()
        own = [np.unique(from_six(x)) for d, x in zip(names, raw, strict=True) if d == centre]
        linked = set()
        for d, x in zip(names, raw, strict=True):
            if d != centre:
                s = np.unique(from_six(x))
                for c in own:
                    common = len(np.intersect1d(s, c, assume_unique=True))
                    if common and 100 * common >= percent * (len(s) + len(c) - common):
                        linked.add(d)
        return pa.table([pa.array([centre] * len(linked), pa.int64()), pa.array(sorted(linked), pa.int64())], ["a", "b"])

    return texts.mapInArrow(spread, "centre long, way int, doc long, hashes binary").groupBy("centre", "way").applyInArrow(check, "a long, b long")


def shared_profiles(docs: DataFrame, members: DataFrame, n_members: int, width: int, fine: int) -> DataFrame:
    """``rep, u, fine``: how many shingles of a set any other of ``members`` has too, and the signature of those."""
    buckets = parts_for(n_members, 1000)
    texts = docs.join(F.broadcast(members) if n_members <= BROADCAST_ROWS else members, F.col("doc") == F.col("rep")).select("doc", "text")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = new_words()
        for batch in batches:
            raw, names = raw_texts(batch.column(1)), batch.column(0).to_numpy()
            for part in pieces(raw):
                sets, bounds = shingle_sets(raw[part], width, words)
                owner = np.repeat(names[part], np.diff(bounds))
                bucket = bucket_of(sets, buckets)
                rows = [(b, sets[bucket == b].tobytes(), owner[bucket == b].tobytes()) for b in range(buckets)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "hashes", "owners"])

    def answer(group: pa.Table) -> pa.Table:
        hashes = np.concatenate([np.frombuffer(x, U64) for x in group.column("hashes").to_pylist()])
        owner = np.concatenate([np.frombuffer(x, np.int64) for x in group.column("owners").to_pylist()])
        o = np.lexsort((owner, hashes))
        hashes, owner = hashes[o], owner[o]
        new = groups(hashes)
        start = np.flatnonzero(new)
        shared = (owner[start] != owner[np.append(start[1:], len(o)) - 1])[np.cumsum(new) - 1] if len(o) else np.zeros(0, bool)
        o = np.flatnonzero(shared)
        o = o[np.lexsort((hashes[o], owner[o]))]
        distinct = groups(owner[o], hashes[o])
        hashes, owner = hashes[o][distinct], owner[o][distinct]
        start = np.flatnonzero(groups(owner))
        sig = signatures(hashes, start, fine, 1)
        return pa.table([pa.array(owner[start]), pa.array(np.diff(np.append(start, len(owner)))), pa.array([s.tobytes() for s in sig], pa.binary())], ["rep", "u", "fine"])

    def unite(group: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(group.column("fine").to_pylist()), U64).reshape(len(group), fine).min(0)
        return pa.table([group.column("rep")[:1], pa.array([pc.sum(group.column("u")).as_py()], pa.int64()), pa.array([mix(sig).astype("<u4").tobytes()], pa.binary())], ["rep", "u", "fine"])

    parts = texts.mapInArrow(ask, "bucket int, hashes binary, owners binary").groupBy("bucket").applyInArrow(answer, "rep long, u long, fine binary")
    return parts.groupBy("rep").applyInArrow(unite, "rep long, u long, fine binary")


def cross_pairs(posts: DataFrame, matches: int, percent: int, fine: int) -> DataFrame:
    """``a, b``: members of a list in different components that may be linked.

    posts: ``list, size, rep, n, sig, component, u, fine``; ``u`` and ``fine`` are null in short lists. Long lists are
    cut in tiles, so that a task compares a bounded number of members. A pair that shares several lists comes from the
    one of the lowest coordinate alone.
    """
    masks = posts.groupBy(F.col("rep").alias("r")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftright(list, 32) AS int))")).alias("mask"))
    posts = posts.join(masks, F.col("rep") == F.col("r")).drop("r")
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    own = posts.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})

    def compare(group: pa.Table) -> pa.Table:
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        rep, comp, n, tile = (group.column(c).to_numpy() for c in ("rep", "component", "n", "tile"))
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u4").reshape(len(group), -1)
        mask = np.unpackbits(group.column("mask").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : sig.shape[1]].astype(bool)
        coordinate = group.column("list")[0].as_py() >> 32
        long = group.column("u").null_count == 0
        if long:
            u = group.column("u").to_numpy()
            shared = np.frombuffer(b"".join(group.column("fine").to_pylist()), "<u4").reshape(len(group), fine)
        out_a, out_b = [], []
        for i in range(len(rep)):
            other = (comp != comp[i]) & (rep > rep[i])
            if low != high:
                other &= tile != tile[i]
            if long:
                need = -(-percent * (n[i] + n) // (100 + percent))  # shared shingles that a link takes
                other &= np.minimum(u[i], u) >= need
            at = np.flatnonzero(other)
            same = sig[at] == sig[i]
            at = at[(same.sum(1) >= matches) & ((same & mask[at] & mask[i]).argmax(1) == coordinate)]
            if long and len(at):
                # of their shared shingles, so large a part must be common; allow 5.5 standard deviations
                part = need[at] / np.maximum(u[i] + u[at] - need[at], 1)
                least = fine * part - 5.5 * np.sqrt(np.maximum(fine * part * (1 - part), 0)) - 1
                at = at[(shared[at] == shared[i]).sum(1) >= least]
            out_a.append(np.full(len(at), rep[i]))
            out_b.append(rep[at])
        return pa.table([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return spread.select("list", "low", "high", "tile", "rep", "n", "sig", "component", "u", "fine", "mask").groupBy("list", "low", "high").applyInArrow(compare, "a long, b long")


def near_components(docs: DataFrame, sets: DataFrame, width: int, percent: int, coordinates: int, matches: int, fine: int) -> DataFrame:
    """``node, component`` of the linked sets; at most 64 ``coordinates``. docs: ``doc, text``; sets: ``rep, n, sig``, one row a distinct set."""
    posts = cut(postings(sets, sets.count(), coordinates, matches))
    links = cut(confirm(docs, star_pairs(posts, matches), width, percent))
    near = cut(components(links)) if not links.isEmpty() else None
    if near is None:
        placed = posts.withColumn("component", F.col("rep"))
    else:
        placed = posts.join(near, F.col("rep") == F.col("node"), "left").select("list", "rep", "n", "sig", F.coalesce("component", "rep").alias("component"))
    # a list whose members are in one component is done
    lists = placed.groupBy("list").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select(F.col("list").alias("l"), "size")
    placed = cut(placed.join(lists, F.col("list") == F.col("l")).select("list", "size", "rep", "n", "sig", "component"))
    long = cut(placed.where(F.col("size") > LONG_LIST).select("rep").distinct())
    n_long = long.count()
    if n_long:
        finer = cut(shared_profiles(docs, long, n_long, width, fine))
        own = finer.select(F.col("rep").alias("r"), "u", "fine")
        # a member without the shared shingles that any link takes has no link
        reach = placed.where(F.col("size") > LONG_LIST).join(own, F.col("rep") == F.col("r")).where(F.col("u") * 100 >= F.col("n") * percent).drop("r")
        short = placed.where(F.col("size") <= LONG_LIST).withColumns({"u": F.lit(None).cast("long"), "fine": F.lit(None).cast("binary")})
        placed = reach.unionByName(short)
    else:
        placed = placed.withColumns({"u": F.lit(None).cast("long"), "fine": F.lit(None).cast("binary")})
    more = confirm(docs, cross_pairs(placed, matches, percent, fine), width, percent)
    return components(links.unionByName(more))


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75, coordinates: int = 64, matches: int = 28, fine: int = 128) -> DataFrame:
    """Group documents whose sets of ``width``-word shingles have a Jaccard similarity of ``percent`` or more.

    Returns ``key, n_shingles, component_id, kept``, one row per input row; ``component_id`` is the smallest id that
    links reach and ``kept`` is true where it is the row's own. Links are confirmed on full sets; a pair at the
    threshold is missed with a chance of about one in 10**8 (``matches`` of ``coordinates``). Null and empty texts have
    no shingles and no links. ``key`` is an integer; rows with a null key have no links and are kept; rows with equal
    keys are one node. Texts of any length count whole, an empty table gives an empty result, other columns aren't read.
    """
    name = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    seen = cut(profiles(rows, width, coordinates))
    known = seen.where("doc IS NOT NULL AND mark IS NOT NULL")
    sets = cut(known.groupBy("mark").agg(F.min(F.struct("doc", "n", "sig")).alias("x")).select("mark", F.col("x.doc").alias("rep"), F.col("x.n").alias("n"), F.col("x.sig").alias("sig")))
    near = near_components(rows.where("doc IS NOT NULL"), sets.dropDuplicates(["rep"]), width, percent, coordinates, matches, fine)
    # equal keys with different texts are one node
    twice = known.groupBy("doc").agg(F.min("mark").alias("m1"), F.max("mark").alias("m2")).where("m1 <> m2").select("doc")
    ties = known.join(twice, "doc").join(sets.select("mark", "rep"), "mark").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    if not ties.isEmpty():
        ties = ties.unionByName(near.select(F.col("node").alias("a"), F.col("component").alias("b")))
        near = components(ties.where("a <> b"))
    of_mark = cut(sets.select("mark", "rep").join(near, F.col("rep") == F.col("node"), "left").select(F.col("mark").alias("m"), F.coalesce("component", "rep").alias("component")))
    out = seen.join(of_mark, F.col("mark") == F.col("m"), "left").select(
        F.col("doc").cast(name).alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).cast("long").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
