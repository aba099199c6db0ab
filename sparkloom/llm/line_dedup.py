"""Line dedup: fuzzy duplicates of lines by lists of rare word pairs, confirmed by edit similarity.

Lines are normalised; equal ones are one line. An edit of one word changes two of a line's pairs of neighbouring words
at most, so two lines within k edits share one of the 2 k + 1 rarest pairs of either, under any common order of
rarity, and meet in that pair's list. Lists are first compared with their first line, then lines that are still in
different groups with each other, where parity sketches rule out most pairs: a word more or less flips one bit of a
sketch, so lines within k edits are within 2 k bits, without exception. Pairs whose edit similarity suffices are links;
of every connected group of lines the first occurrence stays.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import U64, bucket_of, from_six, groups, mix, six_bytes
from .common import cut, drop, parts_for, table
from .components import components
from .near_dedup import BROADCAST_ROWS, TILE, pieces, raw_texts

#: Bits of a parity sketch.
BITS = 256
#: Array entries that may be sent to every executor: 8 bytes each.
BROADCAST_ENTRIES = 2_000_000
#: Bits of a number that tells the words of a bitmap apart.
BITMAP = 20
#: Classes of line length between those of two similar lines.
APART = 4
#: How many of the most common words are told apart, which only orders word pairs, and distinct words that a task holds.
COMMON, WORDS = 200_000, 1 << 20
#: Bytes of text whose words are told apart at once, and the longest word that is not hashed by itself.
HASHED, LONG = 1 << 18, 64
#: A fixed random number for each byte, and powers of an odd number and of its inverse modulo 2 ** 64.
_LETTER = np.random.default_rng(7).integers(0, 1 << 63, 256, np.int64).astype(np.uint64) << np.uint64(1) | np.uint64(1)
_POWER, _BACK = (np.cumprod(np.full(HASHED + LONG, x, np.uint64)) for x in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)))
_KINDS = bytes(
    ord(chr(b).lower()) if chr(b).isascii() and chr(b).isupper() else b if b >= 128 or chr(b).isalnum() or b == 10 else 32
    for b in range(256)
)


#: Letters of scripts without blanks (Thai, kana, ideographs, Hangul): each counts as a word. Fixed values of UTF-8.
_BLANKLESS = re.compile(rb"\xe0[\xb8\xb9][\x80-\xbf]|[\xe3-\xed][\x80-\xbf]{2}")
#: All bytes but those that such a letter begins with.
_OTHER = bytes(b for b in range(256) if b != 0xE0 and not 0xE3 <= b <= 0xED)


def normal(text: bytes) -> bytes:
    """A-Z lower-cased, digits and ends of lines kept, other ASCII marks as blanks."""
    text = text.translate(_KINDS)
    return _BLANKLESS.sub(rb" \g<0> ", text) if not text.isascii() and text.translate(None, _OTHER) else text


def normal_lines(text: bytes) -> list[list[bytes]]:
    """The words of each line."""
    return [line.split() for line in normal(text).split(b"\n")]


def word_hashes(letters: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word, for whole arrays: sums of its bytes' numbers times powers, cut from running sums."""
    out, lo = np.empty(len(begin), U64), 0
    while lo < len(begin):
        hi = max(lo + 1, int(np.searchsorted(end, begin[lo] + HASHED, "right")))
        at, size = begin[lo], min(int(end[hi - 1] - begin[lo]), HASHED)
        total = np.zeros(size + 1, U64)
        np.cumsum(_LETTER[letters[at : at + size]] * _POWER[:size], out=total[1:])
        first = begin[lo:hi] - at
        out[lo:hi] = (total[np.minimum(end[lo:hi] - at, size)] - total[first]) * _BACK[first]
        lo = hi
    for i in np.flatnonzero(end - begin > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(letters[begin[i] : end[i]].tobytes())
    return out


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a normalised text, and where each of its words begins and ends."""
    letters = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], letters > 32, [False]))))  # blanks and ends of lines are below
    return letters, edges[::2], edges[1::2]


def told_apart(raw: bytes, letters: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each of these words, and each number's hash."""
    code = pa.array(word_hashes(letters, begin, end)).dictionary_encode()
    number = code.indices.to_numpy()
    first = np.empty(len(code.dictionary), np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    return number, np.array([xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(begin[first].tolist(), end[first].tolist(), strict=True)], U64)


def numbered(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each word, each number's hash, and the words of each line."""
    ids: dict[bytes, int] = {}
    flat = np.array([ids.setdefault(w, len(ids)) for line in words for w in line], np.int64)
    return flat, np.array([xxhash.xxh3_64_intdigest(w) for w in ids], U64), np.array([len(line) for line in words], np.int64)


def sketches(coded: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """A row of 64-bit values for each line: bit b is the parity of the words whose hash is b."""
    flat, h, sizes = coded
    bit = (mix(h) % U64(BITS)).astype(np.int64)
    out, step, ends = np.empty((len(sizes), BITS // 64), U64), 4096, np.concatenate(([0], np.cumsum(sizes)))
    for at in range(0, len(sizes), step):
        part = sizes[at : at + step]
        cell = np.repeat(np.arange(len(part)) * BITS, part) + bit[flat[ends[at] : ends[at + len(part)]]]
        odd = (np.bincount(cell, minlength=len(part) * BITS) & 1).astype(np.uint8)
        out[at : at + step] = np.packbits(odd).view(U64).reshape(len(part), -1)
    return out


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64)


def allowed(n: np.ndarray, similarity: float) -> np.ndarray:
    """Edits between two lines of which the longer has ``n`` words."""
    return ((1 - similarity) * n).astype(np.int64)


def prefix(n: np.ndarray, similarity: float) -> np.ndarray:
    """How many of a line's rarest pairs two similar lines must share one of; 0 if no other line can be similar.

    A partner ``d`` words longer has ``d`` insertions among its edits, and an insertion changes one pair only.
    """
    if similarity <= 0.5:
        raise ValueError("similarity must be above 0.5")
    most = np.zeros(len(n), np.int64)
    for d in range(int(1 / (1 - similarity)) + 2 if similarity < 1 else 0):
        edits = allowed(n + d, similarity)
        most = np.maximum(most, np.where(edits >= d, 2 * edits - d, 0))
    return np.where(most > 0, most + 1, 0)


def length_class(n: np.ndarray, similarity: float) -> np.ndarray:
    """A number that grows with a line's words, from 0 to 254: those of similar lines are ``APART`` apart at most."""
    step = max(-1.0001 * np.log(similarity), 1e-6) / APART
    return np.minimum(np.log(np.maximum(n, 1)) / step, 254).astype(np.uint8)


def segments(key: np.ndarray, kind: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The list that each entry belongs to: 0 if it is alone in it, else one more than the list's smallest class.

    A key's entries are cut between neighbours of more than ``APART`` classes, since no similar lines lie on both sides.
    """
    o = np.lexsort((kind, key))
    new = groups(key[o])
    new[1:] |= np.diff(kind[o].astype(np.int64)) > APART
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(o)))
    total = np.add.reduceat(n[o], begin) if len(begin) else n
    out = np.zeros(len(o), np.uint8)
    out[o] = np.repeat(np.where(total > 1, kind[o][begin].astype(np.int64) + 1, 0), size)
    return out


def rare_pairs(coded: tuple[np.ndarray, np.ndarray, np.ndarray], common: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each line's rarest pairs of neighbouring words, one more than its edits can change, and their bounds.

    A pair that occurs again in its line is another key. ``common`` has hashes, sorted, and counts of common words. The
    rarer word of a pair weighs more, since words of one phrase are common together; of like ones the other word decides.
    """
    flat, h, sizes = coded
    need = prefix(sizes, similarity)
    weight = np.zeros(len(h), np.float64)
    if len(common[0]) and len(h):
        at = np.minimum(np.searchsorted(common[0], h), len(common[0]) - 1)
        weight = np.log2(np.where(common[0][at] == h, np.maximum(common[1][at], 1), 1))
    line = np.repeat(np.arange(len(sizes)), sizes)
    left = np.flatnonzero((line[1:] == line[:-1]) & (need[line[:-1]] > 0)) if len(line) else np.zeros(0, np.int64)
    a, b, line = flat[left], flat[left + 1], line[left]
    key, rarity = mix(h[a] + mix(h)[b]), weight[a] + weight[b] + np.minimum(weight[a], weight[b])
    # one number orders the pairs of a line: how common, in 16 bits, then the low bits of the key
    code = np.minimum(np.rint(rarity * 400), 65535).astype(U64) << U64(48) | key & U64((1 << 48) - 1)
    o = np.argsort(code)
    o = o[np.argsort(line[o].astype(np.uint16) if len(sizes) <= 1 << 16 else line[o], kind="stable")]
    same = (line[o][1:] == line[o][:-1]) & (code[o][1:] == code[o][:-1])
    if (same & (key[o][1:] != key[o][:-1])).any():
        o = np.lexsort((key, code, line))
    key, line = key[o], line[o]
    new = np.flatnonzero(groups(line, key))
    key = mix(key + (np.arange(len(key)) - np.repeat(new, np.diff(np.append(new, len(key))))).astype(U64))
    count = np.bincount(line, minlength=len(sizes))
    place = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
    bounds = np.concatenate(([0], np.cumsum(np.minimum(count, need))))
    return key[place < need[line]], bounds


def common_words(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts in all documents of the most common words. Which ones these are changes no result."""

    def rows(found: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(found).group_by("word").aggregate([("n", "sum")])
        yield from t.select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[pa.Table] = []
        for batch in batches:
            for part in pieces(raw := raw_texts(batch.column(0))):
                text = b"\n".join(map(normal, raw[part]))
                number, h = told_apart(text, *words_of(text))
                found.append(pa.table([pa.array(h).view(pa.int64()), pa.array(np.bincount(number, minlength=len(h)))], ["word", "n"]))
                if sum(map(len, found)) > WORDS:
                    yield from rows(found)
                    found = []
        if found:
            yield from rows(found)

    found = docs.select("text").mapInArrow(find, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    t = found.where("n > 2").orderBy(F.desc("n"), "word").limit(COMMON).toArrow()
    word, n = t.column("word").to_numpy().astype(U64), t.column("n").to_numpy()
    o = np.argsort(word)
    return word[o], n[o]


def occurrences(docs: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """``doc, mark, line, id, n, body, sketch, pairs``: every line of enough words; what describes it goes with its first row in a task's batch."""
    common = common_words(docs)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = raw_texts(batch.column(2))
            for part in pieces(raw):
                texts = list(map(normal, raw[part]))
                letters, begin, end = words_of(text := b"\n".join(texts))
                starts = np.concatenate(([0], np.flatnonzero(letters == 10) + 1))
                words = np.searchsorted(begin, np.append(starts, len(letters) + 1))
                of = np.cumsum([0] + [x.count(b"\n") + 1 for x in texts])  # a text's first line
                line = np.flatnonzero(np.diff(words) >= max(1, min_words))
                if not len(line):
                    continue
                # words joined by single blanks: each with one byte behind it
                keep = letters > 32
                keep[1:] |= keep[:-1] & ~keep[1:]
                joined, ends = np.where(letters[keep] > 32, letters[keep], 32).astype(np.uint8).tobytes(), np.concatenate(([0], np.cumsum(end - begin + 1)))
                bodies = [joined[x : y - 1] for x, y in zip(ends[words[line]].tolist(), ends[words[line + 1]].tolist(), strict=True)]
                ids = np.array([xxhash.xxh3_64_intdigest(x) >> 1 for x in bodies], np.int64)
                new = np.sort(np.unique(ids, return_index=True)[1])
                sizes = np.diff(words)[line[new]]
                at = np.repeat(words[line[new]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                coded = (*told_apart(text, letters, begin[at], end[at]), sizes)
                keys, bounds = rare_pairs(coded, common, similarity)
                raw_keys, bounds = six_bytes(keys), (6 * bounds).tolist()
                size: list[int | None] = [None] * len(ids)
                body: list[bytes | None] = [None] * len(ids)
                sketch: list[bytes | None] = [None] * len(ids)
                pairs: list[bytes | None] = [None] * len(ids)
                for j, (k, n, s) in enumerate(zip(new.tolist(), sizes.tolist(), sketches(coded), strict=True)):
                    size[k] = n
                    if bounds[j] < bounds[j + 1]:  # no other line can be similar to the rest
                        body[k], sketch[k], pairs[k] = bodies[k], s.tobytes(), raw_keys[bounds[j] : bounds[j + 1]]
                owner = np.searchsorted(of, line, "right") - 1
                rows, number = pa.array(part.start + owner), pa.array(line - of[owner])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), number, pa.array(ids), pa.array(size, pa.int32()), pa.array(body, pa.binary()).cast(pa.string()), pa.array(sketch, pa.binary()), pa.array(pairs, pa.binary())], names=["doc", "mark", "line", "id", "n", "body", "sketch", "pairs"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.select("doc", "mark", "text").mapInArrow(find, f"doc {kind}, mark long, line long, id long, n int, body string, sketch binary, pairs binary")


def postings(lines: DataFrame, n_lines: int, similarity: float) -> DataFrame:
    """``list, rep, n``: each line under those of its word pairs that another line of like length has too.

    lines: ``rep, n, pairs``, where a line may come several times. How many have a pair is asked of the pair's bucket;
    a block of lines asks once for each distinct pair and class of length, by 32 bits within the bucket: pairs taken for
    one another only make a list longer than it need be. A pair's lines are one list for each run of classes.
    """
    blocks = buckets = parts_for(n_lines * 16, 1 << 20)
    rows = lines.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int"))

    def keys_of(group: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        group = group.sort_by("rep")
        group = group.filter(pa.array(groups(group.column("rep").to_numpy())))
        raw = group.column("pairs").to_pylist()
        row = np.repeat(np.arange(len(raw)), [len(x) // 6 for x in raw])
        kind = length_class(group.column("n").to_numpy(), similarity).astype(U64)[row]
        distinct, where, times = np.unique(from_six(b"".join(raw)) << U64(8) | kind, return_inverse=True, return_counts=True)
        return group, row, distinct >> U64(8), (distinct & U64(255)).astype(np.uint8), where, times

    def by_bucket(distinct: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        bucket = bucket_of(mix(distinct), buckets)
        o = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[o], np.arange(buckets + 1))
        for b in range(buckets):
            if edges[b] < edges[b + 1]:
                yield b, o[edges[b] : edges[b + 1]]

    def ask(group: pa.Table) -> pa.Table:
        group, _, distinct, kind, _, times = keys_of(group)
        out = [(b, group.column("block")[0].as_py(), distinct[at].astype("<u4").tobytes(), kind[at].tobytes(), np.packbits(times[at] > 1).tobytes()) for b, at in by_bucket(distinct)]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "keys", "kinds", "more"])

    def answer(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<u4") for x in group.column("keys").to_pylist()]
        kinds = np.frombuffer(b"".join(group.column("kinds").to_pylist()), np.uint8)
        more = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(group.column("more").to_pylist(), parts, strict=True)])
        shared = segments(np.concatenate(parts), kinds, 1 + more.astype(np.int64))
        said = [x.tobytes() for x in np.split(shared, np.cumsum([len(p) for p in parts])[:-1])]
        return pa.table([group.column("block"), group.column("bucket"), pa.array(said, pa.binary())], ["block", "bucket", "shared"])

    def post(group: pa.Table, replies: pa.Table) -> pa.Table:
        group, row, distinct, _, where, _ = keys_of(group)
        said = dict(zip(replies.column("bucket").to_pylist(), replies.column("shared").to_pylist(), strict=True))
        shared = np.zeros(len(distinct), np.uint8)
        for b, at in by_bucket(distinct):
            shared[at] = np.frombuffer(said[b], np.uint8)
        at = np.flatnonzero(shared[where])
        lists = (distinct << U64(8) | shared)[where[at]].astype(np.int64)
        row = pa.array(row[at])
        return pa.table([pa.array(lists), *(group.column(c).take(row) for c in ("rep", "n"))], ["list", "rep", "n"])

    asked = rows.groupBy("block").applyInArrow(ask, "bucket int, block int, keys binary, kinds binary, more binary")
    replies = asked.groupBy("bucket").applyInArrow(answer, "block int, bucket int, shared binary")
    return rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(post, "list long, rep long, n int")


def compared_with_first(posts: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: the first line of each list and every other one of a similar length; ``list, rep, n``: lists of three and more.

    Lists stream through their task, which holds two rows of a list at most. A pair has null ``list``, and in ``n`` how
    many bits apart the sketches of similar lines of these lengths can be.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 3), np.int64)  # the first rows, up to two, of the list that may go on
        seen = 0  # how many rows of it there were
        for batch in batches:
            if not len(batch):
                continue
            rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
            before = len(held)
            old = seen if before and held[0, 0] == rows[0, 0] else 0
            if not old:
                before, held = 0, held[:0]
            rows = np.concatenate([held, rows])
            lists, reps, n = rows.T
            begin = np.flatnonzero(groups(lists))
            size = np.diff(np.append(begin, len(rows)))
            where = np.repeat(begin, size)
            a, na = reps[where], n[where]
            near = (a != reps) & (np.abs(na - n) <= allowed(np.maximum(na, n), similarity))
            near[:before] = False
            total = size.copy()
            total[0] += max(0, old - before)
            long = np.repeat(total > 2, size)
            if old > 2:
                long[:before] = False  # given out already
            x, y = a[near], reps[near]
            bits = (2 * allowed(np.maximum(na, n), similarity) - np.abs(na - n))[near]
            out = [np.concatenate((v, np.zeros(long.sum(), np.int64))) for v in (x, y)] + [np.concatenate((np.zeros(len(x), np.int64), v[long])) for v in (lists, reps)]
            post = np.arange(len(out[0])) >= len(x)
            yield pa.RecordBatch.from_arrays([pa.array(v, mask=post) for v in out[:2]] + [pa.array(v, mask=~post) for v in out[2:]] + [pa.array(np.concatenate((bits, n[long])))], names=["a", "b", "list", "rep", "n"])
            held, seen = rows[begin[-1] : begin[-1] + 2], int(total[-1])

    return posts.select("list", "rep", "n").repartition("list").sortWithinPartitions("list", "rep").mapInArrow(compare, "a long, b long, list long, rep long, n long")


def within(x: list, y: list, most: int) -> bool:
    """Whether ``most`` inserted, deleted or replaced words turn one line into the other: bits of one column at a time."""
    at = 0
    while at < min(len(x), len(y)) and x[at] == y[at]:
        at += 1
    x, y = x[at:], y[at:]
    while x and y and x[-1] == y[-1]:
        x, y = x[:-1], y[:-1]
    if not x or not y or abs(len(x) - len(y)) > most:
        return max(len(x), len(y)) <= most
    here: dict = {}
    for i, w in enumerate(x):
        here[w] = here.get(w, 0) | 1 << i
    whole, last, up, down, edits = (1 << len(x)) - 1, 1 << len(x) - 1, (1 << len(x)) - 1, 0, len(x)
    for left, w in zip(range(len(y) - 1, -1, -1), y, strict=True):
        same = here.get(w, 0)
        across = (((same & up) + up) ^ up) | same
        rise, fall = down | ~(across | up) & whole, up & across
        edits += bool(rise & last) - bool(fall & last)
        if edits - left > most:
            return False
        rise, fall = rise << 1 & whole | 1, fall << 1 & whole
        same |= down
        up, down = fall | ~(same | rise) & whole, rise & same
    return edits <= most


def alike(x: list, y: list, most: int) -> bool:
    """As ``within``, after a look at lines that differ in replaced words only, and at words that one line alone has."""
    if abs(len(x) - len(y)) > most:
        return False
    if len(x) == len(y) and sum(map(operator.ne, x, y)) <= most:
        return True
    return len(set(x) ^ set(y)) <= 2 * most and within(x, y, most)


def with_ids(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose ``id`` may be among the wanted ones, and all of those.

    A bitmap of the wanted ids, of ``2 ** BITMAP`` numbers at most whatever the input, goes to every executor, so that
    most lines that nobody wants stay out of the shuffle.
    """
    word, bit = F.shiftright("id", 63 - BITMAP), F.col("id").bitwiseAND(F.lit(63)).cast("int")
    bits = wanted.groupBy(word.alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(id & 63 AS int)))").alias("bits"))
    return rows.join(F.broadcast(bits), word == F.col("word")).where(F.getbit("bits", bit) == 1).select(*rows.columns)


def column_of(seen: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``id`` and a column of the wanted lines (``id``), from a row that has it."""
    wanted = cut(ids.distinct())
    some = with_ids(seen.select("id", column).where(F.col(column).isNotNull()), wanted)
    return some.join(wanted, "id", "left_semi").groupBy("id").agg(F.first(column).alias(column))


def similar(seen: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Links among ``pairs`` (``a, b, n``): edit distance in words at most ``1 - similarity`` of the longer normalised line.

    Sketches come first (``n`` bits at most apart), and the words of what they leave.
    """
    pairs = cut(pairs)

    def both(left: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        of = cut(column_of(seen, left.select(F.col("a").alias("id")).unionAll(left.select(F.col("b").alias("id"))), column))
        return of, left.join(of.select(F.col("id").alias("a"), F.col(column).alias("x")), "a").join(of.select(F.col("id").alias("b"), F.col(column).alias("y")), "b")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), U64).reshape(len(batch), -1) for i in (3, 4))
            yield batch.select(["a", "b"]).filter(pa.array(distance(x, y) <= batch.column(2).to_numpy()))

    described, rows = both(pairs, "sketch")
    left = cut(rows.select("a", "b", "n", "x", "y").mapInArrow(close, "a long, b long"))
    drop(pairs, described)
    _, texts = both(left, "body")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(*(batch.column(i).to_pylist() for i in (2, 3)), strict=True):
                x, y = x.split(" "), y.split(" ")
                ok.append(alike(x, y, int((1 - similarity) * max(len(x), len(y)))))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return texts.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def in_tiles(posts: DataFrame) -> DataFrame:
    """Lists cut in tiles of bounded size: a row goes to every pair of tiles that its own is one of."""
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    own = posts.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    return own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})


def tile_pairs(t: pa.Table, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of two rows of one pair of tiles that can be links: neighbours one apart, then two apart, and so on."""
    key = [t.column(c).to_numpy() for c in ("list", "low", "high")]
    comp, tile, n = (t.column(c).to_numpy().astype(np.int64) for c in ("component", "tile", "n"))
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), U64).reshape(len(t), -1)
    left = np.diff(np.append(np.flatnonzero(groups(*key)), len(t)))
    end = np.repeat(np.cumsum(left), left)
    live, lag = np.arange(len(t)), 1
    while len(live := live[live + lag < end[live]]):
        x, y = live, live + lag
        ok = (comp[x] != comp[y]) & ((tile[x] != tile[y]) | (key[1][x] == key[2][x]))
        x, y = x[ok], y[ok]
        edits, apart = allowed(np.maximum(n[x], n[y]), similarity), np.abs(n[x] - n[y])
        ok = apart <= edits
        x, y, most = x[ok], y[ok], (2 * edits - apart)[ok]
        ok = distance(sketch[x], sketch[y]) <= most
        yield x[ok], y[ok]
        lag += 1


def whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole pairs of tiles; a pair has two tiles at most, and may go on in the next batch."""
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        if not len(t):
            continue
        begin = np.flatnonzero(groups(*(t.column(c).to_numpy() for c in ("list", "low", "high"))))[-1]
        if begin:
            yield t.slice(0, begin).combine_chunks()
        held = t.slice(begin)
    if held is not None:
        yield held.combine_chunks()


def other_links(posts: DataFrame, seen: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links between lines of a list that are in different groups; a list of m lines gives less than m a tile.

    posts: ``list, size, rep, n, component``. Sketches leave few rows; these get their words, and are compared. Lines
    that meet in several lists are possible links in all of them, and are compared in the lowest alone.
    """
    keys = ["list", "low", "high"]
    described = column_of(seen, posts.select(F.col("rep").alias("id")), "sketch").withColumnRenamed("id", "rep")
    rows = in_tiles(posts.join(described, "rep")).select(*keys, "tile", "rep", "n", "component", "sketch")

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_tiles(batches):
            met = np.zeros(len(t), bool)
            for x, y in tile_pairs(t, similarity):
                met[x] = met[y] = True
            yield from t.filter(pa.array(met)).to_batches()

    kinds = "list long, low int, high int, tile int, rep long, n long, component long, sketch binary"
    left = cut(rows.repartition(*keys).sortWithinPartitions(*keys, "rep").mapInArrow(active, kinds))
    lists = left.groupBy("rep").agg(F.collect_set("list").alias("lists"))  # no more than a line's rarest pairs
    described = column_of(seen, left.select(F.col("rep").alias("id")), "body").withColumnRenamed("id", "rep").join(lists, "rep")
    texts = left.join(described, "rep").withColumn("lower", F.filter("lists", lambda x: x < F.col("list")))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_tiles(batches):
            rep, words, before, root, out = t.column("rep").to_pylist(), {}, {}, {}, []
            bodies, lower = t.column("body"), t.column("lower")
            # a group of lines is one node of its list; each row's list and tiles are in its node's name
            number = np.cumsum(groups(*(t.column(c).to_numpy() for c in keys)))
            node = list(zip(number.tolist(), t.column("component").to_pylist(), strict=True))

            def find(x):
                while (up := root.get(x, x)) != x:
                    root[x] = x = root.get(up, up)
                return x

            for xs, ys in tile_pairs(t, similarity):
                for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
                    if (a := find(node[x])) == (b := find(node[y])):
                        continue
                    for i in (x, y):
                        if i not in words:
                            words[i], before[i] = bodies[i].as_py().split(" "), frozenset(lower[i].as_py())
                    if before[x].isdisjoint(before[y]) and alike(words[x], words[y], int((1 - similarity) * max(len(words[x]), len(words[y])))):
                        root[a] = b
                        out.append((rep[x], rep[y]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return texts.select(*keys, "tile", "rep", "n", "component", "sketch", "body", "lower").repartition(*keys).sortWithinPartitions(*keys, "rep").mapInArrow(link, "a long, b long").distinct()


def fuzzy_groups(seen: DataFrame, n_lines: int, similarity: float) -> DataFrame:
    """``node, component`` of the lines that have a link."""
    posts = cut(compared_with_first(postings(seen.where("pairs IS NOT NULL").select(F.col("id").alias("rep"), "n", "pairs"), n_lines, similarity), similarity))
    links = cut(similar(seen, posts.where("list IS NULL").select("a", "b", "n").distinct(), similarity))
    near = cut(components(links))
    few = near.count() <= BROADCAST_ROWS
    placed = posts.where("list IS NOT NULL").join(F.broadcast(near) if few else near, F.col("rep") == F.col("node"), "left").select("list", "rep", "n", F.coalesce("component", "rep").alias("component"))
    # a list whose lines are in one group is done, and one of two lines was compared
    lists = cut(placed.groupBy("list").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("list", "size"))
    more = cut(other_links(placed.join(lists, "list"), seen, similarity))
    found = components(links.unionByName(more))
    drop(posts, links, near, lists, more)
    return found


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 1, similarity: float = 0.85) -> DataFrame:
    """Remove every line that repeats an earlier one exactly or nearly; all input columns return, with ``text`` replaced.

    Adds ``n_lines`` and ``n_removed``. Lines are split at ``\\n``. Lines without a word, and of fewer than ``min_words``
    normalised words, always stay; letters of scripts without blanks count as words. Equal normalised lines are linked,
    and all others whose edit similarity in words is ``similarity`` or more (so of six words at least, at 0.85). Of each
    connected group the first occurrence by (key, line number) stays; null keys come first. Null texts stay null, empty
    ones empty, both with no line removed. Rows equal in key and text are treated alike. Texts of any length count
    whole; an empty table gives an empty result; input columns named ``n_lines`` or ``n_removed`` are replaced.
    """
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    seen = cut(occurrences(rows, min_words, similarity))
    # the first occurrence, as (key is not null, key, text, line)
    place = F.struct(F.col("doc").isNotNull().alias("known"), "doc", "mark", "line")
    lines = cut(seen.groupBy("id").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")))
    near = fuzzy_groups(seen, lines.count(), similarity)
    # lines without an equal or a similar one are not looked at again
    linked = cut(near.select(F.col("node").alias("id"), "component"))
    placed = with_ids(lines, linked).join(linked, "id").select("id", "first", "times", F.col("component").alias("group"))
    equal = lines.where("times > 1").join(linked, "id", "left_anti").select("id", "first", "times", F.col("id").alias("group"))
    placed = cut(placed.unionByName(equal))
    firsts = placed.groupBy(F.col("group").alias("g")).agg(F.min("first").alias("stays"), F.sum("times").alias("all")).where("all > 1")
    groups_ = cut(placed.join(firsts, F.col("group") == F.col("g")).select("id", "stays"))
    gone = with_ids(seen.select("id", "doc", "mark", "line"), groups_).join(groups_, "id").where(
        ~(F.col("doc").eqNullSafe(F.col("stays.doc")) & (F.col("mark") == F.col("stays.mark")) & (F.col("line") == F.col("stays.line")))
    )
    gone = cut(gone.groupBy("doc", "mark").agg(F.array_sort(F.collect_set("line")).alias("gone")).select(F.col("doc").alias("__op_doc"), F.col("mark").alias("__op_mark"), F.col("gone").alias("__op_gone")))
    size = gone.agg(F.coalesce(F.sum(F.size("__op_gone") + 4), F.lit(0))).first()[0]
    drop(seen, lines, linked, placed, groups_)
    out = docs.join(F.broadcast(gone) if size <= BROADCAST_ENTRIES else gone, F.col(key).eqNullSafe(F.col("__op_doc")) & (F.xxhash64(text) == F.col("__op_mark")), "left")
    split = F.split(F.col(text), "\n")
    kept = F.transform(
        F.filter(F.arrays_zip(split.alias("l"), F.sequence(F.lit(0).cast("long"), F.size(split).cast("long") - 1).alias("i")), lambda x: ~F.array_contains("__op_gone", x["i"])),
        lambda x: x["l"],
    )
    return out.withColumns({
        "n_lines": F.coalesce(F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"))) + 1, F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.size("__op_gone"), F.lit(0)).cast("long"),
        text: F.when(F.col("__op_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")),
    }).drop("__op_doc", "__op_mark", "__op_gone")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
