"""Suffix-array dedup: a depth-limited radix sort of suffixes over the whole corpus.

Only the first ``length`` bytes of a suffix matter (its window), and equal windows must meet. The first digit is the
hash of the window's smallest ``seed``-byte substring: neighbouring windows share it, so a run of them travels as one
record, and a run whose digit occurs in one document is done. The second digit is the run's whole content: runs equal
to one of a smaller document are done too. What is left are the borders of repeats; their windows are sorted by eight
bytes a pass, most significant first, dropping what stands alone, until equal groups are exactly the repeated windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .blocks import ODD, U64, bucket_of, from_rising, from_six, groups, in_blocks, mix, rising, six_bytes
from .common import parts_for, table, volume

NONE, WHOLE, WINDOWS = 0, 1, 2
_MULTIPLIERS = [U64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA5A3564E27F8862B, 0xC2B2AE3D27D4EB4F)]
#: Bytes of text that are hashed together; bounds the arrays of a task.
PIECE = 2 << 20


def _table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * _MULTIPLIERS[0])


def runs_of(buf: np.ndarray, doc: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with one digit: first byte, windows, digit, content."""
    n = len(buf)
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(U64), z.astype(U64)
    power = {1: _table()[buf]}
    size = 1
    while size * 2 <= min(seed, 16):
        h = power[size]
        power[size * 2] = h[:-size] * _MULTIPLIERS[size.bit_length() - 1] + h[size:]
        size *= 2
    base = power[size]
    digit = base[: n - seed + 1] * _MULTIPLIERS[4] + base[seed - size :]  # two overlapping parts cover the seed
    digit *= ODD
    digit ^= digit >> U64(32)
    span, low, have = length - seed + 1, digit, 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    low = np.minimum(low[: len(digit) - span + 1], low[span - have :])
    valid = doc[: n - length + 1] == doc[length - 1 :]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | new[1:]
    first, count = np.flatnonzero(new), np.flatnonzero(last) - np.flatnonzero(new) + 1
    if len(count) and count.max() > span:  # a repetitive stretch: the digit recurs
        parts = -(-count // span)
        part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        whole = np.repeat(count, parts)
        first = np.repeat(first, parts) + part * span
        count = np.minimum(span, whole - part * span)
    steps = [*range(0, length - size, size), length - size]

    def window(at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), U64)
        for s in steps:
            out = mix(out + base[at + s])
        return out

    content = mix(window(first) + mix(window(first + count - 1) * ODD + count.astype(U64)))
    return first, count, mix(low[first]), content


class Block:
    """The documents of a block in the order of their ids, and their runs."""

    def __init__(self, group: pa.Table, length: int, seed: int):
        ids = pc.fill_null(group.column("doc").cast(pa.int64()), np.iinfo(np.int64).max).to_numpy()
        raw = group.column("text").cast(pa.large_binary()).to_pylist()
        order = np.lexsort((np.array([len(x) for x in raw]), ids))
        self.order, self.ids = order, ids[order]
        self.texts = [raw[i] for i in order]
        found, at = [], 0
        while at < len(self.texts):
            stop, room = at, PIECE
            while stop < len(self.texts) and (stop == at or room > 0):
                room -= len(self.texts[stop])
                stop += 1
            sizes = np.array([len(x) for x in self.texts[at:stop]])
            doc = np.repeat(np.arange(at, stop), sizes)
            first, count, digit, content = runs_of(np.frombuffer(b"".join(self.texts[at:stop]), np.uint8), doc, length, seed)
            owner = doc[first]
            found.append((owner, first - (np.cumsum(sizes) - sizes)[owner - at], count, digit, content))
            at = stop
        self.owner, self.first, self.count, self.digit, self.content = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
        # distinct runs, each with its smallest document; `same`: the distinct run of each run
        o = np.lexsort((self.owner, self.content, self.digit))
        new = groups(self.digit[o], self.content[o])
        self.same = np.empty(len(o), np.int64)
        self.same[o] = np.cumsum(new) - 1
        self.lead = o[new]  # the run that stands for each distinct run

    def asked(self, buckets: int) -> list[tuple[int, np.ndarray]]:
        """Distinct runs by bucket, in the order of documents."""
        lead = np.sort(self.lead)
        bucket = bucket_of(self.digit[lead], buckets)
        o = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[o], np.arange(buckets + 1))
        return [(b, lead[o[edges[b] : edges[b + 1]]]) for b in range(buckets) if edges[b] < edges[b + 1]]


def judge_runs(messages: list[tuple[bytes, bytes, bytes]]) -> list[np.ndarray]:
    """For each message (digits, contents, documents): a state for each of its runs."""
    digit = np.concatenate([from_six(m[0]) for m in messages])
    content = np.concatenate([from_six(m[1]) for m in messages])
    doc = np.concatenate([from_rising(m[2]) for m in messages])
    state = np.zeros(len(digit), np.uint8)
    o = np.argsort(digit, kind="stable")
    start = np.flatnonzero(groups(digit[o]))
    alone = np.minimum.reduceat(doc[o], start) == np.maximum.reduceat(doc[o], start)
    many = o[np.repeat(~alone, np.diff(np.append(start, len(o))))]
    if len(many):
        many = many[np.lexsort((doc[many], content[many], digit[many]))]
        by_content = groups(digit[many], content[many])
        least = doc[many][by_content][np.cumsum(by_content) - 1]
        state[many[doc[many] > least]] = WHOLE
        by_digit = groups(digit[many])
        kinds = np.add.reduceat(by_content.astype(np.int64), np.flatnonzero(by_digit))[np.cumsum(by_digit) - 1]
        state[many[(doc[many] == least) & (kinds > 1)]] = WINDOWS
    return np.split(state, np.cumsum([len(m[0]) // 6 for m in messages])[:-1])


def repeated_windows(window: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows (rows of bytes) also lie in a smaller document: most-significant-digit passes of eight bytes."""
    n, length = window.shape
    padded = np.zeros((n, -(-length // 8) * 8), np.uint8)
    padded[:, :length] = window
    digits = padded.view(">u8").astype(U64)
    live, group = np.arange(n), np.zeros(n, np.int64)
    for d in range(digits.shape[1]):
        value = digits[live, d]
        o = np.lexsort((value, group))
        live, new = live[o], groups(group[o], value[o])
        group = np.cumsum(new) - 1
        keep = np.bincount(group, minlength=1)[group] > 1 if len(live) else np.zeros(0, bool)
        live, group = live[keep], group[keep]
    out = np.zeros(n, bool)
    if len(live):
        start = np.flatnonzero(groups(group))
        least = np.minimum.reduceat(doc[live], start)
        out[live] = doc[live] > np.repeat(least, np.diff(np.append(start, len(live))))
    return out


def expand(raw: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """The windows of runs whose bytes lie one after the other."""
    sizes = count + length - 1
    begin = np.repeat(np.cumsum(sizes) - sizes, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.lib.stride_tricks.sliding_window_view(raw, length)[begin] if len(begin) else np.zeros((0, length), np.uint8)


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, seed: int = 20, block_bytes: int = 6 << 20, with_text: bool = False) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts in a document with a smaller id.

    Texts are whole UTF-8 byte strings, null as empty; matches never cross documents; strings are judged on the input.
    Returns ``key, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the bytes, if ``with_text``), one row per
    input row. ``key`` is an integer; a null key counts as larger than any other; rows with equal keys remove nothing
    from each other. Texts shorter than ``length`` stay whole. An empty table gives an empty result; other columns are
    not read. Runs are compared by hashes of 96 bits and more, windows byte by byte.
    """
    if not 1 <= length - seed + 1 <= 255:
        raise ValueError("length must be from seed to seed + 254: a run's windows are counted in one byte")
    _, size = volume(docs, text)
    blocks = buckets = parts_for(size, block_bytes)
    rows = in_blocks(docs, key, text, blocks)
    kind = docs.schema[key].dataType.simpleString()

    def ask(group: pa.Table) -> pa.Table:
        block, out = Block(group, length, seed), []
        number = group.column("block")[0].as_py()
        for b, runs in block.asked(buckets):
            out.append((b, number, six_bytes(block.digit[runs]), six_bytes(block.content[runs]), rising(block.ids[block.owner[runs]])))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "digits", "contents", "docs"])

    def answer(group: pa.Table) -> pa.Table:
        order = group.column("block").to_numpy().argsort()
        group = group.take(order)
        states = judge_runs(list(zip(*(group.column(c).to_pylist() for c in ("digits", "contents", "docs")), strict=True)))
        return pa.table([group.column("block"), group.column("bucket"), pa.array([s.tobytes() for s in states], pa.binary())], ["block", "bucket", "states"])

    def states_of(block: Block, replies: pa.Table) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """State of each distinct run, and by bucket the runs whose windows are asked about."""
        said = dict(zip(replies.column("bucket").to_pylist(), replies.column("states").to_pylist(), strict=True))
        state, border = np.zeros(len(block.lead), np.uint8), []
        for b, runs in block.asked(buckets):
            got = np.frombuffer(said[b], np.uint8)
            state[block.same[runs]] = got
            if len(wanted := runs[got == WINDOWS]):
                border.append((b, wanted))
        return state, border

    def ask_windows(group: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        if len(group):
            block = Block(group, length, seed)
            for b, runs in states_of(block, replies)[1]:
                raw = b"".join(block.texts[block.owner[r]][block.first[r] : block.first[r] + block.count[r] + length - 1] for r in runs.tolist())
                out.append((b, group.column("block")[0].as_py(), raw, block.count[runs].astype(np.uint8).tobytes(), rising(block.ids[block.owner[runs]])))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "raw", "counts", "docs"])

    def answer_windows(group: pa.Table) -> pa.Table:
        group = group.take(group.column("block").to_numpy().argsort())
        raws, counts, names = (group.column(c).to_pylist() for c in ("raw", "counts", "docs"))
        count = [np.frombuffer(c, np.uint8).astype(np.int64) for c in counts]
        windows = np.concatenate([expand(np.frombuffer(r, np.uint8), c, length) for r, c in zip(raws, count, strict=True)])
        doc = np.concatenate([np.repeat(from_rising(d), c) for d, c in zip(names, count, strict=True)])
        hit = np.split(repeated_windows(windows, doc), np.cumsum([c.sum() for c in count])[:-1])
        return pa.table([group.column("block"), group.column("bucket"), pa.array([np.packbits(h).tobytes() for h in hit], pa.binary()), pa.nulls(len(group), pa.binary())], ["block", "bucket", "hits", "states"])

    def remove(group: pa.Table, replies: pa.Table) -> pa.Table:
        block = Block(group, length, seed)
        coarse = replies.filter(pc.is_valid(replies.column("states")))
        fine = replies.filter(pc.is_valid(replies.column("hits")))
        state, border = states_of(block, coarse)
        sizes = np.array([len(x) for x in block.texts], np.int64)
        base = np.cumsum(sizes) - sizes
        edge = np.zeros(sizes.sum() + 1, np.int32)
        # a run that occurs again later in the block is covered there by its first document
        lead_doc = block.owner[block.lead][block.same]
        whole = (state[block.same] == WHOLE) | (block.ids[block.owner] > block.ids[lead_doc])
        at = base[block.owner[whole]] + block.first[whole]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + block.count[whole] + length - 1, -1)
        said = dict(zip(fine.column("bucket").to_pylist(), fine.column("hits").to_pylist(), strict=True))
        by_run = np.argsort(block.same, kind="stable")
        edges = np.searchsorted(block.same[by_run], np.arange(len(block.lead) + 1))
        for b, runs in border:
            counts = block.count[runs]
            hit = np.unpackbits(np.frombuffer(said[b], np.uint8), count=counts.sum()).astype(bool)
            offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            run, offset = np.repeat(runs, counts)[hit], offset[hit]
            # equal runs of the same document get the same windows
            lo, hi = edges[block.same[run]], edges[block.same[run] + 1]
            wide = hi - lo
            each = by_run[np.repeat(lo, wide) + np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)]
            at = base[block.owner[each]] + block.first[each] + np.repeat(offset, wide)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        doc = np.repeat(np.arange(len(sizes)), sizes)
        removed = np.bincount(doc[gone], minlength=len(sizes))
        begin = gone.copy()
        begin[1:] &= ~gone[:-1] | (doc[1:] != doc[:-1])
        spans = np.bincount(doc[begin], minlength=len(sizes))
        kept = [t if not r else np.frombuffer(t, np.uint8)[~gone[s : s + n]].tobytes() for t, r, s, n in zip(block.texts, removed, base, sizes, strict=True)]
        cols = [group.column("doc").combine_chunks().take(pa.array(block.order)), pa.array(sizes), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
        return pa.table([*cols, pa.array(kept, pa.binary())][: 5 + with_text], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    by_block = rows.groupBy("block")
    asked = by_block.applyInArrow(ask, "bucket int, block int, digits binary, contents binary, docs binary")
    coarse = asked.groupBy("bucket").applyInArrow(answer, "block int, bucket int, states binary")
    borders = by_block.cogroup(coarse.groupBy("block")).applyInArrow(ask_windows, "bucket int, block int, raw binary, counts binary, docs binary")
    fine = borders.groupBy("bucket").applyInArrow(answer_windows, "block int, bucket int, hits binary, states binary")
    replies = coarse.selectExpr("block", "bucket", "cast(null as binary) AS hits", "states").unionByName(fine)
    return by_block.cogroup(replies.groupBy("block")).applyInArrow(remove, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
