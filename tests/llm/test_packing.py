import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm.packing import Encoder, Shard, Statistics, deal, fill, pack, terms_of

FILE = public_tokenizers.path("byte_bpe_50k.json")


def check(docs, shard_ids=60_000):
    t = Tokenizer.from_file(FILE)
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append(t.encode(r.text or "", add_special_tokens=False).ids + [1])
    pieces = pack(docs, FILE, shard_ids=shard_ids).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert by_doc.keys() == want.keys()
    for doc, rows in want.items():
        got = sorted((p.start, p.length, p.doc_tokens, p.ids_crc32) for p in by_doc[doc])
        assert sum(p[1] for p in got) == sum(map(len, rows))
        for start, length, total, crc in got:
            assert any(len(ids) == total and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) and start + length <= total for ids in rows)
        if len(rows) == 1:
            at = 0
            for start, length, _, _ in got:
                assert start == at
                at += length
    short = 0
    for rows in by_sequence.values():
        at = 0
        for p in sorted(rows, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        short += at < 2048
    return short, len(by_sequence)


def test_pieces_partition_the_documents(docs):
    short, n = check(docs)
    assert short <= 12 and n > 20


def test_edges(odd_docs):
    check(odd_docs)


def test_empty(no_docs):
    assert pack(no_docs, FILE).collect() == []


@pytest.mark.parametrize("text", ["a  b", "a   b", "\n  b", "a \n b", "x\t y", " lead", "trail  ", "a b  c", "don't  stop", "a 　b", "<|endoftext|> a", "\0 a b", "Äußerst schön, ñandú! éÈ ĀɏÿŸ Ωμέγα. a.b ..", "", " ", "x,", "ﬁ ª º µ ſ", "é ñ  ü  x"])
def test_ranks_encode_like_the_tokenizer(text):
    e = Encoder(FILE)
    assert e.ranks is not None
    assert e(text).tolist() == e.plain(text).tolist()


def statistics(units):
    df = np.bincount(terms_of(units)[0]).astype(float)
    return Statistics(df, len(units), sum(map(len, units)), 0.9, 0.4)


def brute_fill(units, room_for, terms):
    """The same greedy rule with BM25 written out over all pairs of a seed and a unit."""
    n, mean = len(units), sum(map(len, units)) / len(units)
    df = defaultdict(int)
    for u in units:
        for t in set(u.tolist()):
            df[t] += 1

    def weight(u, t):
        tf = u.tolist().count(t)
        return np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 1.9 / (tf + 0.9 * (1 - 0.4 + 0.4 * len(u) / mean))

    unused, windows, seed, first = set(range(n)), [], None, 0
    while unused or seed is not None:
        if seed is None:
            seed, first = min(unused), 0
            unused.discard(seed)
        window, room, asked, seed = [(seed, first, len(units[seed]) - first)], room_for - (len(units[seed]) - first), 0, None

        def take(unit):
            nonlocal room, seed, first
            k = min(room, len(units[unit]))
            window.append((unit, 0, k))
            unused.discard(unit)
            room -= k
            if k < len(units[unit]):
                seed, first = unit, k

        while room and asked < len(window):
            u = units[window[asked][0]]
            order = sorted(set(u.tolist()), key=lambda t: (-weight(u, t), t))
            for at in range(0, len(order), terms):
                asked_for = order[at : at + terms]
                scores = {v: sum(weight(units[v], t) for t in asked_for if t in units[v]) for v in unused}
                for unit in sorted((v for v, x in scores.items() if x > 0), key=lambda v: (-round(scores[v], 9), v)):
                    if room:
                        take(unit)
            asked += 1
            if room and asked == len(window) and unused:
                take(min(unused))
        windows.append(window)
    return windows


def test_neighbours_like_plain_bm25():
    rng = np.random.default_rng(3)
    units = [(rng.zipf(1.4, rng.integers(3, 40)) % 500 + 1000 * (i % 3)).astype("<u2") for i in range(120)]
    assert fill(units, 100, statistics(units), 4) == brute_fill(units, 100, 4)


def test_many_small_units_are_all_retrieved():
    """Far more than one screen of neighbours go to a window, in the order of their rank."""
    rng = np.random.default_rng(4)
    units = [(rng.integers(0, 30, 20) + 100 * (i % 2)).astype("<u2") for i in range(400)]
    for window in fill(units, 2000, statistics(units), 16)[:-1]:
        topics = [u % 2 for u, _, _ in window]
        assert sum(a != b for a, b in zip(topics, topics[1:], strict=False)) <= 1


def test_hot_terms_and_null_keys_are_spread(spark):
    assert deal({1: 10, 2: 95, 3: 250, 4: 20, 5: 70}, 100) == ({1: (0, 1), 2: (1, 1), 3: (2, 3), 4: (5, 1), 5: (5, 1)}, 6)
    rows = spark.range(1500).selectExpr("cast(null as long) AS doc_id", "concat('same words in every text ', id) AS text")
    got = pack(rows, FILE, shard_ids=10_000)
    per = [r["count"] for r in got.selectExpr("sequence_id >> 32 AS shard").groupBy("shard").count().collect()]
    assert len(per) > 5 and max(per) < 600 and got.count() >= 1500


def test_index_knows_every_unit():
    units = [np.array([5, 6], "<u2"), np.array([6, 7], "<u2"), np.array([8], "<u2")]
    shard = Shard(units, statistics(units), 1)
    assert [x.tolist() for x in shard.rankings(0, np.array([False, True, True]))] == [[1]]
