"""Edge cases and brute force for the operators that SQL also checks, and for token counts and revisits."""

import hashlib
import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer, models

from sparkloom.llm import decontamination, quality_rules, registry, revisits, token_counts, url_filters

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_decontamination_edges(spark, odd_docs):
    items = spark.createDataFrame(
        [(1, "Brown FOX jumps over the lazy dog and runs far away"), (2, "two"), (3, None), (4, "..."), (None, "one two"), (2, "two"), (5, "thing5 word6 thing6 word7 thing7 word8 thing8 word9 thing9 word10 thing10"), (6, "the lazy dog and runs far away from the new barn")],
        "item_id long, text string",
    ).selectExpr("item_id", "text", "0 AS doc", "1 AS mark")
    want = []
    for r in odd_docs.collect():
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(r.text)) if x]
        hit, names = set(), set()
        for i in items.collect():
            v = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(i.text)) if x]
            k = min(10, len(v))
            for s in range(len(v) - k + 1) if k else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[s : s + k]:
                        hit |= set(range(p, p + k))
                        names |= {str(i.item_id)} if i.item_id is not None else set()
        want.append((r.doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    got = decontamination.decontaminate(odd_docs, items)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert decontamination.decontaminate(odd_docs, items.limit(0)).where("contaminated").count() == 0


def test_decontamination_in_blocks(spark, odd_docs, monkeypatch):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs far away")], "item_id long, text string")
    want = sorted(map(tuple, decontamination.decontaminate(odd_docs, items).collect()), key=repr)
    monkeypatch.setattr(decontamination, "BROADCAST_TERMS", 3)
    assert sorted(map(tuple, decontamination.decontaminate(odd_docs, items).collect()), key=repr) == want


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://ORG/", "http://x.org", "http://a.example.org/en/12?q", "https://example.org/es/", "http://notexample.org/es/", "http://com/de/x#y", "x://a.com/fr/?z", "http:///path", "http://a.org//b", "ftp://u.com\n/de/"]
    pages = spark.createDataFrame([(i % 9 if i else None, u, "h") for i, u in enumerate(urls + urls[3:5])], "page_id long, url string, host string")
    want = []
    for r in pages.collect():
        host, path = re.match(r"([^/?#]*)([^?#]*)", r.url.split("://", 1)[1]).groups() if r.url and "://" in r.url else ("", "")
        host = low(host)
        fits = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, 0, None, "allow"))
        want.append((r.page_id, host, path, best[3], best[4]))
    for bits in (8, 1):
        got = url_filters.filter_urls(pages, url_filters.rules_frame(spark), prefix_hex=bits)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert url_filters.filter_urls(pages.limit(0), url_filters.rules_frame(spark)).collect() == []


def words_in_windows(w, k):
    seen = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return len({p for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for p in range(i, i + k)})


def test_quality_edges(spark, odd_docs, no_docs):
    loops = spark.createDataFrame([(50, "a b c " * 40), (51, "x " * 77), (52, " ".join(f"w{i}" for i in range(120)) + " " + " ".join(f"w{i}" for i in range(119, -1, -1))), (53, " ".join(f"v{i}" for i in range(60)) * 2)], "doc_id long, text string")
    both = odd_docs.select("doc_id", "text").where("length(text) < 5000 OR text IS NULL").unionByName(loops)
    want = []
    for r in both.collect():
        w = (r.text or "").encode().split()
        longest = max((k for k in range(1, len(w)) if words_in_windows(w, k)), default=0)
        lines = [x for x in (r.text or "").split("\n") if x.strip(" \t\n\r\x0b\f")]
        three, ten = words_in_windows(w, 3), words_in_windows(w, quality_rules.MIN_REPEAT)
        failed = len(w) < 50 or 100 * three > 50 * len(w)
        kept = not failed and ten <= quality_rules.MAX_COVERED * len(w) and longest <= quality_rules.MAX_REPEAT
        want.append((r.doc_id, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), three, failed, kept, ten, longest))
    assert sorted(map(tuple, quality_rules.quality_rules(both).collect()), key=repr) == sorted(want, key=repr)
    kept = quality_rules.quality_filter(both)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((x[0] for x in want if x[7]), key=repr)
    assert quality_rules.quality_rules(no_docs).collect() == [] and quality_rules.quality_rules(odd_docs).count() == odd_docs.count()


def test_token_counts(spark, docs, odd_docs, no_docs):
    scores, unknown = token_counts.unigram_scores(PIECES)

    def pieces(word):
        best = [(0, 0)]
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            options = [(best[s][0] + scores[word[s:end]], best[s][1] - 1) for s in range(max(0, end - 40), end) if word[s:end] in scores]
            best.append(max(options + ([] if word[end - 1] in scores else [(best[-1][0] + unknown * n, best[-1][1] - n)])))
        return -best[-1][1]

    for d in (docs.limit(30), odd_docs):
        known = {}
        for r in token_counts.token_counts(d, PIECES, max_nodes=500).join(d.select("doc_id", "text").distinct(), "doc_id").collect():
            w = (r.text or "").encode().split()
            assert r.n_pretokens == len(w) and r.n_chars == len(r.text or "")
            assert r.n_tokens == sum(known.setdefault(x, pieces("▁" + x.decode())) if x not in known else known[x] for x in w)
    # the same model in a library's own decoder
    lib = Tokenizer(models.Unigram([("<unk>", -100.0), *((p, s / token_counts.PARTS) for p, s in scores.items())], 0))
    trie = token_counts.Trie(scores, unknown, 10_000)
    for word in ("▁the", "▁tokenization", "▁understanding", "▁zebra", "▁international"):
        assert trie.count(word) == len(lib.encode(word).ids)
    assert token_counts.token_counts(no_docs, PIECES).collect() == []


def test_revisits(spark):
    rows = [
        (1, "http://www.a.org/x/?b=2&a=1&utm_s=z#f", 100, "response", {"etag": '"1"', "vary": "old", "content-length": "9"}, "d1"),
        (2, "https://A.org/x?a=1&b=2", 9000, "revisit", {"etag": 'W/"1"', "vary": "new", "content-length": "0"}, None),
        (3, "http://a.org/x?a=1&b=2", 9500, "response", {"etag": '"2"', "last-modified": "m"}, "d2"),
        (4, "http://a.org/x?a=1&b=2", 9600, "revisit", {"etag": '"1"'}, None), (5, "http://a.org/x?a=1&b=2", 9700, "revisit", {"last-modified": "m"}, None),
        (6, "http://a.org/x?a=1&b=2", 9800, "revisit", None, None), (7, "http://none.org/", 5, "revisit", {}, None), (8, None, 5, "revisit", {}, None),
        (9, "http://a.org/x?a=1&b=2", None, "revisit", {}, None), (10, "http://a.org/x?a=1&b=2", 99, "revisit", {}, None), (2, "https://A.org/x?a=1&b=2", 9000, "revisit", {"etag": 'W/"1"'}, None),
    ]
    d = spark.createDataFrame(rows, "record_id long, url string, at long, kind string, headers map<string,string>, digest string")
    for width in (10, 3600, 10**6):
        got = sorted(((r.record_id, r.status, r.response_id, r.digest) for r in revisits.resolve_revisits(d, width).collect()), key=repr)
        assert got == sorted([(2, "resolved", 1, "d1"), (2, "resolved", 1, "d1"), (4, "changed", 3, None), (5, "resolved", 3, "d2"), (6, "unchecked", 3, None), (7, "missing", None, None), (8, "missing", None, None), (9, "missing", None, None), (10, "missing", None, None)], key=repr)
    merged = [r.headers for r in revisits.resolve_revisits(d).where("record_id = 2").collect() if "vary" in r.headers and r.headers["vary"] == "new"]
    assert merged == [{"etag": 'W/"1"', "vary": "new", "content-length": "9"}]
    assert revisits.resolve_revisits(d.limit(0)).collect() == []


def test_every_operator_is_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES] == list(range(1, 11))
