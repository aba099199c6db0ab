"""Markdown, encodings and the delta feed: literals, restarts, and the stream against its table."""

import json

from pyspark.sql import functions as F

from sparkloom.operators.chunking import chunk
from sparkloom.operators.upkeep import latest
from sparkloom.sources import delta
from sparkloom.sources.markdown import decoded, markdown_blocks

PAGE = """Intro line
goes on

# One #1
Title two
=========
Title three
---
| a | b |
|---|:-:|
| 1 | 2 |
| no | rule |

| not | a table |
- item
- item two

```python
# not a heading

  kept
```
~~~
second
~~~
[^n]: A note.
1. first
--
end
"""


def test_markdown(spark):
    docs = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "```\nopen\r\n# end"), (5, "---\n---\n"), (1, PAGE)], "doc_id long, text string")
    got = {}
    for r in markdown_blocks(docs).orderBy("doc_id", "position").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.level, r.text))
    assert got[1] == [
        ("paragraph", 0, "Intro line\ngoes on"), ("heading", 1, "One #1"), ("heading", 1, "Title two"), ("heading", 2, "Title three"), ("table", 0, "| a | b |\n|---|:-:|\n| 1 | 2 |\n| no | rule |"),
        ("paragraph", 0, "| not | a table |"), ("list", 0, "- item\n- item two"), ("code", 0, "```python\n# not a heading\n\n  kept\n```"), ("code", 0, "~~~\nsecond\n~~~"), ("footnote", 0, "A note."),
        ("heading", 2, "1. first"), ("paragraph", 0, "end"),
    ]
    assert got.keys() == {1, 4, 5} and got[4] == [("code", 0, "```\nopen\n# end")] and got[5] == [("paragraph", 0, "---\n---")]
    assert chunk(markdown_blocks(docs)).where("doc_id = 1").count() > 0
    assert markdown_blocks(docs.limit(0)).collect() == []


def test_encodings(spark):
    text = "café – ok"
    raw = [text.encode(e) for e in ("utf-8", "utf-8-sig", "utf-16", "cp1252")] + [None, b"", b"\x81caf\xe9"]
    got = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw binary").select("i", decoded(F.col("raw")).alias("t")).orderBy("i").collect()]
    assert got == [text] * 4 + [None, "", "�caf�"]


def page(folder, token, changes):
    (folder / f"page-{token}.json").write_text("\n".join(json.dumps(x) for x in changes), encoding="utf-8")


def test_feed_loses_and_repeats_nothing(spark, tmp_path):
    (pages := tmp_path / "pages").mkdir()
    day, table = "2024-03-01T10:00:00", f"file://{tmp_path}/table"
    rounds = [
        {1: [{"seq": 1, "id": "a", "name": "A", "modified": day}, {"seq": 2, "id": "b", "name": "B", "modified": day, "permissions": [{"roles": ["read"]}]}], 2: [{"seq": 1, "id": "a", "name": "A", "modified": day}]},
        {3: [{"seq": 3, "id": "b", "deleted": True, "modified": day}, {"seq": 4, "id": "c", "name": "C", "modified": day}]},
        {4: [{"seq": 2, "id": "b", "name": "late", "modified": day}, {"seq": 6, "id": "a", "name": "A2", "modified": day}, {"seq": 5, "id": "a", "name": "old", "modified": day}]},
    ]
    seen = []
    for new in rounds:  # a new query each time, from the same checkpoint
        for token, changes in new.items():
            page(pages, token, changes)
        write = delta.upserts(table)

        def batch(df, number, write=write):
            seen.extend((number, r.id, r.seq) for r in df.collect())
            write(df, number)
            write(df, number)  # a batch that runs again changes nothing

        run = delta.changes(spark, str(pages)).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "at")).start()
        run.processAllAvailable()
        run.stop()
    assert sorted((i, s) for _, i, s in seen) == [("a", 1), ("a", 5), ("a", 6), ("b", 2), ("b", 3), ("c", 4)]
    feed = spark.createDataFrame([(c["seq"], c["id"], c.get("name"), bool(c.get("deleted"))) for new in rounds for p in new.values() for c in p], "seq long, id string, name string, deleted boolean")
    want = sorted((r.id, r.name) for r in latest(feed, "id", ["seq"], "deleted").collect())
    assert sorted((r.id, r.name) for r in delta.current(spark, table).collect()) == want == [("a", "A2"), ("c", "C")]


def test_permissions(spark):
    rows = [
        '[{"roles":["read"],"grantedToIdentitiesV2":[{"group":{"id":"g1"}},{"user":{"id":"u1"}}],"grantedToV2":{"siteGroup":{"id":"g1"}},"grantedTo":{"siteUser":{"id":"u2"}}}]',
        '[{"roles":["READ"],"link":{"scope":"Anonymous"}}]', '[{"link":{"scope":"organization"}}]', '[{"roles":["review"],"link":{"scope":"anonymous"}}]', "[]", "not json", None,
    ]
    got = [r.p and tuple(r.p) for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").select("i", delta.permissions(F.col("x")).alias("p")).orderBy("i").collect()]
    assert got == [(["g1"], ["u1", "u2"], False, False), ([], [], True, True), ([], [], True, False), ([], [], False, False), ([], [], False, False), None, None]


def test_folders_hand_down_access(spark):
    nodes = [("root", None, True), *((f"f{i}", f"f{i - 1}" if i else "root", i == 40) for i in range(300)), ("x", "y", False), ("y", "x", None), ("lost", "nowhere", False), ("top", None, False)]
    got = {r.id: (r.holder, r.n_up) for r in delta.inherited(spark.createDataFrame(nodes, "id string, parent_id string, own boolean")).collect()}
    assert got["root"] == ("root", 0) and got["f0"] == ("root", 1) and got["f39"] == ("root", 40) and got["f40"] == ("f40", 0) and got["f299"] == ("f40", 259)
    assert all(got[x] == (None, None) for x in ("x", "y", "lost", "top")) and len(got) == len(nodes)
