"""Each stage on its own input, against the operators' brute force."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_line_dedup import MARKS
from test_line_dedup import brute as lines_brute
from test_near_dedup import brute as near_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input, output) of every stage."""
    top = tmp_path_factory.mktemp("stages")
    d = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").limit(2).select((F.col("item_id") + 200_000).alias("doc_id"), F.concat(F.lit("Some words of its own before the passage "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("own"), i.cast("string"), F.col("item_id").cast("string"))), " "), F.lit(" "), "text").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    copies = d.where("doc_id < 5").withColumns({"doc_id": F.col("doc_id") + 100_000, "text": F.concat(F.lit("New first line of this copy.\n"), "text")})
    d.unionByName(bench).unionByName(copies).write.parquet(str(top / "0"))
    out = {}
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        docs = spark.read.parquet(str(top / str(i)))
        f(spark, docs, SF).write.parquet(str(top / str(i + 1)))
        out[name] = docs, spark.read.parquet(str(top / str(i + 1)))
    return out


def test_columns(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == before.columns


def test_quality(stages):
    before, after = stages["quality_rules"]
    from sparkloom.llm.quality_rules import quality_rules

    want = {r.doc_id for r in quality_rules(before).where("kept").collect()}
    assert {tuple(r) for r in after.collect()} == {tuple(r) for r in before.collect() if r.doc_id in want}


def test_lines(stages):
    before, after = stages["line_dedup"]
    MARKS.update({r.text: r.m for r in before.select("text", F.xxhash64("text").alias("m")).collect()})
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want, _ = lines_brute(rows)
    old = dict(rows)
    want = {(i, t) for i, t in want if t == old[i] or re.search(r"[^\x20\x09-\x0D]", t)}
    assert {(r.doc_id, r.text) for r in after.collect()} == want
    assert after.where("n_chars <> length(text)").where("doc_id < 200000").count() == 0


def test_near_copies(stages):
    before, after = stages["near_dedup"]
    want = near_brute([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == {i for i, c in want.items() if i == c}


def test_benchmark(stages):
    before, after = stages["decontamination"]
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    assert {200_000, 200_001} <= gone and after.count() > 100


def test_packing(stages):
    before, after = stages["packing"]
    sizes = {r.doc_id: (r.n, r.total) for r in after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("total")).collect()}
    assert sizes.keys() == {r.doc_id for r in before.collect()} and all(n == t for n, t in sizes.values())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_edges(spark, odd_docs, no_docs):
    """Nulls, repeated rows and ids, long texts, clashing and missing columns; an empty table at every stage."""
    clash = odd_docs.withColumns({"n_lines": F.lit("a"), "kept": F.lit("b"), "n_removed": F.lit(1.5), "contaminated": F.lit("c"), "doc": F.lit("d")})
    for docs in (clash, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, SF)
            rows = after.collect()
            if name == "packing":
                assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
            else:
                assert after.columns == docs.columns and len(rows) <= docs.count()
                ids = [r.doc_id for r in docs.collect()]
                assert {r.doc_id for r in rows} <= set(ids)
                if name in ("near_dedup", "decontamination"):
                    assert sum(r.doc_id is None for r in rows) == ids.count(None)
