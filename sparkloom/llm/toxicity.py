"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are words and their beginnings, word pairs and pairs with one word between them, hashed into a fixed number of
coordinates; a text has a feature or has it not, however often. Every coordinate has its own learning rate, and the L1 term keeps
all coordinates at zero that the labels say little about, so the weights are few and are broadcast. The learner sees a
bounded sample of the labelled rows, one Spark job a pass over the features of the sample; its state is two numbers a
coordinate, whatever the input. Scoring is one map over whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import U64, mix
from .common import cut, table

WORD = re.compile(r"\w+")
#: Production parameters: coordinates as a power of two, labelled rows learnt from, passes, and the learner's rates.
BITS, SAMPLE, PASSES = 20, 20_000, 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 12.0, 0.1
#: Letters of the beginnings of longer words, which stand for the word in its other forms.
STEMS = (4, 6)
#: Words between the two words of a pair.
SKIPS = (0, 1)
#: Words of a text are hashed so many at a time, and distinct words are remembered up to a bound.
STEP, KNOWN = 1 << 18, 1 << 19


class Checksums(dict):
    """Words to numbers, worked out once while they are remembered."""

    def __missing__(self, word: str) -> int:
        h = self[word] = zlib.crc32(word.encode()) | len(word) << 32
        return h


class Beginnings(dict):
    """Words to the checksums of their two beginnings, 0 where the word is not longer."""

    def __missing__(self, word: str) -> int:
        a, b = (zlib.crc32(word[:k].encode()) | 1 if len(word) > k else 0 for k in STEMS)
        h = self[word] = a << 32 | b
        return h


class Features:
    """Coordinates of texts. Words have the lower half of the coordinates for themselves, pairs the upper half."""

    def __init__(self, bits: int):
        self.half = bits - 1
        self.known, self.stems = Checksums(), Beginnings()

    def coordinates(self, text: str) -> Iterator[np.ndarray]:
        """All features of a text, some at a time, with repetitions."""
        words = WORD.findall(text.lower())
        if len(self.known) > KNOWN:
            self.known.clear()
            self.stems.clear()
        known, half, low = self.known, U64(64 - self.half), U64(1 << self.half)
        for begin in range(0, len(words), STEP):
            some = words[begin : begin + STEP + max(SKIPS) + 1]
            h = mix(np.fromiter(map(known.__getitem__, some), U64, len(some)))
            found = [h >> half]
            begun = np.fromiter(map(self.stems.__getitem__, some), U64, len(some))
            for i, stem in enumerate((begun >> U64(32), begun & U64(0xFFFFFFFF))):
                found.append(mix(stem[stem > 0] | U64(i + 1) << U64(40)) >> half)
            for k in SKIPS:
                if len(h) > k + 1:
                    found.append((mix(h[: -k - 1] + mix(h[k + 1 :] + U64(k + 1))) >> half) + low)
            yield np.concatenate(found).astype(np.int64)

    def distinct(self, text: str) -> np.ndarray:
        parts = [np.unique(x) for x in self.coordinates(text)]
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


class Learner:
    """FTRL-proximal: ``z`` and ``n`` of every coordinate, the last one of which is the bias (it has no L1 term)."""

    def __init__(self, bits: int, state: bytes | None = None):
        both = np.zeros((2, (1 << bits) + 1)) if state is None else np.frombuffer(state).reshape(2, -1).copy()
        self.z, self.n = both

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def bias(self) -> float:
        return float(-self.z[-1] / ((BETA + np.sqrt(self.n[-1])) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w, b = self.weights(at), self.bias()
        g = chance(float(w.sum()) + b) - label
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / ALPHA * w
        before = np.sqrt(self.n[-1])
        self.n[-1] += g * g
        self.z[-1] += g - (np.sqrt(self.n[-1]) - before) / ALPHA * b

    def state(self) -> bytes:
        return np.stack([self.z, self.n]).tobytes()


def chance(x: float) -> float:
    return float(1 / (1 + np.exp(-min(max(x, -35.0), 35.0))))


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int, bits: int) -> DataFrame:
    """``turn, label, at``: the features of at most ``rows`` labelled documents, in an order that says nothing of the label.

    An id that is labelled more than once counts as marked if one of its rows is; of the documents with one id, the one
    with the smallest hash is learnt from. The ids are bounded by ``rows``, so they are broadcast.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__op_key")).agg(F.max(F.col(label).cast("int")).alias("__op_label"))
    known = known.withColumn("__op_turn", F.xxhash64(F.lit("turn"), "__op_key"))
    # the smallest hashes are among those below a bound that lets about twice as many through
    share = min(1.0, 2 * rows / max(1, known.count()))
    known = known.where(F.col("__op_turn").cast("double") <= (2 * share - 1) * 2.0**63).orderBy("__op_turn", "__op_key").limit(rows)
    texts = docs.select(F.col(key).alias("__op_key"), F.col(text).alias("__op_text")).join(F.broadcast(known.drop("__op_turn")), "__op_key")
    one = texts.groupBy("__op_key", "__op_label").agg(F.min(F.struct(F.xxhash64("__op_text").alias("h"), F.col("__op_text").alias("t"))).alias("m"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Features(bits)
        for batch in batches:
            for i in range(batch.num_rows):  # a text's features are bounded, a batch of texts' are not
                row = batch.slice(i, 1)
                at = maker.distinct(row.column(2)[0].as_py() or "")
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), pa.array([at.astype(np.int32)], pa.list_(pa.int32()))], names=["turn", "label", "at"])

    return one.select(F.xxhash64(F.lit("turn"), "__op_key").alias("turn"), F.col("__op_label").alias("label"), F.col("m.t")).mapInArrow(features, "turn long, label int, at array<int>")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE, passes: int = PASSES, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """Learn ``label``: the coordinates with a weight, their weights, and the bias. ``labels`` has the rows to learn from."""
    known = cut(sample(docs, labels, key, text, label, rows, bits).select("turn", "label", "at", F.lit(None).cast("binary").alias("state")).repartition(1).sortWithinPartitions("turn", "label"))
    state = None

    def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(bits)
        for batch in batches:
            for marked, at, before in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if before is not None:
                    learner = Learner(bits, before)
                else:
                    learner.learn(at.values.to_numpy(), int(marked > 0))
        yield pa.RecordBatch.from_arrays([pa.array([learner.state()], pa.binary())], names=["state"])

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in batch.column(0).to_pylist():
                learner = Learner(bits, held)
                w = learner.weights(slice(0, 1 << bits))
                at = np.flatnonzero(w)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.list_(pa.int64())), pa.array([w[at]], pa.list_(pa.float64())), pa.array([learner.bias()])], names=["at", "w", "bias"])

    for _ in range(passes):  # the state goes on as a row of a table; the driver never holds it
        rows_of = known if state is None else known.unionByName(state.select(F.lit(None).cast("long").alias("turn"), F.lit(None).cast("int").alias("label"), F.lit(None).cast("array<int>").alias("at"), "state"))
        ordered = rows_of.coalesce(1).sortWithinPartitions(F.asc_nulls_first("turn"), "label").select("label", "at", "state")
        state = cut(ordered.mapInArrow(one_pass, "state binary"))
    found = state.mapInArrow(weights, "at array<bigint>, w array<double>, bias double").first()
    return np.array(found.at, np.int64), np.array(found.w), found.bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """``key, score``: the chance that a text is marked, from its whole text alone. Null is as empty: the bias alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Features(bits)
        at, w, bias = held.value
        weights = np.zeros(1 << bits)
        weights[at] = w
        for batch in batches:
            scores = []
            for x in pc.fill_null(batch.column(1), ""):
                met = [c[weights[c] != 0] for c in maker.coordinates(x.as_py())]
                some = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
                scores.append(chance(float(weights[some].sum()) + bias))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(of_batches, f"`{key}` {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 5, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE) -> DataFrame:
    """Score every document: ``key, held_out, score, predicted`` (1 from a score of 0.5 on).

    Ids whose checksum ``held_out`` divides (a null id counts as an empty text, whose checksum is 0) are never learnt
    from; at most ``rows`` of the other labelled ids are, those with the smallest hashes. Labels, ids and other columns
    are never features, whatever their names. Null and empty texts get the score of a text without features. Repeated
    rows are scored alike, row by row; an empty table gives an empty result; without any labels every score is 0.5.
    """
    apart = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(held_out)) == 0
    model = fit(docs, labels.where(~apart), key, text, label, rows)
    return score(docs, model, key, text).select(F.col(key), apart.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
