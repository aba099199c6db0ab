"""Text functions that the JVM has no expression for, as Arrow functions over whole batches."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Short forms that end in a full stop without ending a sentence.
SHORT = "mr mrs ms dr prof sr jr st inc ltd llc plc co corp gmbh ag bv nv sa etc vs eg ie cf al approx est no nr art sec fig ref para ch pp vol ed jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun".split()
#: Blanks between two sentences: behind a mark, before a capital or a digit, but not behind the full stop of a short
#: form or of a single capital. The JVM and the pattern library read it alike.
BETWEEN = rf"""(?<=[.!?])(?<!(?:^|[^A-Za-z])(?:(?i:{'|'.join(SHORT)})|[A-Z])\.)\s+(?=["“(\[]?[A-Z0-9])"""


#: List entries that a task works on at once; a row with more is a piece of its own.
PIECE = 1 << 18


def pieces(batches: Iterable[pa.RecordBatch], lists: Iterable[int]) -> Iterator[pa.RecordBatch]:
    """Batches cut in pieces of bounded size, by the entries of these list columns; no batch without rows."""
    for batch in batches:
        size = np.zeros(batch.num_rows + 1, np.int64)
        for i in lists:
            offsets = batch.column(i).offsets.to_numpy().astype(np.int64)
            size += offsets - offsets[0]
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, size[lo] + PIECE, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def sentences_of(text: str) -> list[str]:
    """Sentences of a text, for code that runs inside a task anyway."""
    return [s for s in map(str.strip, regex.split(BETWEEN, text)) if s]


def normal(text: str) -> str:
    """NFC, unix line ends, single blanks, one empty line at most, no blanks around."""
    text = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def _digests(words) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") for w in words], np.uint64)


def simhash(tokens: list[str]) -> int:
    """64 votes of all occurrences of all words, as a signed number; no words give 0."""
    counts = Counter(tokens)
    bits = np.unpackbits(_digests(counts).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
    votes = (2 * bits - 1).T @ np.array(list(counts.values()), np.int64) if counts else np.zeros(64)
    return int(np.packbits(votes > 0).view(">i8")[0])


def embedding(tokens: list[str], width: int) -> list[float]:
    """Words and their 3- and 4-grams hashed into a vector of length one; no words give zeros."""
    grams = Counter(tokens)
    for word, n in Counter(tokens).items():
        marked = f"^{word}$"
        for size in (3, 4):
            for at in range(max(1, len(marked) - size + 1)):
                grams[marked[at : at + size]] += n
    out, digest = np.zeros(width), _digests(grams)
    sign = np.where(digest >> np.uint64(63), 1.0, -1.0)
    np.add.at(out, (digest % np.uint64(width)).astype(np.int64), sign * (1 + np.log(np.array(list(grams.values()), np.float64))))
    length = np.sqrt((out * out).sum())
    return (out / length if length else out).tolist()


def _each(f, kind: str, arrow: pa.DataType):
    """A function of one value as an Arrow function of a column. Made when it is used, as its type needs a session."""

    def batch(values: pa.Array) -> pa.Array:
        return pa.array([f(v) for v in values.to_pylist()], arrow)

    return F.arrow_udf(batch, kind)


def split_sentences(text: Column) -> Column:
    """Sentences of a column, in the JVM."""
    return F.filter(F.transform(F.split(text, "(?U)" + BETWEEN), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def normalize(text: Column) -> Column:
    return _each(lambda t: None if t is None else normal(t), "string", pa.string())(text)


def simhash64(tokens: Column) -> Column:
    return _each(lambda t: simhash(t or []), "long", pa.int64())(tokens)


def hashed_embedding(tokens: Column, width: int = 384) -> Column:
    if width < 8:
        raise ValueError("an embedding has 8 numbers at least")
    return _each(lambda t: embedding(t or [], width), "array<double>", pa.list_(pa.float64()))(tokens)


def half_bytes(vector: Column) -> Column:
    """A vector as little-endian half floats; a number beyond their range is an error, null stays null."""

    def pack(v: list[float] | None) -> bytes | None:
        if v is None:
            return None
        with np.errstate(over="raise"):
            return np.array(v, np.float64).astype("<f2").tobytes()

    return _each(pack, "binary", pa.binary())(vector)


def half_vector(raw: Column) -> Column:
    """The inverse of ``half_bytes``; null and no bytes are null, half a number at the end is left out."""
    return _each(lambda b: np.frombuffer(b[: len(b) // 2 * 2], "<f2").astype(np.float64).tolist() if b else None, "array<double>", pa.list_(pa.float64()))(raw)
