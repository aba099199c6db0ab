"""Documents in blocks, and small messages between blocks and the buckets of a key.

A block is a bounded share of the documents. A block sends each bucket one row with what it asks about the bucket's
keys, already reduced to distinct keys; the bucket answers in the order of the question. So the rows of a common key
are one entry a block, and no task ever holds the rows of a key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
ODD = U64(0x9E3779B97F4A7C15)


def in_blocks(docs: DataFrame, key: str, text: str, blocks: int) -> DataFrame:
    """``block, doc, text``: text null as empty."""
    return docs.select(F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(blocks)).cast("int").alias("block"), F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = x * ODD
    x ^= x >> U64(32)
    x *= ODD
    x ^= x >> U64(29)
    return x


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of spread 64-bit numbers, by their high half."""
    return ((x >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def six_bytes(x: np.ndarray) -> bytes:
    """The low 48 bits of each number."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(U64)


def rising(x: np.ndarray) -> bytes:
    """Non-descending integers as a first value, a width and differences of that width."""
    step = np.diff(x)
    width = next(w for w in (1, 2, 4, 8) if not len(step) or w == 8 or int(step.max()) < 1 << (8 * w))
    first = np.int64(x[0] if len(x) else 0)
    return first.tobytes() + bytes([width]) + step.astype(f"<u{width}").tobytes()


def from_rising(raw: bytes) -> np.ndarray:
    first, width = np.frombuffer(raw[:8], np.int64)[0], raw[8]
    step = np.frombuffer(raw, f"<u{width}", offset=9).astype(np.int64)
    return np.concatenate(([first], first + np.cumsum(step)))


def groups(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new combination of keys begins."""
    new = np.ones(len(sorted_keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in sorted_keys:
            new[1:] |= k[1:] != k[:-1]
    return new
