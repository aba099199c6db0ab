"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Names that an operator makes itself start so; input columns with such names are not read.
OWN = "__op_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by whatever path Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables between jobs: spark.checkpoint.dir, or a new one where it is unset (tests)."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("sparkloom.scratch.dir", None)):
        base = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("sparkloom.scratch.dir", base)
    return base


def cut(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_in_buckets(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Write a table to the shared warehouse, bucketed by a key, so that joins and groups by it don't move its rows."""
    name = f"sparkloom_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("compression", "zstd").saveAsTable(name)
    return df.sparkSession.table(name)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote; nothing may read them any more."""
    for df in tables:
        folders = {f.rpartition("/")[0] for f in df.inputFiles()}
        spark = df.sparkSession
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def volume(df: DataFrame, col: str) -> tuple[int, int]:
    """Rows and bytes of a text column, from one scan without a shuffle of rows."""
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(col)), F.lit(0))).first()
    return int(row[0]), int(row[1])


def parts_for(total_bytes: int, each: int, least: int = 1) -> int:
    """How many parts of about ``each`` bytes hold ``total_bytes``."""
    return max(least, -(-int(total_bytes) // each))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def crc32_sql(codes: str) -> str:
    """The unsigned crc32 in DuckDB of a list of UTF-8 bytes, bit by bit."""
    bits = f"flatten(list_transform({codes}, lambda b: [{', '.join(f'(b >> {i}) & 1' for i in range(8))}]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}::BIGINT[]), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"


def utf8_sql(text: str) -> str:
    """The UTF-8 bytes in DuckDB of a text whose letters lie below U+0100."""
    return f"flatten(list_transform(list_filter(string_split({text}, ''), lambda x: x <> ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END))"
