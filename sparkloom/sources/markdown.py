"""Markdown texts as typed blocks, and bytes as texts.

Lines are typed by window functions over a document's own lines: fences by the parity of fence lines above, tables and
paragraphs by runs of neighbours of one kind. A document's lines are one window, documents are spread over tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Encodings in the order in which they are tried.
ENCODINGS = ["utf-8-sig", "utf-8", "utf-16", "cp1252"]
FENCE, ATX, SETEXT = r"^\s*(?:```|~~~)", r"^(#{1,6})\s+(.*)$", r"^(=+|-{2,})$"
ROW, RULE, ITEM, NOTE = r"^\s*\|.*\|\s*$", r"^\s*\|[\s:|-]+\|\s*$", r"^\s*(?:[-*+]|\d+[.)])\s+", r"^\s*\[\^([^\]]+)\]:\s*(.*)$"


def markdown_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, position, kind, level, text``: headings, code, tables, lists, footnotes and paragraphs, in order.

    A heading is a line of one to six ``#``, or one with a line of ``=`` or ``-`` under it (not itself such a line).
    Code reaches from fence to fence, or to the end, and keeps its blanks. Neighbouring rows are a table where the
    second is a rule, else prose; neighbouring items are one list; a footnote ``[^1]:`` is one line; other lines up to
    an empty one are a paragraph. Nulls and empty texts have no blocks; a key names one text, of several rows with it
    the smallest text counts.
    """
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n?", "\n")
    lines = docs.groupBy(key).agg(F.min(body).alias("body")).select(F.col(key), F.posexplode(F.split("body", "\n")).alias("n", "line"))
    w, line = W.partitionBy(key).orderBy("n"), F.col("line")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    fence, empty = line.rlike(FENCE), F.trim("line") == ""
    lines = lines.withColumn("fences", F.sum(fence.cast("int")).over(so_far))
    code = fence | (F.pmod("fences", F.lit(2)) == 1)
    row = ~code & line.rlike(ROW)
    lines = lines.withColumns({"code": code, "row": row}).withColumn("run", F.sum((F.col("row") != F.coalesce(F.lag("row").over(w), ~F.col("row"))).cast("int")).over(so_far))
    in_run = W.partitionBy(key, "run").orderBy("n")
    ruled = F.nth_value(F.col("line").rlike(RULE), 2).over(in_run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    lines = lines.withColumn("tabled", F.col("row") & F.coalesce(ruled, F.lit(False)))
    under = F.lead(F.trim("line")).over(w)
    headed = ~F.col("row") & ~empty & ~F.trim("line").rlike(SETEXT) & F.coalesce(under.rlike(SETEXT), F.lit(False))
    kind = (
        F.when(F.col("code"), "code").when(line.rlike(ATX), "heading").when(headed, "setext").when(line.rlike(NOTE), "footnote")
        .when(F.col("tabled"), "table").when(empty, "").when(line.rlike(ITEM), "list").otherwise("paragraph")
    )
    lines = lines.withColumn("kind", kind).withColumn("mark", F.when(F.col("kind") == "setext", under))
    below = (F.lag("kind").over(w) == "setext") & F.trim("line").rlike(SETEXT)
    lines = lines.withColumn("below", F.coalesce(below, F.lit(False))).where("NOT below")
    before = F.lag("kind").over(w)
    opens = line.rlike(FENCE) & (F.pmod("fences", F.lit(2)) == 1)
    new = before.isNull() | (before != F.col("kind")) | F.col("kind").isin("heading", "setext", "footnote") | ((F.col("kind") == "code") & opens)
    lines = lines.withColumn("block", F.sum(new.cast("int")).over(so_far)).where("kind <> ''")
    shown = F.when(F.col("kind") == "table", F.trim("line")).otherwise(line)
    blocks = lines.groupBy(key, "block", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", shown.alias("line")))), lambda x: x["line"]), "\n").alias("t"), F.max("mark").alias("mark"))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("t", ATX, 1))).when(F.col("mark").startswith("="), 1).when(F.col("mark").startswith("-"), 2).otherwise(0)
    bare = F.when(F.col("kind") == "heading", F.trim(F.regexp_extract("t", ATX, 2))).when(F.col("kind") == "footnote", F.regexp_extract("t", NOTE, 2)).otherwise(F.regexp_replace("t", r"^\s+|\s+$", ""))
    name = F.when(F.col("kind") == "setext", "heading").otherwise(F.col("kind"))
    return blocks.where(F.col("t").rlike(r"\S")).select(key, F.row_number().over(W.partitionBy(key).orderBy("block")).alias("position"), name.alias("kind"), level.alias("level"), bare.alias("text"))


def decoded(content: Column) -> Column:
    """Bytes as text by the first encoding that fits, else UTF-8 with replacements; UTF-16 only behind a byte-order mark. Null stays null."""

    def read(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for name in ENCODINGS:
            if name == "utf-16" and raw[:2] not in (b"\xff\xfe", b"\xfe\xff"):
                continue
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                continue
        return raw.decode("utf-8", errors="replace")

    return F.arrow_udf(lambda column: pa.array([read(x) for x in column.to_pylist()], pa.string()), "string")(content)
