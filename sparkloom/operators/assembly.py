"""Evidence for a prompt: unlike hits, cut to a budget of tokens, rendered as quoted data.

Both folds go through one question's hits in rank order, each step depending on what was kept before; the hits of a
question are as many as its search returned, and questions are spread over tasks.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import arrow
from ..functions.text import squeeze, tokens

#: Bits and share of words from which two texts count as one; tokens and blocks of a prompt, tokens of the
#: smallest block that is cut, how a cut shows, and the share of its room that a cut at a boundary must fill.
BITS, OVERLAP = 6, 0.85
BUDGET, BLOCKS, LEAST, CUT, FILLED = 6000, 8, 40, " [...]", 0.5
#: Fixed value: tokens a word or mark.
RATE = 1.15
MARK = re.compile(r"\w+|[^\w \t\n\x0b\f\r]")


def unlike_kept(hits: DataFrame, by: str = "query_id", rank: str = "rank", text: str = "text", bits: int | None = BITS, overlap: float = OVERLAP) -> DataFrame:
    """Hits that no better *kept* hit of their question repeats; a hit that was left out hides nothing.

    Two texts are alike that are equal but for case and blanks, whose similarity hashes differ in up to ``bits`` bits
    (None: not compared), or whose words overlap by ``overlap`` or more (Jaccard). Null texts are empty, and alike.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    marked = hits.withColumns({
        "__same": F.xxhash64(squeeze(body)), "__words": F.array_distinct(F.transform(tokens(body), lambda t: F.xxhash64(t))),
        "__bits": arrow.simhash64(tokens(body)) if bits is not None else F.lit(0).cast("long"),
    })

    def fold(group: pa.Table) -> pa.Table:
        group = group.sort_by(rank).combine_chunks()
        n = group.num_rows
        same, sketch = (np.asarray(group.column(c).to_numpy()) for c in ("__same", "__bits"))
        lists = group.column("__words").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        _, word = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        there = np.zeros((n, int(word.max(initial=-1)) + 1), np.float32)
        there[np.repeat(np.arange(n), size), word] = 1
        both = there @ there.T
        union = size[:, None] + size[None, :] - both
        alike = (same[:, None] == same[None, :]) | (both >= overlap * union)
        if bits is not None:
            alike |= np.bitwise_count(sketch.view(np.uint64)[:, None] ^ sketch.view(np.uint64)[None, :]) <= bits
        kept: list[int] = []
        for i in range(n):
            if not alike[i, kept].any():
                kept.append(i)
        return group.take(pa.array(kept, pa.int64())).drop_columns(["__same", "__words", "__bits"])

    return marked.groupBy(by).applyInArrow(fold, hits.schema)


def _size(marks: int) -> int:
    return max(1, int(marks * RATE)) if marks else 0


def count(text: str) -> int:
    """Tokens of a text, as ``approx_tokens`` counts them."""
    return max(1, int(len(MARK.findall(text)) * RATE)) if text else 0


def shortened(text: str, room: int) -> str:
    """A text cut to about ``room`` tokens: after a paragraph, else after a sentence, if that fills half of the room, else after a word."""
    for mark in ("\n\n", ". "):
        parts = text.split(mark)
        fits = bisect_right(list(accumulate(count(p) + 1 for p in parts)), room)
        if len(parts) > 1 and fits:
            head = mark.join(parts[:fits])
            out = head + ("" if head.endswith(".") else ".") + CUT
            if count(out) >= FILLED * room:
                return out
    words = text.split()
    marks, n = [0, *accumulate(len(MARK.findall(w)) for w in words)], len(words)
    while n and _size(marks[n]) > room:  # a tenth at a time, the last twenty one by one
        n = n * 9 // 10 if n > 20 else n - 1
    return " ".join(words[:n]) + CUT


def packed(hits: DataFrame, by: str = "query_id", rank: str = "rank", text: str = "text", budget: int = BUDGET, blocks: int = BLOCKS, least: int = LEAST) -> DataFrame:
    """All hits with ``block`` (1, 2, ...; null: left out), ``body``, ``n_tokens`` and ``truncated``.

    Hits fill the budget in rank order, at most ``blocks`` of them. One that doesn't fit is cut to the room left; where
    that is, or leaves, fewer than ``least`` tokens, it is left out and a later, shorter one may still fit. An empty or
    null text is a block of no tokens.
    """

    def fold(group: pa.Table) -> pa.Table:
        group = group.sort_by(rank)
        used, n, out = 0, 0, []
        for body in group.column(text).to_pylist():
            body, room = body or "", budget - used
            size, cut = count(body), False
            fits = n < blocks and room > 0
            if fits and size > room:
                fits = room >= least
                if fits:
                    body, cut = shortened(body, room), True
                    size = count(body)
                    fits = size >= least
            if fits:
                n, used = n + 1, used + size
            out.append((n, body, size, cut) if fits else (None, None, None, None))
        columns = zip(*out, strict=True)
        for name, kind, values in zip(("block", "body", "n_tokens", "truncated"), (pa.int32(), pa.string(), pa.int64(), pa.bool_()), columns, strict=True):
            group = group.append_column(name, pa.array(values, kind))
        return group

    schema = StructType([*hits.schema.fields, *StructType.fromDDL("block int, body string, n_tokens bigint, truncated boolean").fields])
    return hits.groupBy(by).applyInArrow(fold, schema)


def _plain(value: Column) -> Column:
    return F.trim(F.translate(value, '"\n', "' "))


def rendered(block_id: Column, title: Column, body: Column, section: Column | None = None, effective: Column | None = None, source: Column | None = None, page: Column | None = None, superseded: Column | None = None, truncated: Column | None = None) -> Column:
    """One evidence block as quoted data with its attributes; those that are null or empty are left out."""
    some = lambda name, value: F.when(F.length(value) > 0, F.concat(F.lit(f' {name}="'), value, F.lit('"')))
    flag = lambda name, value: F.when(value, F.lit(f' {name}="true"'))
    parts = [F.concat(F.lit(' id="'), block_id, F.lit('"')), F.concat(F.lit(' doc="'), _plain(title), F.lit('"'))]
    for name, value in (("section", None if section is None else _plain(section)), ("effective", effective), ("source", source), ("page", None if page is None else page.cast("string"))):
        if value is not None:
            parts.append(some(name, value))
    parts += [flag(n, v) for n, v in (("superseded", superseded), ("truncated", truncated)) if v is not None]
    return F.concat(F.lit("<evidence"), F.concat_ws("", *parts), F.lit(">\n"), body, F.lit("\n</evidence>"))


def prompts(blocks: DataFrame, by: str = "query_id", order: str = "block", block_id: str = "block_id", text: str = "rendered") -> DataFrame:
    """``by, n_blocks, prompt``: a question's blocks in order, and their ids once more at the end."""
    rows = blocks.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(block_id).alias("i"), F.col(text).alias("t")))).alias("xs"))
    ids = F.array_join(F.transform("xs", lambda x: x["i"]), ", ")
    return rows.select(by, F.size("xs").alias("n_blocks"), F.concat(F.array_join(F.transform("xs", lambda x: x["t"]), "\n\n"), F.lit("\n\nEvidence ids, strongest first: "), ids).alias("prompt"))
