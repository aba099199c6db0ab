"""HTML pages as typed blocks: pages are cut into marks and text, and runs between block marks become blocks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that hold no text, and elements that end the block before them.
SILENT = "script|style|noscript|template"
BLOCK = frozenset("address article aside blockquote body dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table title ul".split())
MARK = re.compile(rf"<!--.*?(?:-->|\Z)|<(?:{SILENT})\b.*?(?:</(?:{SILENT})\s*>|\Z)|<(/?)([a-z][a-z0-9]*)\b[^>]*>|<![^>]*>|([^<]+|<)", re.S | re.I)
TABLE = re.compile(r"<table\b[^>]*>(.*?)(?:</table\s*>|\Z)", re.S | re.I)
ROW = re.compile(r"<tr\b[^>]*>(.*?)(?=<tr\b|</tr\s*>|\Z)", re.S | re.I)
CELL = re.compile(r"<t[dh]\b[^>]*>(.*?)(?=<t[dh]\b|</t[dh]\s*>|\Z)", re.S | re.I)


def plain(source: str) -> str:
    """The text of a piece of HTML with single blanks."""
    text = " ".join(m.group(3) or (" " if (m.group(2) or "").lower() == "br" else "") for m in MARK.finditer(source))
    return " ".join(html.unescape(text).split())


def rendered(rows: list[list[str]]) -> str:
    """Rows of cells as a table with a separator under its header; short rows are filled up."""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(row + [""] * (width - len(row))) + " |" for row in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def _runs(source: str) -> Iterator[tuple[str, str]]:
    """Block elements, each with the text up to the next block mark; text after a closing mark belongs to none."""
    inside, text = "", []
    for mark in MARK.finditer(source):
        name = (mark.group(2) or "").lower()
        if name in BLOCK:
            yield inside, "".join(text)
            inside, text = "" if mark.group(1) else name, []
        elif name == "br":
            text.append(" ")
        elif mark.group(3):
            text.append(mark.group(3))
    yield inside, "".join(text)


def blocks_of(page: str) -> list[tuple[str, int, str]]:
    """(kind, level, text) in the order of the page: title, heading, list, table, paragraph. Tables are taken whole."""
    out, at = [], 0
    for table in [*TABLE.finditer(page), None]:
        for element, raw in _runs(page[at : table.start() if table else len(page)]):
            if body := " ".join(html.unescape(raw).split()):
                head = element[:1] == "h" and element[1:].isdigit()
                kind = "heading" if head else {"title": "title", "li": "list"}.get(element, "paragraph")
                out.append((kind, int(element[1:]) if head else 0, body))
        if table:
            rows = [[plain(c.group(1)) for c in CELL.finditer(r.group(1))] for r in ROW.finditer(table.group(1))]
            if rows := [r for r in rows if any(r)]:
                out.append(("table", 0, rendered(rows)))
            at = table.end()
    return out


def html_blocks(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """``key, position, kind, level, text``: one row a block; null and empty pages have none."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(name, i, *b) for name, page in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, b in enumerate(blocks_of(page or ""))]
            kinds = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=[key, "position", "kind", "level", "text"])

    return pages.select(key, source).mapInArrow(parse, f"`{key}` {pages.schema[key].dataType.simpleString()}, position int, kind string, level int, text string")
