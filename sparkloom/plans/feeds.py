"""Queries on sources: permissions and the access that folders hand down, Markdown texts, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.chunking import chunk
from ..sources import delta
from ..sources.markdown import markdown_blocks
from ..sources.tables import table
from .registry import registry

QUERIES, SQL, query = registry()

ENTRIES = {
    0: '[{"roles":["read"],"grantedToV2":{"group":{"id":"g#"}}},{"roles":["owner"],"grantedTo":{"user":{"id":"u#"}}}]',
    1: '[{"roles":["Write"],"link":{"scope":"organization"}},{"roles":["review"],"grantedToV2":{"group":{"id":"g#"}}}]',
    2: '[{"roles":[],"link":{"scope":"anonymous"},"grantedToV2":{"user":{"id":"u#"}}}]',
    3: '[{"grantedToIdentitiesV2":[{"user":{"id":"u#"}},{"siteGroup":{"id":"s#"},"user":{"id":"x"}},{"user":{"id":"u#"}}]}]',
    4: "[]",
}


@query("""SELECT doc_id, CASE k WHEN 0 THEN 'g' || n WHEN 3 THEN 's' || n ELSE '' END AS groups, CASE WHEN k IN (0, 3) THEN 'u' || n ELSE '' END AS users, k IN (1, 2) AS tenant_wide, k = 2 AS anonymous
FROM (SELECT doc_id, doc_id % 5 AS k, doc_id % 13 AS n FROM documents)""")
def permissions_parsed(spark, sf_dir):
    """Who may read each document, from lists of permissions as JSON."""
    k = F.pmod("doc_id", F.lit(5))
    text = F.coalesce(*[F.when(k == i, F.replace(F.lit(t), F.lit("#"), F.pmod("doc_id", F.lit(13)).cast("string"))) for i, t in ENTRIES.items()])
    rows = table(spark, sf_dir, "documents").select("doc_id", delta.permissions(text).alias("p"))
    return rows.select("doc_id", F.array_join("p.groups", "|").alias("groups"), F.array_join("p.users", "|").alias("users"), "p.tenant_wide", "p.anonymous")


@query("""WITH RECURSIVE n AS (SELECT doc_id AS id, CASE WHEN doc_id > 0 THEN doc_id // 3 END AS parent_id, doc_id % 17 = 4 AS own FROM documents),
w AS (SELECT id, id AS place, 0::BIGINT AS n_up FROM n UNION ALL SELECT w.id, n.parent_id, n_up + 1 FROM w JOIN n ON n.id = w.place WHERE NOT own AND parent_id IS NOT NULL)
SELECT n.id, w.place AS holder, n_up FROM n LEFT JOIN (SELECT w.* FROM w JOIN n ON n.id = w.place WHERE own) w ON w.id = n.id""")
def folder_access(spark, sf_dir):
    """Where every item of a tree of folders gets its permissions from."""
    i = F.col("doc_id")
    return delta.inherited(table(spark, sf_dir, "documents").select(i.alias("id"), F.when(i > 0, F.floor(i / 3)).alias("parent_id"), (F.pmod(i, F.lit(17)) == 4).alias("own")))


def marked_down(spark, sf_dir):
    """Documents as Markdown: of their lines that begin with a letter, each fourth a heading, the others prose, items and code."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x.rlike("^[A-Za-z]"))
    form = lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("## "), x)).when(i % 4 == 1, x).when(i % 4 == 2, F.concat(F.lit("- "), x)).otherwise(F.concat(F.lit("```\n"), x, F.lit("\n```")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(lines, form), "\r\n\r\n").alias("text"))


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: regexp_matches(x, '^[A-Za-z]')) AS ls FROM documents), x AS (SELECT doc_id, unnest(ls) AS t, unnest(range(0, len(ls))) AS i FROM l)
SELECT doc_id, i::INT + 1 AS position, ['heading', 'paragraph', 'list', 'code'][i % 4 + 1] AS kind, CASE WHEN i % 4 = 0 THEN 2 ELSE 0 END AS level, CASE i % 4 WHEN 2 THEN '- ' || t WHEN 3 THEN '```' || chr(10) || t || chr(10) || '```' ELSE t END AS text FROM x""")
def markdown_typed(spark, sf_dir):
    """Blocks of Markdown documents."""
    return markdown_blocks(marked_down(spark, sf_dir))


@query()
def markdown_chunks(spark, sf_dir):
    """Markdown documents as children with their parents. No SQL: tokens, sentences and merging."""
    return chunk(markdown_blocks(marked_down(spark, sf_dir)))
