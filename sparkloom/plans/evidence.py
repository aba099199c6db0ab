"""Queries on evidence, answers and tables that are kept up to date, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrow
from ..functions import text as T
from ..operators import access, evidence, jobs, lifecycle, planner, retrieval
from ..sources.tables import table
from ..streaming import joins
from .registry import registry
from . import platform
from .search import BM25, PHRASE, TOKENS, docs, questions
from .understanding import RULES, asked

QUERIES, SQL, query = registry()


def best(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    """The best hits of every question with their texts."""
    d = docs(spark, sf_dir)
    return retrieval.bm25(d, questions(spark, sf_dir), k).join(d.select("doc_id", "text", "source"), "doc_id")


FLAT = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
HITS = f"{BM25}, hits AS (SELECT query_id, doc_id, score, rank, text, source, {FLAT} AS flat FROM bm25 JOIN documents USING (doc_id) WHERE rank <= 8)"


@query(f"WITH {HITS} SELECT query_id, doc_id, rank FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.query_id = h.query_id AND o.rank < h.rank AND contains(o.flat, h.flat))")
def uncontained_hits(spark, sf_dir):
    """Hits without those that a better one contains."""
    return evidence.uncontained(best(spark, sf_dir)).select("query_id", "doc_id", "rank")


@query(f"""WITH {HITS}, w AS (SELECT query_id, doc_id, rank, list_distinct({TOKENS}) AS ts FROM hits)
SELECT query_id, doc_id, rank FROM w h WHERE NOT EXISTS (SELECT 1 FROM w o WHERE o.query_id = h.query_id AND o.rank < h.rank AND CASE WHEN len(o.ts) + len(h.ts) = 0 THEN TRUE
 ELSE len(list_intersect(o.ts, h.ts)) / (len(o.ts) + len(h.ts) - len(list_intersect(o.ts, h.ts))) >= 0.6 END)""")
def unlike_hits(spark, sf_dir):
    """Hits without near copies of better ones."""
    return evidence.unlike(best(spark, sf_dir), 0.6).select("query_id", "doc_id", "rank")


@query(f"WITH {HITS} SELECT query_id, doc_id, source AS parent_id, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1 AS expands FROM hits")
def parent_expansion(spark, sf_dir):
    return evidence.first_of_parent(best(spark, sf_dir).withColumnRenamed("source", "parent_id")).select("query_id", "doc_id", "parent_id", "expands")


@query(f"""WITH {HITS}, s AS (SELECT DISTINCT query_id, doc_id, score, trim(sentence) AS sentence FROM (SELECT query_id, doc_id, score, unnest(regexp_split_to_array(text, '(?:[.!?]\\s+|\\n)')) AS sentence FROM hits) WHERE length(trim(sentence)) > 0),
x AS (SELECT s.query_id, sentence, s.score, len(list_intersect(q.ts, list_distinct({TOKENS.replace("coalesce(text, '')", 'sentence')}))) AS shared FROM s JOIN q USING (query_id)),
b AS (SELECT query_id, sentence, round(max(shared + CASE WHEN regexp_matches(sentence, '[0-9]') THEN 0.5 ELSE 0 END + score), 6) AS score FROM x WHERE shared > 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sentence) AS pos FROM b) SELECT query_id, pos, sentence, score FROM r WHERE pos <= 3""".replace("\\\\", "\\"))
def extractive_answers(spark, sf_dir):
    """Three sentences of the hits that answer each question best."""
    return evidence.extract(best(spark, sf_dir), questions(spark, sf_dir)).select("query_id", "pos", "sentence", "score")


SAID = """said AS (SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 4 = 0 THEN text || ' On 12 March 2024 and 2024-03-01, AB-123 in 4.2.1 asks 15 % of 1,200 EUR in 3 days at 10:30 from two. It is "gross misconduct" or “fair use”.' ELSE text END AS t FROM conversations)"""


def said(spark, sf_dir) -> DataFrame:
    more = F.lit(' On 12 March 2024 and 2024-03-01, AB-123 in 4.2.1 asks 15 % of 1,200 EUR in 3 days at 10:30 from two. It is "gross misconduct" or “fair use”.')
    t = F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)) == 0, F.concat("text", more)).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", t.alias("t"))


def _steps() -> str:
    out, rest = [], "said"
    for i, p in enumerate(evidence.VALUES):
        t = "t" if i == 0 else "rest"
        found = f"list_transform(regexp_extract_all({t}, '{p}'), lambda v: trim(v))"
        so_far = found if i == 0 else f"list_concat(vs, {found})"
        out.append(f"v{i} AS (SELECT conv_id, turn, role, t, {so_far} AS vs, regexp_replace({t}, '{p}', ' ', 'g') AS rest FROM {rest})")
        rest = f"v{i}"
    quoted = f"list_transform(regexp_extract_all(t, '{evidence.QUOTED}', 1), lambda v: trim(v))"
    named = ", ".join(f"CASE WHEN regexp_matches(t, '(?i)\\b{w}\\b') THEN ['{w}', '{n}'] ELSE [] END" for w, n in evidence.NUMBERS.items())
    out.append(f"vn AS (SELECT conv_id, turn, role, t, list_concat(list_concat(vs, {quoted}), flatten([{named}])) AS vs FROM {rest})")
    out.append("vals AS (SELECT conv_id, turn, role, t, list_filter(vs, lambda v, i: list_position(vs, v) = i) AS vs FROM vn)")
    return ", ".join(out)


@query(f"WITH {SAID}, {_steps()} SELECT conv_id, turn, array_to_string(vs, '|') AS found FROM vals")
def answer_values(spark, sf_dir):
    """Values of every turn that an answer must not change."""
    return said(spark, sf_dir).select("conv_id", "turn", F.array_join(evidence.values(F.col("t")), "|").alias("found"))


def _comparable(x: str) -> str:
    out = rf"replace(trim(regexp_replace(lower({x}), '\s+', ' ', 'g')), ',', '')"
    for w, n in evidence.NUMBERS.items():
        out = rf"regexp_replace({out}, '\b{w}\b', '{n}', 'g')"
    return out


@query(rf"""WITH {SAID}, {_steps()}, g AS (SELECT conv_id, string_agg(t, ' ' ORDER BY turn) AS ground FROM said WHERE role <> 'assistant' GROUP BY conv_id),
c AS (SELECT vals.conv_id, turn, vs, t, {_comparable("coalesce(ground, '')")} AS ground, coalesce(ground, '') AS said FROM vals LEFT JOIN g USING (conv_id) WHERE role = 'assistant'),
k AS (SELECT conv_id, turn, len(vs) AS n_values, len(list_filter(vs, lambda v: NOT (contains(ground, {_comparable('v')}) OR (length(regexp_replace(v, '[^\d.]', '', 'g')) >= 2 AND contains(ground, regexp_replace(v, '[^\d.]', '', 'g')))))) AS n_missing,
 list_distinct({TOKENS.replace("coalesce(text, '')", 't')}) AS ct, list_distinct({TOKENS.replace("coalesce(text, '')", 'said')}) AS gt FROM c)
SELECT conv_id, turn, n_values::BIGINT AS n_values, n_missing::BIGINT AS n_missing, round(CASE WHEN len(ct) = 0 THEN 1 ELSE len(list_intersect(ct, gt)) / len(ct) END, 6) AS entailment,
 n_missing = 0 AND CASE WHEN len(ct) = 0 THEN 1 ELSE len(list_intersect(ct, gt)) / len(ct) END >= 0.35 AS holds FROM k""")
def claim_support(spark, sf_dir):
    """Whether what was said before supports each reply: all of its values, and a third of its words."""
    s = said(spark, sf_dir)
    ground = s.where("role <> 'assistant'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), " ").alias("ground"))
    rows = s.where("role = 'assistant'").join(ground, "conv_id", "left").withColumn("ground", F.coalesce("ground", F.lit("")))
    rows = rows.withColumns({"vs": evidence.values(F.col("t")), "flat": evidence.comparable(F.col("ground")), "e": evidence.entailment(F.col("t"), F.col("ground"))})
    gone = F.size(F.filter("vs", lambda v: ~evidence.supported(v, F.col("flat"))))
    return rows.select("conv_id", "turn", F.size("vs").cast("long").alias("n_values"), gone.cast("long").alias("n_missing"), F.round("e", 6).alias("entailment"), ((gone == 0) & (F.col("e") >= 0.35)).alias("holds"))


@query(rf"""WITH {RULES}, g AS (SELECT conv_id, lower(string_agg(text, ' ')) AS ground FROM conversations WHERE role <> 'user' GROUP BY conv_id)
SELECT conv_id, turn, array_to_string(list_filter(identifiers, lambda i: NOT contains(coalesce(ground, ''), lower(i))), '|') AS missing FROM p LEFT JOIN g USING (conv_id) WHERE len(identifiers) > 0""")
def missing_identifiers(spark, sf_dir):
    """Identifiers of a question that nothing else in its conversation has."""
    ground = table(spark, sf_dir, "conversations").where("role <> 'user'").groupBy("conv_id").agg(F.array_join(F.collect_list("text"), " ").alias("ground"))
    rows = asked(spark, sf_dir).withColumn("ids", planner.identifiers(F.col("t"))).where(F.size("ids") > 0).join(ground, "conv_id", "left")
    return rows.select("conv_id", "turn", F.array_join(evidence.missing(F.col("ids"), F.coalesce("ground", F.lit(""))), "|").alias("missing"))


@query("SELECT sha256(text) AS sha, substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 2) || '/' || sha256(text) AS key, count(*) AS refs FROM documents GROUP BY 1, 2")
def blob_refs(spark, sf_dir):
    """Content addresses, and how many documents refer to each."""
    sha = F.sha2("text", 256)
    return docs(spark, sf_dir).groupBy(sha.alias("sha")).agg(F.count(F.lit(1)).alias("refs")).select("sha", lifecycle.blob_key(F.col("sha")).alias("key"), "refs")


FILES = """f AS (SELECT doc_id, (CASE doc_id % 7 WHEN 0 THEN '\\x25\\x50\\x44\\x46\\x2D'::BLOB WHEN 1 THEN '\\x50\\x4B\\x03\\x04'::BLOB WHEN 2 THEN '\\xFF\\xD8\\xFF'::BLOB ELSE ''::BLOB END) AS head,
 'in/' || source || '_' || lang || '-' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.html' WHEN 2 THEN '.TXT' WHEN 3 THEN '.bin' ELSE '' END AS name FROM documents)"""


@query(f"""WITH {FILES}, k AS (SELECT doc_id, name, CASE doc_id % 7 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/zip' WHEN 2 THEN 'image/jpeg' ELSE CASE doc_id % 5 WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'text/html' WHEN 2 THEN 'text/plain' ELSE 'application/octet-stream' END END AS mime FROM f)
SELECT doc_id, mime, CASE WHEN mime = 'text/markdown' THEN 'markdown' WHEN mime = 'text/html' THEN 'html' WHEN starts_with(mime, 'text/') THEN 'plain' WHEN mime IN ('application/pdf', 'image/png', 'image/jpeg') THEN 'parser' END AS loader,
 replace(regexp_replace(substr(name, 4), '\\.[A-Za-z0-9]+$', ''), '_', ' ').replace('-', ' ') AS title FROM k""".replace("\\\\", "\\"))
def file_probe(spark, sf_dir):
    """Kind, loader and title of files made from the documents: first bytes count before the name."""
    head = F.element_at(F.create_map(F.lit(0), F.lit("255044462D"), F.lit(1), F.lit("504B0304"), F.lit(2), F.lit("FFD8FF")), F.pmod("doc_id", F.lit(7)).cast("int"))
    end = F.element_at(F.create_map(F.lit(0), F.lit(".md"), F.lit(1), F.lit(".html"), F.lit(2), F.lit(".TXT"), F.lit(3), F.lit(".bin")), F.pmod("doc_id", F.lit(5)).cast("int"))
    content = F.concat(F.unhex(F.coalesce(head, F.lit(""))), F.encode("text", "UTF-8"))
    name = F.concat(F.lit("in/"), "source", F.lit("_"), "lang", F.lit("-"), F.col("doc_id").cast("string"), F.coalesce(end, F.lit("")))
    rows = docs(spark, sf_dir).select("doc_id", lifecycle.mime(content, name).alias("mime"), lifecycle.title_of(name).alias("title"))
    return rows.select("doc_id", "mime", lifecycle.loader(F.col("mime")).alias("loader"), "title")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN json_object('update', json_object('_id', doc_id::VARCHAR))::VARCHAR || chr(10) || json_object('doc', json_object('lang', lang, 'n_chars', n_chars), 'doc_as_upsert', true)::VARCHAR
 ELSE json_object('index', json_object('_id', doc_id::VARCHAR))::VARCHAR || chr(10) || json_object('lang', lang, 'n_chars', n_chars)::VARCHAR END AS action FROM documents""")
def bulk_actions(spark, sf_dir):
    body = F.struct("lang", "n_chars")
    return docs(spark, sf_dir).select("doc_id", lifecycle.action(F.col("doc_id"), body, F.pmod("doc_id", F.lit(3)) == 0).alias("action"))


@query("""WITH s AS (SELECT event_type, CASE event_id % 9 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 400 WHEN 3 THEN 409 ELSE 201 END AS status FROM events)
SELECT event_type, CASE WHEN status < 300 THEN 'succeeded' WHEN status IN (429, 502, 503, 504) THEN 'retryable' ELSE 'permanent' END AS outcome, count(*) AS n FROM s GROUP BY ALL""")
def bulk_outcomes(spark, sf_dir):
    k = F.pmod("event_id", F.lit(9))
    status = F.when(k == 0, 429).when(k == 1, 503).when(k == 2, 400).when(k == 3, 409).otherwise(201)
    return table(spark, sf_dir, "events").groupBy("event_type", lifecycle.outcome(status).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, source, row_number() OVER w AS version_no, lead(doc_id) OVER w IS NULL AS is_active, lead(doc_id) OVER w AS superseded_by FROM documents WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id)""")
def version_activation(spark, sf_dir):
    """Documents of a source and language as versions of one; only the last is active."""
    rows = docs(spark, sf_dir).select("doc_id", "source", F.concat_ws("/", "source", "lang").alias("key"))
    return lifecycle.activate(rows, "key", "doc_id").select("doc_id", "source", "version_no", "is_active", "superseded_by")


@query("""WITH e AS (SELECT source, count(*) AS expected FROM documents GROUP BY source), a AS (SELECT source, count(*) AS actual FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT coalesce(e.source, a.source) AS source, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual, coalesce(expected, 0) = 0 OR (coalesce(expected, 0) - coalesce(actual, 0)) / coalesce(expected, 0) <= 0.001 AS ok FROM e FULL JOIN a ON e.source = a.source""")
def count_reconciliation(spark, sf_dir):
    d = docs(spark, sf_dir)
    return lifecycle.reconcile(d, d.join(table(spark, sf_dir, "labels"), "doc_id"), "source")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unlabelled(spark, sf_dir):
    """Documents without a label: an anti join."""
    return docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("""WITH l AS (SELECT doc_id, n, sha256(line) AS h FROM (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
o AS (SELECT h, list_distinct(list(n)) AS ns FROM l WHERE doc_id % 2 = 0 GROUP BY h), t AS (SELECT doc_id, CASE WHEN ns IS NULL THEN 'compute' WHEN list_contains(ns, n) THEN 'keep' ELSE 'move' END AS todo FROM l LEFT JOIN o USING (h) WHERE doc_id % 2 = 1)
SELECT doc_id, todo, count(*) AS n FROM t GROUP BY ALL""")
def metadata_update(spark, sf_dir):
    """Lines of the odd documents against those of the even ones: what is kept, what only moves, what is computed."""
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("h", F.sha2("line", 256))
    odd = F.pmod("doc_id", F.lit(2)) == 1
    return lifecycle.carried_over(lines.where(odd), lines.where(~odd), "h", "n").groupBy("doc_id", "todo").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, before, event_type FROM s WHERE before IS NOT NULL AND NOT before || '>' || event_type IN ('view>click', 'click>purchase', 'signup>view', 'view>view', 'purchase>view', 'error>view')""")
def state_violations(spark, sf_dir):
    """Steps of a user that the state machine does not know."""
    known = [("view", "click"), ("click", "purchase"), ("signup", "view"), ("view", "view"), ("purchase", "view"), ("error", "view")]
    return lifecycle.transitions(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], known).select("event_id", "before", "event_type")


@query("""WITH r AS (SELECT event_id, user_id, ts, count(*) OVER w AS n, min(ts) OVER w AS oldest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW))
SELECT event_id, n <= 2 AS allowed, CASE WHEN n <= 2 THEN 0 ELSE ceil((epoch_us(oldest) + 21600000000 - epoch_us(ts)) / 1000000) END::BIGINT AS retry_after FROM r""")
def rate_decisions(spark, sf_dir):
    counted = jobs.rate(table(spark, sf_dir, "events"), "user_id", 21600)
    return lifecycle.rate_decision(counted, "user_id", 2, 21600).select("event_id", "allowed", "retry_after")


@query("""WITH n AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: (3 * x::DOUBLE) * (3 * x::DOUBLE)))) AS norm, embedding FROM embeddings)
SELECT vec_id, round(norm, 4) AS norm, round(CASE WHEN norm = 0 THEN 3 * embedding[1]::DOUBLE ELSE 3 * embedding[1]::DOUBLE / norm END, 5) AS first FROM n""")
def unit_vectors(spark, sf_dir):
    """Vectors brought to length one; a zero vector stays."""
    v = F.transform("embedding", lambda x: x.cast("double") * 3)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)).alias("norm"))
    unit = F.when(F.col("norm") == 0, F.col("v")).otherwise(F.transform("v", lambda x: x / F.col("norm")))
    return rows.select("vec_id", F.round("norm", 4).alias("norm"), F.round(F.get(unit, F.lit(0)), 5).alias("first"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    p = lambda q: F.round(F.percentile("value", q), 6)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), F.count_distinct("user_id").alias("n_users"))


@query("SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type")
def json_totals(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query("SELECT event_id, c_name, c_mktsegment FROM events LEFT JOIN customer ON c_custkey = user_id")
def stream_static_join(spark, sf_dir):
    """Events with their customer; runs on a stream of events alike."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", "c_mktsegment")
    return joins.with_table(table(spark, sf_dir, "events"), people, "user_id").select("event_id", "c_name", "c_mktsegment")


@query("""SELECT a.user_id, a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 2880 MINUTE""")
def stream_stream_join(spark, sf_dir):
    """Views that a click of the same user follows within two days; runs on two streams alike."""
    e = table(spark, sf_dir, "events")
    return joins.followed_by(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "user_id", 2880)


@query(r"""WITH n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS t FROM documents),
b AS (SELECT doc_id, unnest(string_split(t, chr(10) || chr(10))) AS p FROM n) SELECT doc_id, count(*) AS n_blocks, sum(length(trim(p, ' ' || chr(10))))::BIGINT AS n_chars FROM b WHERE trim(p, ' ' || chr(10)) <> '' GROUP BY doc_id""")
def plain_paragraphs(spark, sf_dir):
    """Plain texts as paragraphs between empty lines, blanks collapsed."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    strip = lambda c: F.trim(c, F.lit(" \n"))
    rows = docs(spark, sf_dir).select("doc_id", F.explode(F.split(strip(t), "\n\n")).alias("p")).where(strip(F.col("p")) != "")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length(strip(F.col("p")))).cast("long").alias("n_chars"))


@query("""WITH c AS (SELECT c_custkey, c_nationkey % 3 AS tenant, c_acctbal > 0 AS is_active, 10 * (1 + c_custkey % 4) AS visibility_rank, c_mktsegment AS seg, c_custkey % 13 = 0 AS no_machinery FROM customer),
u AS (SELECT n_nationkey AS user_id, n_nationkey % 3 AS tenant, 10 * (1 + n_nationkey % 4) AS rank, ['AUTOMOBILE', 'MACHINERY', 'FURNITURE', 'HOUSEHOLD'][1 + n_nationkey % 4] AS grp FROM nation)
SELECT user_id, count(*) AS n FROM u JOIN c ON u.tenant = c.tenant AND is_active AND visibility_rank <= rank AND (seg = 'BUILDING' OR seg = grp) AND NOT (no_machinery AND grp = 'MACHINERY') GROUP BY user_id""")
def acl_by_user(spark, sf_dir):
    """How many rows each user of a table may see."""
    four = F.array(*[F.lit(x) for x in ("AUTOMOBILE", "MACHINERY", "FURNITURE", "HOUSEHOLD")])
    k = F.col("n_nationkey")
    users = table(spark, sf_dir, "nation").select(k.alias("user_id"), F.concat(F.lit("tenant"), F.pmod(k, F.lit(3))).alias("tenant_id"), (10 * (1 + F.pmod(k, F.lit(4)))).alias("rank"), F.array(F.get(four, F.pmod(k, F.lit(4)))).alias("groups"))
    return access.visible_to(platform.chunks(spark, sf_dir), users, "c_custkey").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT a.n_name AS role, count(*) AS n_capabilities FROM nation a JOIN nation b ON b.n_regionkey <= a.n_regionkey GROUP BY a.n_name")
def capability_sets(spark, sf_dir):
    """What each role may do: its own capabilities and those of all lower ranks."""
    n = table(spark, sf_dir, "nation")
    roles = n.select(F.col("n_name").alias("role"), F.col("n_regionkey").alias("rank"))
    return access.capabilities(roles, n.select(F.col("n_name").alias("role"), F.concat(F.lit("can:"), "n_name").alias("capability"))).groupBy("role").agg(F.count(F.lit(1)).alias("n_capabilities"))


@query("SELECT p_partkey, array_to_string(list_transform(range(1, len(ps) + 1), lambda i: array_to_string(ps[1:i], ' > ')), '|') AS paths FROM (SELECT p_partkey, string_split(lower(p_type), ' ') AS ps FROM part)")
def heading_trees(spark, sf_dir):
    """Every path above a heading path."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.heading_tree(F.replace(F.col("p_type"), F.lit(" "), F.lit(" > "))), "|").alias("paths"))


@query("""WITH p AS (SELECT p_partkey, lower(p_brand || '-' || p_partkey || '/X') AS low, regexp_extract_all(lower(p_brand || '-' || p_partkey || '/X'), '[a-z]+|[0-9]+') AS ps FROM part),
t AS (SELECT p_partkey, list_concat(list_concat([low], ps), [array_to_string(ps, '')]) AS ts FROM p) SELECT p_partkey, array_to_string(list_filter(ts, lambda x, i: list_position(ts, x) = i), '|') AS terms FROM t""")
def exact_code_terms(spark, sf_dir):
    """The terms that codes are found by."""
    code = F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string"), F.lit("/X"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.exact_terms(code), "|").alias("terms"))


@query(f"""WITH d AS (SELECT doc_id, source, list_distinct({TOKENS}) AS ts FROM documents), l AS (SELECT doc_id, ts, lag(ts) OVER (PARTITION BY source ORDER BY doc_id) AS o FROM d)
SELECT doc_id, round(CASE WHEN len(ts) + len(o) = 0 THEN 1 ELSE len(list_intersect(ts, o)) / (len(ts) + len(o) - len(list_intersect(ts, o))) END, 6) AS jaccard FROM l WHERE o IS NOT NULL""")
def neighbour_jaccard(spark, sf_dir):
    """Overlap of each document's words with those of the one before it in its source."""
    # only ids go through the window, which holds a source in one task; the words meet by id
    d = docs(spark, sf_dir)
    pairs = d.select("doc_id", F.lag("doc_id").over(W.partitionBy("source").orderBy("doc_id")).alias("before")).where("before IS NOT NULL")
    words = d.select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("ts"))
    rows = pairs.join(words, "doc_id").join(words.select(F.col("doc_id").alias("before"), F.col("ts").alias("o")), "before")
    return rows.select("doc_id", F.round(T.jaccard(F.col("ts"), F.col("o")), 6).alias("jaccard"))


@query(f"""WITH {BM25}, {PHRASE}, b AS (SELECT item_id AS query_id, coalesce(max(score), 0) >= 20 AS answered FROM benchmark LEFT JOIN bm25 ON query_id = item_id GROUP BY item_id),
g AS (SELECT b.query_id, answered, EXISTS (SELECT 1 FROM phrase p WHERE p.query_id = b.query_id) AS answerable FROM b)
SELECT count(*) AS n, count(*) FILTER (NOT answered) AS abstained, round(coalesce(count(*) FILTER (NOT answered AND NOT answerable) / nullif(count(*) FILTER (NOT answered), 0), 1), 6) AS abstention_precision,
 round(coalesce(count(*) FILTER (NOT answered AND NOT answerable) / nullif(count(*) FILTER (NOT answerable), 0), 1), 6) AS abstention_recall, count(*) FILTER (answered AND NOT answerable) AS made_up FROM g""")
def abstention_quality(spark, sf_dir):
    """Whether questions are refused that should be, and answered that should not."""
    d, q = docs(spark, sf_dir), questions(spark, sf_dir)
    top = retrieval.bm25(d, q, 1).select("query_id", "score")
    gold = retrieval.phrase(d, q, 8).select("query_id").distinct().withColumn("answerable", F.lit(True))
    rows = q.select("query_id").join(top, "query_id", "left").join(gold, "query_id", "left")
    no, none = F.coalesce("score", F.lit(0.0)) < 20, F.col("answerable").isNull()
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.count_if(a), F.count_if(b)), F.lit(1.0)), 6)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(no).alias("abstained"), share(no & none, no).alias("abstention_precision"), share(no & none, none).alias("abstention_recall"), F.count_if(~no & none).alias("made_up"))


@query(f"""WITH {BM25} SELECT query_id, 'No source is strong enough. Closest: ' || string_agg(doc_id::VARCHAR, ', ' ORDER BY rank) AS message FROM bm25 WHERE rank <= 3 GROUP BY query_id HAVING max(score) < 60""")
def abstentions(spark, sf_dir):
    """What is said to questions without support, with the closest documents."""
    hits = retrieval.bm25(docs(spark, sf_dir), questions(spark, sf_dir), 3)
    by = hits.groupBy("query_id").agg(F.max("score").alias("best"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string")).alias("near"))
    return by.where("best < 60").select("query_id", F.concat(F.lit("No source is strong enough. Closest: "), F.array_join("near", ", ")).alias("message"))


@query()
def normal_texts(spark, sf_dir):
    """NFC texts with single blanks; their sentences and similarity hashes."""
    rows = docs(spark, sf_dir).select("doc_id", arrow.normalize(F.col("text")).alias("t"))
    return rows.select("doc_id", F.sha2("t", 256).alias("sha"), F.size(arrow.split_sentences(F.col("t"))).alias("n_sentences"), arrow.simhash64(T.tokens(F.col("t"))).alias("simhash"))


@query()
def hashed_embeddings(spark, sf_dir):
    """A vector of every benchmark passage."""
    return questions(spark, sf_dir).select("query_id", arrow.hashed_embedding(T.tokens(F.col("text")), 64).alias("embedding"))
