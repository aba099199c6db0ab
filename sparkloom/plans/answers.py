"""Queries on the way from hits to a checked answer, on limits, queues and chains, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assembly, chains, citations, gate, limits, queue, retrieval
from ..sources.tables import table
from .evidence import FLAT, HITS, SAID, _comparable, _steps, best, said
from .registry import registry
from .search import FUSED, LEGS, TOKENS, docs

QUERIES, SQL, query = registry()


@query(f"""WITH RECURSIVE {HITS}, w AS (SELECT query_id, doc_id, rank, {FLAT} AS same, list_distinct({TOKENS}) AS ts FROM hits),
g AS (SELECT query_id, 0::BIGINT AS rank, NULL::BIGINT AS doc_id, FALSE AS kept, [] AS seen FROM (SELECT DISTINCT query_id FROM w) UNION ALL
SELECT w.query_id, w.rank, w.doc_id, ok, CASE WHEN ok THEN list_append(seen, {{'same': w.same, 'ts': w.ts}}) ELSE seen END FROM (
 SELECT w.*, g.seen, len(list_filter(g.seen, lambda k: k.same = w.same OR len(list_intersect(k.ts, w.ts)) >= 0.85 * (len(k.ts) + len(w.ts) - len(list_intersect(k.ts, w.ts))))) = 0 AS ok FROM g JOIN w ON w.query_id = g.query_id AND w.rank = g.rank + 1) w)
SELECT query_id, doc_id, rank FROM g WHERE kept""".replace("[] AS seen", "[]::STRUCT(same VARCHAR, ts VARCHAR[])[] AS seen"))
def unlike_kept(spark, sf_dir):
    """Hits that repeat no better hit that was kept, by equal texts and by their words."""
    return assembly.unlike_kept(best(spark, sf_dir), bits=None).select("query_id", "doc_id", "rank")


def packed(spark, sf_dir) -> DataFrame:
    return assembly.packed(assembly.unlike_kept(best(spark, sf_dir)))


@query()
def packed_evidence(spark, sf_dir):
    """Blocks of every question within its budget, the last one cut. Recursion over texts: brute force in the tests."""
    return packed(spark, sf_dir).where("block IS NOT NULL").select("query_id", "block", "doc_id", "body", "n_tokens", "truncated")


@query(f"""WITH {HITS}, b AS (SELECT query_id, rank, substr(sha256(doc_id::VARCHAR), 1, 8) AS id, '<evidence id="' || substr(sha256(doc_id::VARCHAR), 1, 8) || '" doc="' || trim(translate(left(text, 40), '"' || chr(10), ''' ')) || '"'
 || CASE WHEN source <> '' THEN ' source="' || source || '"' ELSE '' END || ' page="' || (doc_id % 9) || '"' || CASE WHEN doc_id % 7 = 3 THEN ' superseded="true"' ELSE '' END || '>' || chr(10) || left(text, 200) || chr(10) || '</evidence>' AS t FROM hits)
SELECT query_id, count(*)::INT AS n_blocks, string_agg(t, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Evidence ids, strongest first: ' || string_agg(id, ', ' ORDER BY rank) AS prompt FROM b GROUP BY query_id""")
def evidence_prompts(spark, sf_dir):
    """The evidence section of each question's prompt."""
    hits = best(spark, sf_dir).withColumn("block_id", F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8))
    block = assembly.rendered(F.col("block_id"), F.substring("text", 1, 40), F.substring("text", 1, 200), source=F.col("source"), page=F.pmod("doc_id", F.lit(9)), superseded=F.pmod("doc_id", F.lit(7)) == 3)
    return assembly.prompts(hits.withColumn("rendered", block), order="rank")


CLAIMED = """cl AS (SELECT conv_id AS answer_id, turn AS n, CASE WHEN (conv_id + turn) % 6 = 5 THEN 'caveat' ELSE 'claim' END AS kind, CASE WHEN (conv_id + turn) % 5 IN (1, 2) THEN (SELECT s.t FROM said s WHERE s.conv_id = v.conv_id AND s.turn = v.turn - 1) || ' ' || split_part(t, '.', 1) ELSE t END AS text,
 CASE (conv_id + turn) % 5 WHEN 0 THEN [] WHEN 1 THEN ['b' || (turn - 1)] WHEN 2 THEN ['b' || (turn - 1), 'b99'] WHEN 3 THEN ['b' || turn, 'b' || (turn - 1)] ELSE ['b0'] END AS ids FROM said v WHERE role = 'assistant')"""


def claims(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Replies as claims that cite turns of their conversation, some of them unknown ones, and the turns as blocks."""
    s = said(spark, sf_dir)
    blocks = s.select(F.col("conv_id").alias("answer_id"), F.concat(F.lit("b"), "turn").alias("block_id"), F.col("t").alias("text"))
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))
    before, own = F.concat(F.lit("b"), F.col("turn") - 1), F.concat(F.lit("b"), "turn")
    ids = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(before)).when(k == 2, F.array(before, F.lit("b99"))).when(k == 3, F.array(own, before)).otherwise(F.array(F.lit("b0")))
    kind = F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6)) == 5, "caveat").otherwise("claim")
    last = s.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("t").alias("said_before"))
    rows = s.where("role = 'assistant'").join(last, ["conv_id", "turn"], "left")
    text = F.when(k.isin(1, 2), F.concat("said_before", F.lit(" "), F.substring_index("t", ".", 1))).otherwise(F.col("t"))
    return rows.select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("n"), kind.alias("kind"), text.alias("text"), ids.alias("ids")), blocks


def _tokens(x: str) -> str:
    return f"list_distinct({TOKENS.replace(chr(39) * 2, chr(39) * 2).replace('text', x)})"


VERDICTS = rf"""{SAID}, {CLAIMED}, ci AS (SELECT answer_id, n, text, unnest(ids) AS block_id, unnest(range(1, len(ids) + 1)) AS pos FROM cl), bl AS (SELECT conv_id AS answer_id, 'b' || turn AS block_id, t AS ground FROM said),
me AS (SELECT ci.*, ground FROM ci LEFT JOIN bl USING (answer_id, block_id)),
gr AS (SELECT answer_id, n, string_agg(ground, ' ' ORDER BY pos) AS ground, list(block_id ORDER BY pos) FILTER (ground IS NULL) AS unknown, list(block_id ORDER BY pos) FILTER (ground IS NOT NULL) AS known,
 max(CASE WHEN ground IS NULL THEN NULL WHEN len({_tokens('text')}) = 0 THEN 1 ELSE len(list_intersect({_tokens('text')}, {_tokens('ground')})) / len({_tokens('text')}) END) AS entailment FROM me GROUP BY answer_id, n),
{_steps().replace('FROM said', 'FROM (SELECT answer_id AS conv_id, n AS turn, kind AS role, coalesce(text, %s) AS t FROM cl)' % (chr(39) * 2))},
ve AS (SELECT cl.*, coalesce(unknown, []) AS unknown, coalesce(known, []) AS known, entailment, CASE WHEN kind = 'claim' AND len(known) > 0 THEN list_filter(vs, lambda v: NOT (contains({_comparable("coalesce(ground, '')")}, {_comparable('v')})
 OR (length(regexp_replace(v, '[^\d.]', '', 'g')) >= 2 AND contains({_comparable("coalesce(ground, '')")}, regexp_replace(v, '[^\d.]', '', 'g'))))) ELSE [] END AS missing FROM cl JOIN vals ON conv_id = answer_id AND turn = n LEFT JOIN gr USING (answer_id, n)),
v AS (SELECT *, CASE WHEN kind <> 'claim' THEN NULL WHEN len(known) = 0 THEN '{citations.UNCITED}' WHEN len(missing) > 0 THEN '{citations.VALUE}' WHEN entailment < 0.35 THEN '{citations.WORDS}' END AS reason FROM ve)"""


@query(f"WITH {VERDICTS} SELECT answer_id, n, kind, reason IS NULL AS supported, reason, array_to_string(missing, '|') AS missing, round(entailment, 6) AS entailment, array_to_string(unknown, '|') AS unknown FROM v")
def claim_verdicts(spark, sf_dir):
    """Every claim against the turns it cites."""
    found = citations.verdicts(*claims(spark, sf_dir))
    return found.select("answer_id", "n", "kind", "supported", "reason", F.array_join("missing", "|").alias("missing"), "entailment", F.array_join("unknown", "|").alias("unknown"))


SUMMARY = """s AS (SELECT answer_id, count(*) FILTER (kind = 'claim') AS n_claims, count(*) FILTER (reason IS NOT NULL) AS n_unsupported, count(*) FILTER (kind = 'claim' AND len(known) = 0) AS n_uncited,
 max(CASE WHEN list_contains(unknown, 'b99') THEN 'b99' END) AS unknown, list_sort(list_distinct(flatten(list(missing)))) AS missing FROM v GROUP BY answer_id),
f AS (SELECT *, CASE WHEN unknown IS NOT NULL THEN 'cited unknown evidence ids: ' || unknown WHEN n_uncited > 0 THEN n_uncited || ' claim(s) carried no citation' WHEN len(missing) > 0 THEN 'values not present in the cited evidence: ' || array_to_string(missing[1:5], ', ')
 WHEN n_unsupported > 0 THEN n_unsupported || ' claim(s) were not supported by their cited evidence' END AS failure FROM s)"""


@query(f"WITH {VERDICTS}, {SUMMARY} SELECT answer_id, n_claims, n_unsupported, n_uncited, round(CASE WHEN n_claims = 0 THEN 1 ELSE (n_claims - n_unsupported) / n_claims END, 6) AS support, failure FROM f")
def citation_support(spark, sf_dir):
    """How far each answer is borne out by what it cites, and its first fault."""
    return citations.summary(citations.verdicts(*claims(spark, sf_dir))).select("answer_id", "n_claims", "n_unsupported", "n_uncited", "support", "failure")


@query(f"""WITH {VERDICTS}, {SUMMARY}, k AS (SELECT answer_id, n, unnest(known) AS block_id, unnest(range(0, len(known))) AS pos FROM v JOIN f USING (answer_id) WHERE reason IS NULL AND failure IS NOT NULL),
m AS (SELECT answer_id, block_id, min(n * 1000 + pos) AS o FROM k GROUP BY ALL) SELECT answer_id, block_id, row_number() OVER (PARTITION BY answer_id ORDER BY o) AS pos FROM m""")
def retry_evidence(spark, sf_dir):
    """The blocks that a failed answer's second pass is given."""
    rows, blocks = claims(spark, sf_dir)
    checked = citations.verdicts(rows, blocks)
    return citations.second_pass(checked, citations.summary(checked), blocks).select("answer_id", "block_id", "pos")


ADMIT = """e AS (SELECT user_id % 7 AS tenant_id, user_id % 21 AS user_id, event_id, epoch_us(ts) AS t FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY t, event_id) AS i FROM e),
r AS (SELECT tenant_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::BOOLEAN AS allowed, NULL::BIGINT AS used, NULL::BIGINT AS remaining, NULL::BIGINT AS retry_after, NULL::VARCHAR AS refused_by, []::STRUCT(u BIGINT, t BIGINT)[] AS hits FROM (SELECT DISTINCT tenant_id FROM o) UNION ALL
SELECT tenant_id, i, event_id, nu < 3 AND nt < 6, CASE WHEN nu >= 3 THEN nu WHEN nt >= 6 THEN nt WHEN 6 - nt < 3 - nu THEN nt + 1 ELSE nu + 1 END, CASE WHEN nu >= 3 OR nt >= 6 THEN 0 ELSE least(2 - nu, 5 - nt) END,
 CASE WHEN nu >= 3 THEN greatest(1, ceil((list_filter(h, lambda x: x.u = user_id)[1].t + w - t) / 1000000)) WHEN nt >= 6 THEN greatest(1, ceil((h[1].t + w - t) / 1000000)) ELSE 0 END::BIGINT,
 CASE WHEN nu >= 3 THEN 'user' WHEN nt >= 6 THEN 'tenant' END, CASE WHEN nu < 3 AND nt < 6 THEN list_append(h, {'u': user_id, 't': t}) ELSE h END
FROM (SELECT *, len(h) AS nt, len(list_filter(h, lambda x: x.u = user_id)) AS nu FROM (SELECT o.*, 86400000000 AS w, list_filter(r.hits, lambda x: x.t > o.t - 86400000000) AS h FROM r JOIN o ON o.tenant_id = r.tenant_id AND o.i = r.i + 1)))"""


def requests(events: DataFrame) -> DataFrame:
    """Events as requests of the users of seven tenants."""
    return events.select(F.pmod("user_id", F.lit(7)).alias("tenant_id"), F.pmod("user_id", F.lit(21)).alias("user_id"), "event_id", "ts")


@query(f"WITH RECURSIVE {ADMIT} SELECT event_id, allowed, used::INT AS used, remaining::INT AS remaining, retry_after, refused_by FROM r WHERE i > 0")
def admissions(spark, sf_dir):
    """Three requests a user and six a tenant in a day; refused ones are charged to nobody."""
    return limits.admissions(requests(table(spark, sf_dir, "events")), 3, 6, 86_400)


@query("""WITH RECURSIVE e AS (SELECT doc_id, CASE WHEN doc_id % 97 = 5 THEN doc_id - 1 WHEN doc_id % 10 < 8 THEN doc_id + 1 + doc_id % 3 END AS replaced_by FROM documents),
p AS (SELECT doc_id, min(replaced_by) AS nxt FROM e WHERE replaced_by IS NOT NULL GROUP BY doc_id), named AS (SELECT DISTINCT nxt AS doc_id FROM p WHERE nxt NOT IN (SELECT doc_id FROM p)),
w AS (SELECT doc_id, nxt, 1::BIGINT AS n, [doc_id] AS seen FROM p UNION ALL SELECT w.doc_id, p.nxt, n + 1, list_append(seen, w.nxt) FROM w JOIN p ON p.doc_id = w.nxt WHERE NOT list_contains(seen, w.nxt)),
z AS (SELECT doc_id, max(nxt) FILTER (nxt NOT IN (SELECT doc_id FROM p)) AS latest, max(n) AS n FROM w GROUP BY doc_id)
SELECT doc_id, latest, CASE WHEN latest IS NOT NULL THEN n END AS n_steps, latest IS NULL AS in_cycle FROM z UNION ALL SELECT doc_id, doc_id, 0, FALSE FROM named""")
def supersession_chains(spark, sf_dir):
    """The latest version of every document that is replaced, over chains with some cycles in them."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    after = F.when(F.pmod(i, F.lit(97)) == 5, i - 1).when(F.pmod(i, F.lit(10)) < 8, i + 1 + F.pmod(i, F.lit(3)))
    return chains.chains(d.select("doc_id", after.alias("replaced_by")))


ACTIONS = ["claim", "claim", "claim", "heartbeat", "checkpoint", "complete", "fail", "fail", "reclaim", "claim"]
LOG = f"""lg AS (SELECT event_id // 8 AS job_id, event_id AS seq, floor(epoch_us(ts) / 1000000)::BIGINT AS t, {ACTIONS}[event_id % 10 + 1] AS action, 'w' || (event_id // 10 % 2) AS worker,
 CASE event_id % 10 WHEN 4 THEN {queue.STAGES}[event_id // 10 % 6 + 1] WHEN 6 THEN 'timeout' WHEN 7 THEN CASE WHEN event_id % 3 = 0 THEN 'corrupt_document' ELSE 'timeout' END END AS detail FROM events),
lo AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t, seq) AS i FROM lg), PLAY"""
PLAY = f"""q AS (SELECT job_id, 0::BIGINT AS i, 'QUEUED' AS status, NULL::VARCHAR AS worker, NULL::BIGINT AS lease_until, NULL::BIGINT AS run_after, 0::BIGINT AS attempts, NULL::VARCHAR AS stage, NULL::VARCHAR AS code, 0::BIGINT AS n_claims, 0::BIGINT AS n_refused, 0::BIGINT AS n_lost
 FROM (SELECT DISTINCT job_id FROM lo) UNION ALL SELECT job_id, i, CASE x WHEN 'claim' THEN 'RUNNING' WHEN 'complete' THEN 'DONE' WHEN 'dead' THEN 'DEAD' WHEN 'fail' THEN 'QUEUED' WHEN 'reclaim' THEN 'QUEUED' ELSE status END,
 CASE WHEN x = 'claim' THEN by_worker WHEN x IN ('fail', 'reclaim') THEN NULL ELSE worker END, CASE WHEN x IN ('claim', 'heartbeat') THEN t + 400000 WHEN x IN ('complete', 'dead', 'fail', 'reclaim') THEN NULL ELSE lease_until END,
 CASE WHEN x = 'fail' THEN t + floor(least(600, 2 * pow(2, attempts - 1)) * (('0x' || substr(md5(job_id || ':' || attempts), 1, 4))::BIGINT / 65536))::BIGINT WHEN x = 'reclaim' THEN t ELSE run_after END, attempts + (x = 'claim')::INT,
 CASE WHEN x = 'checkpoint' THEN detail WHEN x = 'complete' THEN 'ACTIVATED' ELSE stage END, CASE WHEN x IN ('fail', 'dead') THEN detail WHEN x = 'complete' THEN NULL ELSE code END,
 n_claims + (x = 'claim')::INT, n_refused + (x = 'refused')::INT, n_lost + (x = 'lost')::INT
 FROM (SELECT q.*, lo.t, lo.detail, lo.worker AS by_worker, lo.i AS i2, CASE WHEN action = 'claim' THEN CASE WHEN status = 'QUEUED' AND coalesce(run_after, 0) <= lo.t THEN 'claim' ELSE 'refused' END
  WHEN action = 'reclaim' THEN CASE WHEN status = 'RUNNING' AND lease_until < lo.t THEN 'reclaim' ELSE '' END WHEN status <> 'RUNNING' OR q.worker <> lo.worker THEN 'lost'
  WHEN action = 'fail' AND (attempts >= 5 OR list_contains({queue.PERMANENT}, lo.detail)) THEN 'dead' ELSE action END AS x FROM q JOIN lo ON lo.job_id = q.job_id AND lo.i = q.i + 1))"""
PLAY = PLAY.replace("UNION ALL SELECT job_id, i, CASE x", "UNION ALL SELECT job_id, i2, CASE x")


def job_log(spark, sf_dir) -> DataFrame:
    """Events as calls on jobs, eight on each, by two workers."""
    e = table(spark, sf_dir, "events")
    k, ten = F.pmod("event_id", F.lit(10)), F.floor(F.col("event_id") / 10)
    pick = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    detail = F.when(k == 4, pick(queue.STAGES[:6], F.pmod(ten, F.lit(6)))).when(k == 6, "timeout").when(k == 7, F.when(F.pmod("event_id", F.lit(3)) == 0, "corrupt_document").otherwise("timeout"))
    return e.select(F.floor(F.col("event_id") / 8).alias("job_id"), F.col("event_id").alias("seq"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("t"), pick(ACTIONS, k).alias("action"), F.concat(F.lit("w"), F.pmod(ten, F.lit(2))).alias("worker"), detail.alias("detail"))


@query(f"WITH RECURSIVE {LOG.replace('PLAY', PLAY)} SELECT * EXCLUDE (i) FROM (SELECT *, max(i) OVER (PARTITION BY job_id) AS last FROM q) WHERE i = last".replace("SELECT * EXCLUDE (i)", "SELECT * EXCLUDE (i, last)"))
def queue_replay(spark, sf_dir):
    """What every job came to by its log of calls."""
    return queue.replay(job_log(spark, sf_dir), lease=400_000)


@query(f"""WITH RECURSIVE {LOG.replace('PLAY', PLAY.replace('400000', '4000'))}, z AS (SELECT * FROM (SELECT *, max(i) OVER (PARTITION BY job_id) AS last FROM q) WHERE i = last), n AS (SELECT max(t) AS now FROM lg)
SELECT job_id, worker, lease_until, array_to_string({queue.STAGES}[coalesce(list_position({queue.STAGES}, stage), 0) + 1 :], '|') AS todo FROM z, n WHERE status = 'RUNNING' AND lease_until < now ORDER BY lease_until, job_id LIMIT 100""")
def queue_expired(spark, sf_dir):
    """The next batch of leases that have run out, and the stages that their jobs still have to go through."""
    log = job_log(spark, sf_dir)
    states = queue.replay(log, lease=4_000).crossJoin(F.broadcast(log.agg(F.max("t").alias("now"))))
    return queue.expired(states, F.col("now")).select("job_id", "worker", "lease_until", F.array_join(queue.remaining(F.col("stage")), "|").alias("todo"))


ODD = """bq AS (SELECT item_id, CASE item_id % 6 WHEN 1 THEN text || ' for TKT-9981-2' WHEN 2 THEN 'what is zzqx' WHEN 3 THEN substr(text, 1, 60) || ' qqa qqb qqc qqd qqe qqf qqg qqh qqi qqj qqk qql' ELSE text END AS text FROM benchmark)"""


def odd_questions(spark, sf_dir) -> DataFrame:
    """Benchmark passages as questions, some with an identifier, with words, or only with words that nothing has."""
    i, t = F.pmod("item_id", F.lit(6)), F.col("text")
    odd = F.when(i == 1, F.concat(t, F.lit(" for TKT-9981-2"))).when(i == 2, "what is zzqx").when(i == 3, F.concat(F.substring(t, 1, 60), F.lit(" qqa qqb qqc qqd qqe qqf qqg qqh qqi qqj qqk qql"))).otherwise(t)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), odd.alias("text"))


def _asked(x: str) -> str:
    ts = TOKENS.replace("coalesce(text, '')", f"coalesce({x}, '')")
    return f"list_filter({ts}, lambda t: NOT list_contains({gate.ASKING}, t))"


GATE = f"""{ODD}, {LEGS.replace('FROM benchmark', 'FROM bq')}, {FUSED.format(w='1.0')}, h AS (SELECT f.query_id, f.doc_id, f.score, d.text, f.doc_id % 3 > 0 AS old FROM fused f JOIN documents d USING (doc_id) WHERE rank <= 10),
a AS (SELECT item_id AS query_id, list_distinct({_asked('text')}) AS terms, list_distinct(regexp_extract_all(text, '{gate.IDENTIFIER[1:-1]}')) AS ids FROM bq),
s AS (SELECT query_id, count(*) AS n, count(*) FILTER (score >= 0.0164) AS n_supporting, count(*) FILTER (score >= 0.0164 AND NOT old) AS n_current, list_distinct(flatten(list({TOKENS}) FILTER (score >= 0.0164))) AS has,
 string_agg(lower(text), ' ') FILTER (score >= 0.0164) AS said FROM h GROUP BY query_id),
j AS (SELECT *, len(list_filter(ids, lambda i: NOT contains(coalesce(said, ''), lower(i)))) AS lost, len(list_filter(terms, lambda t: NOT list_contains(coalesce(has, []), t))) AS gone FROM a LEFT JOIN s USING (query_id)),
k AS (SELECT *, CASE WHEN n IS NULL THEN 1 WHEN n_supporting < 1 THEN 2 WHEN n_current = 0 THEN 3 WHEN lost > 0 THEN 4 WHEN len(terms) > 0 AND (len(terms) - gone) / len(terms) < 0.6 THEN 5 ELSE 0 END AS step FROM j),
near AS (SELECT query_id, list(doc_id ORDER BY score DESC, doc_id) AS ds FROM (SELECT DISTINCT h.query_id, h.doc_id, h.score FROM h JOIN k USING (query_id) WHERE step = 2 OR (step > 2 AND score >= 0.0164)) GROUP BY query_id)"""
_REASONS = "[NULL, 'no_results', 'weak_evidence', 'only_superseded', 'incomplete_evidence', 'incomplete_evidence'][step + 1]"


def gated(spark, sf_dir) -> DataFrame:
    d, q = docs(spark, sf_dir), odd_questions(spark, sf_dir)
    lexical = retrieval.bm25(d, q, 20).select("query_id", F.lit("bm25").alias("leg"), "doc_id", "rank")
    exact = retrieval.top(retrieval.phrase(d, q, 8), 20, "n").select("query_id", F.lit("exact").alias("leg"), "doc_id", "rank")
    hits = retrieval.rrf(lexical.unionByName(exact)).where("rank <= 10").join(d.select("doc_id", "text"), "doc_id").withColumn("is_superseded", F.pmod("doc_id", F.lit(3)) > 0)
    return gate.assess(q, hits, score=0.0164)


@query(f"""WITH {GATE} SELECT query_id, step = 0 AS sufficient, {_REASONS} AS reason, CASE WHEN step = 0 THEN n_supporting ELSE 0 END AS n_supporting,
 CASE WHEN step IN (0, 5) THEN round(CASE WHEN len(terms) = 0 THEN 1 ELSE (len(terms) - gone) / len(terms) END, 6) ELSE 0 END AS coverage, CASE step WHEN 1 THEN len(terms) WHEN 2 THEN len(terms) WHEN 3 THEN 0 WHEN 4 THEN lost ELSE gone END::INT AS n_missing FROM k""")
def evidence_verdicts(spark, sf_dir):
    """Whether the fused hits of each question can carry an answer, and why not."""
    return gated(spark, sf_dir).select("query_id", "sufficient", "reason", "n_supporting", "coverage", F.size("missing").alias("n_missing"))


_SAID = "CASE reason " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in gate.MESSAGES.items()) + " END"
_HELP = "CASE reason " + " ".join(f"WHEN '{k}' THEN 'What might help:' || " + " || ".join(f"chr(10) || '  - {x}'" for x in v) for k, v in gate.SUGGESTIONS.items() if v) + " END"


@query(f"""WITH {GATE}, r AS (SELECT query_id, {_REASONS} AS reason, ds FROM k LEFT JOIN near USING (query_id) WHERE step > 0)
SELECT query_id, reason, concat_ws(chr(10) || chr(10), {_SAID}, CASE WHEN len(ds) > 0 THEN 'The closest things I found were:' || chr(10) || array_to_string(list_transform(ds[1:3], lambda d: '  - document ' || d), chr(10)) END, {_HELP}) AS message FROM r""")
def abstention_messages(spark, sf_dir):
    """What is said to every question that is refused."""
    rows = gated(spark, sf_dir).where("NOT sufficient")
    titles = F.transform("near", lambda d: F.concat(F.lit("document "), d.cast("string")))
    return rows.select("query_id", "reason", gate.message(F.col("reason"), titles).alias("message"))
