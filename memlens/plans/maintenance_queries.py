"""Queries over memory tables (D operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlens import fixed_values as V
from memlens.functions import text as T
from memlens.functions.scores import wilson_lower
from memlens.operators import maintenance as M
from memlens.plans import adapters as D
from memlens.plans import retrieval_queries as RQ
from memlens.plans import sqlbase as S
from memlens.plans.catalog import Query, Registry, rounded

QUERIES: Registry = {}


def _q(key, run, sql=None):
    QUERIES[key] = Query(lambda spark, sf: rounded(run(spark, sf)), sql)


_q("d1_dedupe_traces", lambda s, sf: M.dedupe_traces(RQ.traces(s, sf)).select("trace_id", "fingerprint"), S.with_(
    S.TRACES, RQ._QT[4], f"tf AS (SELECT *, {RQ._FP} AS fp FROM tf0)",
    select="SELECT trace_id, fp AS fingerprint FROM tf QUALIFY row_number() OVER (PARTITION BY fp ORDER BY created_at, trace_id)=1"))


def counted_blocks(s, sf, prefix="d", step=1):
    """Blocks with counters derived from their number and keywords of the whole text."""
    n = F.col("n")
    b = D.blocks(s, sf).withColumn("block_id", F.concat(F.lit(prefix), (n * step).cast("string")))
    none = F.lit(None).cast("string")
    b = b.withColumn("keywords", T.block_keywords(F.col("mechanism"), F.col("language"), none, none, F.col("apis")))
    b = b.withColumn("fingerprint", T.block_fingerprint(F.col("language"), none, none, F.col("apis"), F.col("keywords")))
    vals = {"times_retrieved": n % 50, "times_injected": n % 20, "times_agent_used": n % 15, "times_helpful": n % 10, "times_counterproductive": n % 7,
            "tokens_saved": n * 3, "steps_saved": n % 4}
    for c, v in vals.items():
        b = b.withColumn(c, v)
    b = b.withColumn("last_used_at", F.when(n % 3 != 0, F.lit(1_758_000_000_000) + n * 1000)).withColumn("verification_status", F.when(n % 29 == 0, "disproved").otherwise("open"))
    return b.withColumn("wilson", wilson_lower(F.col("times_helpful"), F.col("times_injected"))).withColumn("dead_ends", F.split("mechanism", r"\. "))


def counted_sql(prefix="d", step=1):
    kw = (f"list_sort(list_distinct(list_concat({S.split_set('mechanism', '[^a-z0-9_.]+', 2, V.BLOCK_STOP_WORDS)}, list_concat("
          "list_filter(['lang:'||lower(language)], lambda x: x IS NOT NULL), list_transform(apis, lambda a: 'api:'||lower(a))))))")
    return S.BLOCKS + f""",
cb0 AS (SELECT * REPLACE ('{prefix}'||(n*{step}) AS block_id), {kw} AS keywords, n%50 AS times_retrieved, n%20 AS times_injected, n%15 AS times_agent_used, n%10 AS times_helpful,
  n%7 AS times_counterproductive, n*3 AS tokens_saved, n%4 AS steps_saved, CASE WHEN n%3<>0 THEN 1758000000000+n*1000 END AS last_used_at,
  CASE WHEN n%29=0 THEN 'disproved' ELSE 'open' END AS verification_status FROM blk),
cb AS (SELECT *, coalesce(language,'')||'|'||array_to_string(apis,',')||'|'||array_to_string(keywords,',') AS fingerprint, {S.wilson('times_helpful', 'times_injected')} AS wilson FROM cb0)"""


_MG = """gr AS (SELECT fingerprint, kind, arg_min(block_id, created_at) AS winner_id, """ + ", ".join(f"sum({c})::BIGINT AS s_{c}" for c in M.COUNTERS) + """, max(last_used_at) AS s_last, count(*) AS group_size FROM cb GROUP BY 1,2),
mg AS (SELECT cb.block_id, cb.kind, winner_id, CASE WHEN block_id=winner_id THEN status ELSE 'merged' END AS status, """ + ", ".join(
    f"CASE WHEN block_id=winner_id THEN s_{c} ELSE {c} END AS {c}" for c in M.COUNTERS) + """, CASE WHEN block_id=winner_id THEN s_last ELSE last_used_at END AS last_used_at, group_size FROM cb JOIN gr USING (fingerprint, kind))"""
_q("d2_merge_blocks", lambda s, sf: M.merge_blocks(counted_blocks(s, sf)), S.with_(counted_sql(), _MG, select="SELECT * FROM mg"))


def refs(s, sf):
    """Case refs from labels (origin or counter) and from every document (supporting)."""
    l = D.table(s, sf, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("block_id"), F.col("doc_id").alias("trace_id"),
                                        F.when(F.col("toxic") == 1, "counter").otherwise("origin").alias("role"))
    d = D.documents(s, sf).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("block_id"), (F.col("doc_id") * 7 % 1500).alias("trace_id"),
                                  F.when(F.col("doc_id") % 5 == 0, "origin").otherwise("supporting").alias("role"))
    return l.unionByName(d)


_REFS = """rf AS (SELECT 'd'||doc_id AS block_id, doc_id AS trace_id, CASE WHEN toxic=1 THEN 'counter' ELSE 'origin' END AS role FROM labels
  UNION ALL SELECT 'd'||doc_id, doc_id*7%1500, CASE WHEN doc_id%5=0 THEN 'origin' ELSE 'supporting' END FROM documents)"""
_q("d2_repoint_refs", lambda s, sf: M.repoint_refs(refs(s, sf), M.merge_blocks(counted_blocks(s, sf)), True), S.with_(counted_sql(), _MG, _REFS, select="""
SELECT DISTINCT winner_id AS block_id, trace_id, CASE WHEN block_id<>winner_id AND role='origin' THEN 'supporting' ELSE role END AS role FROM rf JOIN mg USING (block_id)"""))


def stored_facts(s, sf):
    """The fact store: one row per key of the document facts, earliest id first."""
    f = D.facts(s, sf).withColumn("dedupe_key", M.fact_key(F.col("scope"), F.col("fact_type"), F.col("statement")))
    cols = ["fact_id", "scope", "fact_type", "statement", "confidence", "status", "ttl_until", "verified_at"]
    return f.groupBy("dedupe_key").agg(F.min_by(F.struct(*cols), "fact_id").alias("m")).select("dedupe_key", "m.*")


def incoming_facts(s, sf):
    """Every document stated again: even ids with other spacing (a repeat), odd ids as something new."""
    return incoming_of(D.documents(s, sf))


def incoming_of(documents):
    f = D.facts_of(documents)
    i = F.col("fact_id")
    text = F.when(i % 2 == 0, F.concat(F.lit("  "), F.regexp_replace("statement", " ", "  "), F.lit("\n"))).otherwise(F.concat("statement", F.lit(" again")))
    return f.select("scope", "fact_type", text.alias("statement"), F.lit(0.6).alias("confidence"), F.when(i % 3 == 1, i % 40 + 0.5).alias("ttl_days"), i.alias("seq"))


_NRM = lambda c: f"regexp_replace(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g')"
_KEY = lambda c: f"sha256(scope||'|'||fact_type||'|'||{_NRM(c)})"
_ST = f"""fk AS (SELECT *, {_KEY('statement')} AS dedupe_key FROM fct),
st AS (SELECT * FROM fk QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY fact_id)=1)"""
_q("d3_upsert_facts", lambda s, sf: M.upsert_facts(stored_facts(s, sf), incoming_facts(s, sf), D.NOW_MS).drop("statement"), S.with_(S.FACTS, _ST, f"""
ic AS (SELECT scope, fact_type, CASE WHEN fact_id%2=0 THEN '  '||replace(statement,' ','  ')||chr(10) ELSE statement||' again' END AS statement,
   CASE WHEN fact_id%3=1 THEN fact_id%40+0.5 END AS ttl_days, fact_id AS seq FROM fct),
ik AS (SELECT *, {_KEY('statement')} AS dedupe_key FROM ic WHERE ({S.first_rule('statement', [*V.LEAKAGE_CORE, *V.LEAKAGE_EXTENDED])}) IS NULL
   AND ({S.first_rule('statement', [(n, p if n != 'system-spoof' else '(?i)(^|[^`])<[ ]*/?[ ]*(system|user|assistant)[ ]*>([^`]|$)') for n, p in V.PROMPT_INJECTION])}) IS NULL),
ip AS (SELECT dedupe_key, count(*) AS arrivals, arg_min(ttl_days, seq) FILTER (ttl_days IS NOT NULL OR true) AS ttl0 FROM ik GROUP BY 1),
i1 AS (SELECT * FROM ik QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY seq)=1),
n AS (SELECT i1.*, arrivals FROM i1 JOIN ip USING (dedupe_key))""", select=f"""
SELECT coalesce(st.dedupe_key, n.dedupe_key) AS dedupe_key, coalesce(st.scope,n.scope) AS scope, coalesce(st.fact_type,n.fact_type) AS fact_type,
  round(CASE WHEN st.dedupe_key IS NOT NULL THEN CASE WHEN coalesce(arrivals,0)>0 THEN least(1.0, st.confidence+0.05*arrivals) ELSE st.confidence END
   ELSE CASE WHEN arrivals>1 THEN least(1.0, 0.6+0.05*(arrivals-1)) ELSE 0.6 END END::DOUBLE,6) AS confidence,
  CASE WHEN st.dedupe_key IS NULL THEN 'active' WHEN arrivals IS NOT NULL AND st.status<>'retired' THEN 'active' ELSE st.status END AS status,
  CASE WHEN arrivals IS NOT NULL THEN {D.NOW_MS} ELSE st.verified_at END AS verified_at,
  CASE WHEN st.dedupe_key IS NOT NULL THEN st.ttl_until WHEN n.ttl_days>0 THEN {D.NOW_MS}+floor(n.ttl_days*{V.DAY_MS})::BIGINT END AS ttl_until,
  CASE WHEN st.dedupe_key IS NULL THEN 'inserted' WHEN arrivals IS NOT NULL THEN 'confirmed' ELSE 'kept' END AS action
FROM st FULL JOIN n ON st.dedupe_key=n.dedupe_key"""))

_q("d4_expire", lambda s, sf: M.expire(D.facts(s, sf), D.NOW_MS).select("fact_id", "status", "expired"), S.with_(S.FACTS, select=f"""
SELECT fact_id, CASE WHEN ttl_until<={D.NOW_MS} AND status<>'retired' THEN 'retired' ELSE status END AS status, coalesce(ttl_until<={D.NOW_MS} AND status<>'retired', false) AS expired FROM fct"""))
_q("d5_prune_traces", lambda s, sf: M.prune_traces(D.traces(s, sf), 0.1, 700).select("trace_id", "created_at"), S.with_(S.TRACES, select="""
SELECT trace_id, created_at FROM tr WHERE NOT (q_score<0.1 AND recall_count>0) QUALIFY row_number() OVER (ORDER BY created_at DESC, trace_id)<=700"""))


def _orphans(s, sf):
    return M.orphan_refs(refs(s, sf), D.traces(s, sf).select("trace_id"), D.blocks(s, sf).select("block_id", "status"))


_OR = S.BLOCKS + ",\n" + _REFS + """,
r2 AS (SELECT block_id, trace_id, role AS old_role, CASE WHEN trace_id IN (SELECT doc_id FROM documents) THEN role ELSE 'orphan' END AS role FROM rf),
lo AS (SELECT block_id FROM r2 GROUP BY 1 HAVING bool_or(old_role='origin') AND NOT bool_or(role='origin'))"""
_q("d6_orphan_refs", lambda s, sf: _orphans(s, sf)[0].select("block_id", "trace_id", "role"), S.with_(_OR, select="SELECT block_id, trace_id, role FROM r2"))
_q("d6_orphaned_blocks", lambda s, sf: _orphans(s, sf)[1], S.with_(_OR, select="""
SELECT block_id, CASE WHEN status='active' AND block_id IN (SELECT block_id FROM lo) THEN 'candidate' ELSE status END AS status FROM blk"""))
_q("d7_status_integrity", lambda s, sf: M.status_integrity(D.blocks(s, sf), refs(s, sf)), S.with_(S.BLOCKS, _REFS, """
v AS (SELECT block_id, CASE WHEN block_id IN (SELECT block_id FROM rf WHERE role='counter') THEN 'active-with-counter'
  WHEN block_id NOT IN (SELECT block_id FROM rf WHERE role='origin') THEN 'active-without-origin' END AS violation FROM blk WHERE status='active')""", select="""
SELECT block_id, violation, CASE WHEN violation='active-with-counter' THEN 'demoted' ELSE 'candidate' END AS new_status FROM v WHERE violation IS NOT NULL"""))


def _erased(s, sf):
    toxic = D.table(s, sf, "labels").where("toxic = 1").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("block_id"))
    return M.erase(D.blocks(s, sf), toxic, "block_id", "toxic", D.NOW_MS)


_q("d8_erase_audit", lambda s, sf: _erased(s, sf)[1], S.with_(S.BLOCKS, select=f"""
SELECT block_id, {D.NOW_MS} AS deleted_at, 'toxic' AS reason FROM blk WHERE n IN (SELECT doc_id FROM labels WHERE toxic=1)"""))
_q("d8_erase_left", lambda s, sf: _erased(s, sf)[0].groupBy("kind", "status").agg(F.count("*").alias("n")), S.with_(S.BLOCKS, select="""
SELECT kind, status, count(*) AS n FROM blk WHERE n NOT IN (SELECT doc_id FROM labels WHERE toxic=1) GROUP BY 1,2"""))
_q("d9_list_blocks", lambda s, sf: M.list_blocks(counted_blocks(s, sf).select("block_id", "status", "wilson", "created_at"), "active", [F.desc("wilson"), F.asc("created_at")], 50, 20),
   S.with_(counted_sql(), select="SELECT block_id, status, round(wilson,6) AS wilson, created_at FROM cb WHERE status='active' ORDER BY cb.wilson DESC, created_at LIMIT 50 OFFSET 20"))
_q("d9_count_by_status", lambda s, sf: M.count_by_status(D.blocks(s, sf)), S.with_(S.BLOCKS, select="SELECT status, count(*) AS n FROM blk GROUP BY 1"))


def synced(s, sf):
    return M.sync_block_stats(counted_blocks(s, sf, "b", 2), D.event_log(s, sf))


_SY = [S.LOG, S.log_parts(), S.item_stats("block"), counted_sql("b", 2), f"""lu AS (SELECT block_id, max(ts) AS used_at FROM log WHERE event IN ('injection','agent_used') GROUP BY 1),
sy0 AS (SELECT cb.block_id, kind, status, created_at, verification_status, CASE WHEN s.block_id IS NOT NULL THEN retrieved ELSE times_retrieved END AS times_retrieved,
  CASE WHEN s.block_id IS NOT NULL THEN injected ELSE times_injected END AS times_injected, CASE WHEN s.block_id IS NOT NULL THEN agent_used ELSE times_agent_used END AS times_agent_used,
  CASE WHEN s.block_id IS NOT NULL THEN helpful ELSE times_helpful END AS times_helpful, CASE WHEN s.block_id IS NOT NULL THEN counterproductive ELSE times_counterproductive END AS times_counterproductive,
  coalesce(used_at, last_used_at) AS last_used_at, s.block_id IS NOT NULL AS synced FROM cb LEFT JOIN st_block s ON s.block_id=cb.block_id LEFT JOIN lu ON lu.block_id=cb.block_id),
sy AS (SELECT *, {S.wilson('times_helpful', 'times_injected')} AS wilson FROM sy0)"""]
_q("d10_sync_block_stats", synced, S.with_(*_SY, select="SELECT * REPLACE (round(wilson,6) AS wilson) FROM sy"))
_q("d10_orphan_event_blocks", lambda s, sf: M.orphan_event_blocks(counted_blocks(s, sf, "b", 2), D.event_log(s, sf)),
   S.with_(*_SY, select="SELECT block_id FROM st_block WHERE block_id NOT IN (SELECT block_id FROM cb)"))
_q("d11_demote_rules", lambda s, sf: M.demote_rules(synced(s, sf)), S.with_(*_SY, f"""d AS (SELECT block_id, CASE WHEN verification_status='disproved' THEN 'verification:disproved'
  WHEN times_injected<{V.DEMOTE_MIN_INJECTIONS} THEN NULL WHEN wilson<{V.DEMOTE_WILSON} THEN 'wilson-lb:'||format('{{:.3f}}', round(wilson,3))
  WHEN times_counterproductive/greatest(1,times_helpful)>={V.DEMOTE_COUNTER_RATIO} THEN 'counter-ratio:'||format('{{:.2f}}', round(times_counterproductive/greatest(1,times_helpful),2)) END AS reason FROM sy WHERE status='active')""",
  select="SELECT block_id, reason, CASE WHEN reason IS NOT NULL THEN 'demoted' ELSE 'active' END AS new_status FROM d"))

_DUP = """dk AS (SELECT block_id, len(keywords) AS nk, unnest(keywords) AS w FROM cb WHERE status='active'),
dp AS (SELECT a.block_id, b.block_id AS o, any_value(a.nk) AS an, any_value(b.nk) AS bn, count(*) AS c FROM dk a JOIN dk b ON a.w=b.w AND a.block_id<>b.block_id AND b.nk BETWEEN a.nk*0.75-1 AND a.nk/0.75+1 GROUP BY 1,2),
du AS (SELECT cb.block_id, count(dp.o) AS duplicate_hits FROM cb LEFT JOIN dp ON dp.block_id=cb.block_id AND c/(an+bn-c)>=0.75 WHERE status='active' GROUP BY 1)"""
_q("d13_near_duplicate_blocks", lambda s, sf: M.near_duplicate_blocks(counted_blocks(s, sf).where("status = 'active'")), S.with_(counted_sql(), _DUP, select="SELECT * FROM du"))

_H = V.HEALTH
_q("d12_memory_health", lambda s, sf: M.memory_health(counted_blocks(s, sf, "b"), D.event_log(s, sf), D.NOW_MS), S.with_(
    S.LOG, S.log_parts(), S.item_stats("block"), counted_sql("b"), _DUP, f"""h0 AS (SELECT cb.*, coalesce(s.injected,0) AS inj, coalesce(s.helpful,0) AS hf, coalesce(s.counterproductive,0) AS cp, coalesce(s.neutral,0) AS nt, duplicate_hits,
  coalesce(s.helpful,0)+coalesce(s.counterproductive,0)+coalesce(s.neutral,0) AS lt FROM cb LEFT JOIN st_block s ON s.block_id=cb.block_id JOIN du ON du.block_id=cb.block_id WHERE status='active'),
h1 AS (SELECT block_id, {S.wilson('hf', 'lt')} AS wl, CASE WHEN lt>0 THEN cp/lt ELSE 0.0 END AS counter_rate,
  least({_H['stale_max']}, greatest(0.0, greatest(0.0,({D.NOW_MS}-coalesce(last_used_at,created_at))/{V.DAY_MS})/{2 * _H['stale_half_life_days']}*{_H['stale_max']})) AS stale,
  least({_H['dup_max']}, duplicate_hits*{_H['dup_per_hit']}) AS duplication,
  CASE WHEN len(keywords)>=4 THEN 0.0 ELSE (4-len(keywords))/4*{_H['generic_max']} END AS generic,
  CASE WHEN lt<5 OR hf/lt>=0.1 THEN 0.0 ELSE (0.1-hf/lt)/0.1*{_H['roi_max']} END AS negative_roi, lt AS labeled_trials, greatest(0, inj-lt) AS pending_injected FROM h0),
h2 AS (SELECT *, wl-counter_rate-stale-duplication-generic-negative_roi AS health FROM h1),
h3 AS (SELECT *, CASE WHEN health>0 THEN '' ELSE array_to_string(list_filter([CASE WHEN labeled_trials>=5 AND wl<0.1 THEN 'low_wilson_lb' END, CASE WHEN labeled_trials>=5 AND counter_rate>=0.2 THEN 'high_counterproductive' END,
  CASE WHEN stale>={_H['stale_max'] * 0.5} THEN 'stale' END, CASE WHEN duplication>0 THEN 'duplicate' END, CASE WHEN generic>0 THEN 'generic' END, CASE WHEN labeled_trials>=5 AND negative_roi>0 THEN 'negative_roi' END], lambda x: x IS NOT NULL), ',') END AS reasons FROM h2)""", select="""
SELECT block_id, round(health,6) AS health, round(wl,6) AS wilson, round(counter_rate,6) AS counter_rate, round(stale,6) AS stale, round(duplication,6)::DOUBLE AS duplication, round(generic,6) AS generic,
  round(negative_roi,6) AS negative_roi, labeled_trials, pending_injected, reasons, reasons<>'' AS would_demote FROM h3"""))

_DOM = ("language", "framework")
_q("d14_domain_top", lambda s, sf: M.domain_top(counted_blocks(s, sf), _DOM).select("block_id", *_DOM, "wilson", "rank"), S.with_(counted_sql(), """
g AS (SELECT *, row_number() OVER (PARTITION BY language, framework ORDER BY wilson DESC, times_helpful DESC, block_id) AS rank FROM cb WHERE status='active' AND (language IS NOT NULL OR framework IS NOT NULL) AND (times_agent_used>0 OR wilson>0) QUALIFY rank<=7),
h AS (SELECT *, count(*) OVER (PARTITION BY language, framework) AS c FROM g)""", select="SELECT block_id, language, framework, round(wilson,6) AS wilson, rank FROM h WHERE c>=3"))


def _primer_sql():
    tr = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    flat = lambda c: tr(f"regexp_replace(coalesce({c},''), '\\s+', ' ', 'g')")
    text = lambda c: tr(f"coalesce({c},'')")
    lead = S.q("^([^.!?\\n]*[.!?]?)")
    first = lambda c: f"CASE WHEN regexp_matches({text(c)}, '^[.!?\\n]') THEN {text(c)} ELSE {tr(f"regexp_extract({text(c)}, {lead}, 1)")} END"
    cost = lambda c: f"ceil(length({c})/4)"
    fit = lambda c, t: f"CASE WHEN {cost(c)}<={t} THEN {c} ELSE regexp_replace(({c})[1:{t * 4 - 1}], '\\s+\\S*\\z', '')||'…' END"
    filled = lambda c: f"list_filter({c}, lambda x: x<>'')"
    words = "list_distinct(list_filter(regexp_split_to_array(lower(x), '[^a-z0-9]+'), lambda w: length(w)>=3))"
    same = "language IS NOT DISTINCT FROM b.language AND p.framework IS NOT DISTINCT FROM b.framework"
    part = lambda name: f"(SELECT list_transform(kept, lambda y: y.line) FROM picked p WHERE p.part='{name}' AND p.{same})"
    return S.recursive(counted_sql(), """g AS (SELECT *, string_split(mechanism, '. ') AS dead_ends, row_number() OVER (PARTITION BY language, framework ORDER BY wilson DESC, times_helpful DESC, block_id) AS rank FROM cb
  WHERE status='active' AND (language IS NOT NULL OR framework IS NOT NULL) AND (times_agent_used>0 OR wilson>0) QUALIFY rank<=7),
h AS (SELECT *, count(*) OVER (PARTITION BY language, framework) AS c FROM g)""", f"""
b AS (SELECT language, framework, count(*) AS patterns, list(block_id[1:8] ORDER BY rank) AS ids, {filled(f"list({first('mechanism')} ORDER BY rank)")} AS ms, {filled(f"list({flat('unlock')} ORDER BY rank)")} AS us,
  {filled(f"list({first('verification')} ORDER BY rank)")} AS vs, {filled(f"flatten(list(list_transform(dead_ends, lambda e: {flat('e')}) ORDER BY rank))")} AS ds FROM h WHERE c>=3 GROUP BY 1,2),
src AS (SELECT language, framework, 'm' AS part, ms AS lines FROM b UNION ALL SELECT language, framework, 'u', us FROM b UNION ALL SELECT language, framework, 'd', ds FROM b),
gr AS (SELECT language, framework, part, list_transform(lines, lambda x: {{'line': x, 'words': {words}}}) AS bags, []::STRUCT(line VARCHAR, words VARCHAR[])[] AS kept, 0 AS i FROM src UNION ALL
  SELECT language, framework, part, bags, CASE WHEN len(bags[i+1].words)=0 OR len(list_filter(kept, lambda y: {S.jac('y.words', 'bags[i+1].words')}>=0.6))>0 THEN kept ELSE list_append(kept, bags[i+1]) END, i+1
  FROM gr WHERE i<len(bags) AND (part<>'d' OR len(kept)<6)),
picked AS (SELECT language, framework, part, arg_max(kept, i) AS kept FROM gr GROUP BY 1,2,3),
parts AS (SELECT language, framework, patterns, 'Distilled from blocks: '||array_to_string(ids,', ')||'.' AS cited, {part('m')} AS m, {part('u')} AS u, {part('d')} AS d,
  CASE WHEN len(vs)=0 THEN {S.q(V.PRIMER_CHECK)} ELSE vs[-(list_reverse_sort(list_transform(range(1, len(vs)+1), lambda i: {{'n': len(list_filter(vs, lambda w: w=vs[i])), 'f': -i}})))[1].f] END AS v FROM b),
fitted AS (SELECT language, framework, patterns, d, {fit("array_to_string(list_concat([cited], m), ' ')", 240)} AS mechanism,
  {fit("array_to_string(list_transform(range(1, len(u)+1), lambda i: i||'. '||u[i]), chr(10))", 240)} AS unlock, {fit('v', 90)} AS verification FROM parts),
room AS (SELECT *, greatest(0, 600 - {cost('mechanism')} - {cost('unlock')} - {cost('verification')}) AS spare FROM fitted WHERE unlock<>''),
few AS (SELECT * REPLACE (list_filter(d, lambda x: {cost('x')}<=spare) AS d) FROM room)""", select=f"""
SELECT language, framework, patterns, mechanism, unlock, verification,
  array_to_string(list_transform(list_filter(range(1, len(d)+1), lambda i: list_sum(list_transform(d[1:i], lambda x: {cost('x')}))<=spare), lambda i: d[i]), ' | ') AS dead_ends FROM few""")


_q("d14_domain_primer", lambda s, sf: M.domain_primer(counted_blocks(s, sf), _DOM), _primer_sql())


def _redirects(s, sf):
    o = D.tool_obs(s, sf)
    r = o.select("session_id", F.concat(F.lit("b"), (F.col("event_id") % 3).cast("string")).alias("anchor_id"), "arg_key", "ts", "event_id")
    seen = o.where("ts < 1704300000000").select("session_id", F.lit("b0").alias("anchor_id"), "arg_key")
    return M.redirect_once(r.where("ts >= 1704300000000"), seen)


_q("d15_redirect_once", _redirects, S.with_(S.OBS, """r AS (SELECT session_id, 'b'||(event_id%3) AS anchor_id, arg_key, ts, event_id FROM obs WHERE ts>=1704300000000),
x AS (SELECT *, row_number() OVER (PARTITION BY session_id, anchor_id, arg_key ORDER BY ts, event_id)=1 AND NOT EXISTS (SELECT 1 FROM obs s WHERE s.ts<1704300000000 AND s.session_id=r.session_id AND s.arg_key=r.arg_key AND r.anchor_id='b0') AS shown FROM r)""",
  select="SELECT event_id, session_id, anchor_id, arg_key, shown, CASE WHEN NOT shown THEN 'anti-self-loop' END AS fallback_reason FROM x"))
_q("d16_store_stats", lambda s, sf: M.store_stats(D.traces(s, sf)), S.with_(S.TRACES, select="""
SELECT count(*) AS total, count(*) FILTER (outcome='success') AS success, count(*) FILTER (outcome='failure') AS failure, count(*) FILTER (outcome='partial') AS partial,
  round(avg(q_score),6) AS avg_quality, sum(recall_count)::BIGINT AS recalls, sum(helpful_count)::BIGINT AS helpful, min(created_at) AS oldest, max(created_at) AS newest FROM tr"""))
_q("d16_store_top", lambda s, sf: M.store_top(D.traces(s, sf)), S.with_(S.TRACES, """c AS (SELECT 'language' AS field, language AS value, count(*) AS n FROM tr WHERE language IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'framework', framework, count(*) FROM tr WHERE framework IS NOT NULL GROUP BY ALL UNION ALL SELECT 'error_type', error_type, count(*) FROM tr GROUP BY ALL)""",
  select="SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM c QUALIFY rank<=10"))


def _backlog(s, sf):
    v = D.table(s, sf, "embeddings").select((F.col("vec_id") * 2).alias("trace_id"))
    a = D.table(s, sf, "labels").select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 7).cast("int"))).alias("t")).select(F.col("doc_id").alias("trace_id"))
    return M.embedding_backlog(D.traces(s, sf), v, a)


_q("d17_embedding_backlog", _backlog, S.with_(S.TRACES, """b AS (SELECT t.trace_id, created_at, CASE WHEN l.doc_id IS NULL THEN 0 ELSE l.doc_id%7+1 END AS attempts FROM tr t LEFT JOIN labels l ON l.doc_id=t.trace_id
  WHERE t.trace_id NOT IN (SELECT vec_id*2 FROM embeddings))""", select="SELECT trace_id, created_at, attempts, (row_number() OVER (ORDER BY created_at, trace_id)-1)//32 AS batch_no FROM b WHERE attempts<5"))


def _ledger(s, sf):
    e = D.raw_events(s, sf)
    action = T.lookup(F.col("event_type"), {"signup": "created", "click": "used", "purchase": "retired", "view": "rollback"},
                      F.when(F.col("k") % 2 == 0, "deleted").otherwise("superseded"))
    return e.select(F.concat(F.lit("m"), F.col("user_id").cast("string"), F.lit("-"), (F.col("k") % 3).cast("string")).alias("memory_id"), F.col("event_id").alias("seq"), "ts",
                    action.alias("action"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("preview"))


_q("d18_memory_status", lambda s, sf: M.memory_status(_ledger(s, sf)), S.with_(S.RAW, """l AS (SELECT 'm'||user_id||'-'||(k%3) AS memory_id, event_id AS seq, ts,
  CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'used' WHEN 'purchase' THEN 'retired' WHEN 'view' THEN 'rollback' ELSE CASE WHEN k%2=0 THEN 'deleted' ELSE 'superseded' END END AS action, 'p'||event_id AS preview FROM raw),
la AS (SELECT memory_id, action AS last_action, count(*) OVER (PARTITION BY memory_id) AS actions FROM l QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY ts DESC, seq DESC)=1),
r2 AS (SELECT memory_id, action, row_number() OVER (PARTITION BY memory_id ORDER BY ts DESC, seq DESC) AS r FROM l WHERE action<>'rollback'),
cr AS (SELECT memory_id, preview, ts, seq FROM l WHERE action='created' QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY ts DESC, seq DESC)=1),
de AS (SELECT memory_id, ts, seq FROM l WHERE action='deleted' QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY ts DESC, seq DESC)=1),
s AS (SELECT la.*, (SELECT action FROM r2 WHERE r2.memory_id=la.memory_id AND r=CASE WHEN last_action='rollback' THEN 2 ELSE 1 END) AS a FROM la)""", select="""
SELECT s.memory_id, actions, last_action, CASE WHEN a IN ('retired','deleted','superseded') THEN a ELSE 'active' END AS status,
  CASE WHEN de.memory_id IS NULL OR (cr.ts, cr.seq) > (de.ts, de.seq) THEN cr.preview END AS preview FROM s LEFT JOIN cr USING (memory_id) LEFT JOIN de USING (memory_id)"""))
