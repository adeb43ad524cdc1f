"""Queries over sequences of calls and turns (G operators), evidence (E22, E23) and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlens import fixed_values as V
from memlens.operators import evidence as EV
from memlens.operators import postings as P
from memlens.operators import retrieval as R
from memlens.operators import sequences as Q
from memlens.plans import adapters as D
from memlens.plans import retrieval_queries as RQ
from memlens.plans import sqlbase as S
from memlens.plans import text_queries as TQ
from memlens.plans.catalog import Query, Registry, rounded
from memlens.session import cut

QUERIES: Registry = {}


def _q(key, run, sql=None):
    QUERIES[key] = Query(lambda spark, sf: rounded(run(spark, sf)), sql)


_q("g1_recent_calls", lambda s, sf: Q.recent_calls(D.tool_obs(s, sf)), S.with_(S.OBS, "l AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS r FROM obs QUALIFY r<=6)",
   select="SELECT event_id, ts, session_id, tool_name, arg_key, arg_summary, row_number() OVER (PARTITION BY session_id ORDER BY r DESC) AS position FROM l"))
_q("g1_observe_batch", lambda s, sf: Q.observe_batch(D.tool_obs(s, sf).select("session_id", F.floor(F.col("ts") / 604_800_000).alias("batch_id"), F.col("event_id").alias("batch_order"), "arg_key"), 8),
   S.with_(S.OBS, select="SELECT session_id, ts//604800000 AS batch_id, event_id AS batch_order, arg_key, row_number() OVER (PARTITION BY session_id, ts//604800000 ORDER BY event_id) AS kept_order FROM obs QUALIFY kept_order<=8"))


def signal_sql(name, src, n, key):
    """CTE ``name`` = src plus kind, count, tool over the last n rows."""
    return f"""{name}_w AS (SELECT *, list({key}) OVER w AS ks, list(tool_name) OVER w AS ts_, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id)-1 AS pos FROM {src} WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id ROWS {n - 1} PRECEDING)),
{name}_c AS (SELECT *, len(ks) AS n, list_reverse(ks) AS rk, list_max(list_transform(range(len(ks)), lambda i: [len(list_filter(ks, lambda y: y=ks[i+1])), i])) AS mx FROM {name}_w),
{name}_r AS (SELECT *, coalesce(list_position(list_transform(rk, lambda x: x=rk[1]), false)-1, n) AS run0 FROM {name}_c),
{name} AS (SELECT * EXCLUDE (run0), CASE WHEN run0=-1 THEN n ELSE run0 END AS run,
  CASE WHEN n<2 THEN 'none' WHEN (CASE WHEN run0=-1 THEN n ELSE run0 END)>=3 THEN 'straight' WHEN n>=4 AND rk[1]<>rk[2] AND rk[1]=rk[3] AND rk[2]=rk[4] THEN 'pingpong' WHEN mx[1]>=2 THEN 'duplicate' ELSE 'none' END AS kind FROM {name}_r)"""


_SIGCOLS = "kind, CASE kind WHEN 'straight' THEN run WHEN 'pingpong' THEN 2 WHEN 'duplicate' THEN mx[1] ELSE 0 END AS count, CASE kind WHEN 'straight' THEN ts_[-1] WHEN 'pingpong' THEN ts_[-1] WHEN 'duplicate' THEN ts_[mx[2]+1] END AS tool"
_q("g2_detect_loops", lambda s, sf: Q.detect_loops(D.tool_obs(s, sf)), S.with_(S.OBS, signal_sql("sg", "obs", 6, "arg_key"),
   select=f"SELECT event_id, session_id, ts, pos, tool_name, arg_key, {_SIGCOLS} FROM sg"))
_OBI = f"obi AS (SELECT *, {TQ.intent_sql('arg_summary', 'tool_name')} AS intent_key FROM obs)"
_q("g3_detect_semantic_loops", lambda s, sf: Q.detect_loops(_vague(s, sf), semantic=True), S.with_(S.OBS.replace("||(k%2)||'.ts)'", "||'-r.ts)'"), _OBI, signal_sql("sa", "obi", 6, "arg_key"), signal_sql("sb", "obi", 6, "intent_key"), f"""
a AS (SELECT event_id, session_id, ts, pos, tool_name, arg_key, {_SIGCOLS} FROM sa), b AS (SELECT event_id, {_SIGCOLS} FROM sb)""", select="""
SELECT a.event_id, session_id, ts, pos, tool_name, arg_key, CASE WHEN b.kind<>'none' THEN b.kind ELSE a.kind END AS kind, CASE WHEN b.kind<>'none' THEN b.count ELSE a.count END AS count,
  CASE WHEN b.kind<>'none' THEN b.tool ELSE a.tool END AS tool FROM a JOIN b USING (event_id)"""))


def _vague(s, sf):
    """Calls whose summaries drop what tells two argument keys of a tool apart."""
    o = D.tool_obs(s, sf)
    return o.withColumn("arg_summary", F.concat("tool_name", F.lit("(src/"), F.regexp_replace("arg_key", "[0-9]$", ""), F.lit("-r.ts)")))


def _decide(strict):
    safe = "family IN ('read','search')"
    already = "coalesce(fs<pos,false)"
    blocked = f"(coalesce(tp<pos,false) OR ({safe}{'' if strict else ' AND ' + already}))"
    return S.with_(S.OBS, _OBI, signal_sql("sg", "obi", 7, "arg_key"), f"""d0 AS (SELECT *, {S.FAMILY('tool_name')} AS family FROM sg),
wa AS (SELECT session_id, arg_key, min(pos) AS fs FROM d0 WHERE kind<>'none' GROUP BY 1,2),
th AS (SELECT session_id, intent_key, pos AS tp FROM d0 WHERE family='search' QUALIFY row_number() OVER (PARTITION BY session_id, intent_key ORDER BY pos)=3)""", select=f"""
SELECT event_id, d0.session_id, pos, tool_name, d0.arg_key, kind, CASE WHEN kind='none' THEN 'none' WHEN {blocked} THEN 'block' ELSE 'warn' END AS decision,
  CASE WHEN kind<>'none' THEN CASE WHEN {already} THEN 'suppressed' ELSE 'warned' END END AS logged FROM d0 LEFT JOIN wa USING (session_id, arg_key)
  LEFT JOIN th ON th.session_id=d0.session_id AND th.intent_key=d0.intent_key AND family='search'""")


_q("g4_pre_call_decisions", lambda s, sf: Q.pre_call_decisions(D.tool_obs(s, sf)), _decide(False))
_q("g4_pre_call_decisions_strict", lambda s, sf: Q.pre_call_decisions(D.tool_obs(s, sf), strict=True), _decide(True))


def _loops(s, sf):
    """Last signal of every session as a query; its text is the benchmark item the session number names."""
    d = Q.detect_loops(D.tool_obs(s, sf))
    last = cut(d.groupBy("session_id").agg(F.max_by(F.struct("kind", "arg_key"), "pos").alias("l")).select("session_id", "l.kind", "l.arg_key"))
    n = F.substring("session_id", 2, 20).cast("bigint")
    b = RQ.queries(s, sf).select(F.col("query_id").alias("item"), "text", "language", "framework", "apis")
    return last.withColumn("query_id", n).withColumn("item", n % 40).join(b, "item")


def _redirected(s, sf):
    l = _loops(s, sf).where("kind <> 'none'")
    blocks, paths = RQ.blocks(s, sf), RQ.files(s, sf)
    hits = R.asked_once(l, ["text", "language", "framework", "apis"], lambda q: R.block_recall(q, blocks, 3)).select("query_id", "block_id", (F.col("score") * (F.lit(0.5) + (F.col("query_id") % 2) * 0.5)).alias("prob"))
    files = R.asked_once(l.where("query_id % 5 <> 0"), ["text"], lambda q: R.file_recall(q, paths, 1))
    seen = l.where("query_id % 3 = 0").select("session_id", "arg_key").join(files.select(F.concat(F.lit("s"), F.col("query_id").cast("string")).alias("session_id"), F.col("file_id").cast("string").alias("anchor_id")), "session_id")
    return Q.loop_redirect(l, hits, files, seen)


_LOOP = [S.OBS, signal_sql("sg", "obs", 6, "arg_key"), RQ._QX, """ls AS (SELECT session_id, kind, arg_key FROM sg QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos DESC)=1),
lq AS (SELECT ls.*, ls.session_id[2:]::BIGINT AS query_id, text, language, framework, apis FROM ls JOIN qx ON qx.query_id = ls.session_id[2:]::BIGINT % 40),
lx AS (SELECT * FROM lq WHERE kind<>'none'), lf AS (SELECT * FROM lx WHERE query_id%5<>0)"""]
_q("g5_loop_redirect", _redirected, S.with_(*_LOOP, S.BLOCKS, RQ._BLOCKDOCS, RQ.bm25_sql("bm", "lx", "bd", {"text": 2, "kw": 1}, 3, V.SEARCH_STOP_WORDS, 1, RQ._KEEPB.replace("JOIN qx q", "JOIN lx q")),
   S.FILES, "ff AS (SELECT file_id AS doc_id, rel_path AS a, content AS b FROM fil)", RQ.bm25_sql("bf", "lf", "ff", {"a": 1, "b": 1}, 1, (), 1), f"""
bh AS (SELECT query_id, doc_id, round(bm25/max(bm25) OVER (PARTITION BY query_id),6)*(0.5+(query_id%2)*0.5) AS prob FROM bm),
b1 AS (SELECT query_id, doc_id AS block_id, prob FROM bh QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY prob DESC, doc_id DESC)=1),
j AS (SELECT lx.query_id, session_id, arg_key, CASE WHEN coalesce(prob>={V.REDIRECT_CONFIDENCE},false) THEN block_id ELSE bf.doc_id::VARCHAR END AS anchor,
   CASE WHEN coalesce(prob>={V.REDIRECT_CONFIDENCE},false) THEN 'block' WHEN bf.doc_id IS NOT NULL THEN 'file' END AS knd, prob, block_id FROM lx LEFT JOIN b1 USING (query_id) LEFT JOIN bf USING (query_id)),
r AS (SELECT *, CASE WHEN anchor IS NULL THEN CASE WHEN block_id IS NOT NULL THEN 'low-confidence' ELSE 'no-hit' END WHEN knd='file' AND query_id%3=0 THEN 'anti-self-loop' END AS reason FROM j)""", select="""
SELECT query_id, session_id, arg_key, CASE WHEN reason IS NULL THEN anchor END AS anchor_id, CASE WHEN reason IS NULL THEN knd END AS anchor_kind,
  round(CASE WHEN reason IS NULL THEN CASE WHEN knd='block' THEN prob ELSE 0.5 END END,6) AS confidence, reason AS fallback_reason FROM r"""))


def _drift(s, sf):
    win = Q.recent_calls(D.tool_obs(s, sf)).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "arg_summary"))), lambda x: x["arg_summary"]).alias("summaries"))
    l = _loops(s, sf)
    w = l.select("query_id", "session_id", F.col("kind").alias("signal")).join(win, "session_id").drop("session_id")
    return R.drift_augment(l.select("query_id", "text"), w)


_q("c18_drift_augment", _drift, S.with_(*_LOOP, """rc AS (SELECT session_id, arg_summary, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS r FROM obs QUALIFY r<=4),
fr AS (SELECT session_id, string_agg(arg_summary, ' ' ORDER BY r) AS f, count(*) AS n FROM rc GROUP BY 1)""", select=f"""
SELECT query_id, CASE WHEN kind<>'none' THEN trim(text)||' '||f ELSE text END AS text, CASE WHEN kind<>'none' THEN {V.DRIFT_GATE_THRESHOLD} ELSE {V.GATE_THRESHOLD} END::DOUBLE AS gate,
  CASE WHEN kind<>'none' THEN n ELSE 0 END AS fragments FROM lq JOIN fr USING (session_id)"""))


def _turns(s, sf):
    """Turns with one marker line, so that some chunks leak or carry an injection."""
    t = D.turns(s, sf)
    n = F.substring("session_id", 2, 20).cast("bigint") * 8 + F.col("turn")
    return t.withColumn("content", F.concat(D.marker(n), F.lit("\n"), "content"))


_MT = S.TURNS + ",\nmt AS (SELECT session_id, turn, role, (" + S.MARKED.split("SELECT *, ")[1].split(" AS m FROM")[0].replace("doc_id", "(session_id[2:]::BIGINT*8+turn)") + ")||chr(10)||content AS content FROM trn)"


def fold_sql(turn_limit, token_limit, min_tokens):
    leak, inj = S.first_rule("summary", V.LEAKAGE_EXTENDED), S.first_rule("summary", TQ._RE2_INJECTION)
    return [_MT, f"""tp AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn)-1 AS ix, ceil(length(content)/4)::BIGINT AS tokens FROM mt),
tr_ AS (SELECT *, list(tokens) OVER (PARTITION BY session_id ORDER BY ix ROWS BETWEEN CURRENT ROW AND {turn_limit - 1} FOLLOWING) AS run FROM tp),
ts_ AS (SELECT *, list_position(list_transform(range(1,len(run)+1), lambda i: list_sum(run[1:i])>={token_limit}), true) AS hit FROM tr_),
tz AS (SELECT *, CASE WHEN hit>0 THEN hit ELSE len(run) END AS size, coalesce(hit>0,false) OR len(run)={turn_limit} AS complete FROM ts_),
walk AS (SELECT session_id, 0::BIGINT AS start FROM (SELECT DISTINCT session_id FROM tz) UNION ALL
  SELECT w.session_id, (w.start+z.size)::BIGINT FROM walk w JOIN tz z ON z.session_id=w.session_id AND z.ix=w.start),
ck AS (SELECT w.session_id, w.start, z.size, z.complete FROM walk w JOIN tz z ON z.session_id=w.session_id AND z.ix=w.start),
cg AS (SELECT c.session_id, c.start, c.complete, min(turn) AS chunk_start, max(turn) AS chunk_end, sum(tokens)::BIGINT AS tokens_before, sha256(string_agg(role||':'||content, chr(10) ORDER BY ix)) AS turn_hash,
  arg_min({TQ._trim('content')}, ix) FILTER (role='user' AND {TQ._trim('content')}<>'') AS asked, arg_max({TQ._trim('content')}, ix) FILTER (role='assistant' AND {TQ._trim('content')}<>'') AS answered, arg_min({TQ._trim('content')}, ix) AS opening
  FROM ck c JOIN tp ON tp.session_id=c.session_id AND tp.ix>=c.start AND tp.ix<c.start+c.size GROUP BY 1,2,3),
cs AS (SELECT *, CASE WHEN asked IS NULL AND answered IS NULL THEN opening ELSE concat_ws(chr(10), 'User asked: '||asked, 'Assistant: '||answered) END AS s0 FROM cg),
ct AS (SELECT *, {TQ.clamp_sql('s0', V.FOLD_SUMMARY_CHARS)} AS summary FROM cs),
fold AS (SELECT session_id, chunk_start, chunk_end, turn_hash, summary, tokens_before, ceil(length(summary)/4)::BIGINT AS tokens_after, {D.NOW_MS + V.CHUNK_TTL_MS} AS expires_at,
  CASE WHEN NOT complete AND tokens_before<{min_tokens} THEN 'below-threshold' WHEN ({leak}) IS NOT NULL THEN 'leakage' WHEN ({inj}) IS NOT NULL THEN 'injection' END AS skip_reason FROM ct)"""]


def _with_recursive(*parts, select):
    return "WITH RECURSIVE " + S.with_(*parts, select=select)[5:]


_q("g6_fold_turns", lambda s, sf: Q.fold_turns(_turns(s, sf), D.NOW_MS, turn_limit=3, token_limit=300), _with_recursive(*fold_sql(3, 300, 50), select="SELECT * FROM fold"))
_q("g6_fold_turns_default", lambda s, sf: Q.fold_turns(_turns(s, sf), D.NOW_MS), _with_recursive(*fold_sql(8, 4000, 50), select="SELECT * FROM fold"))


def _chunk_roi(s, sf):
    """Chunks of a session as hits in turn order, those that save enough tokens by the plan."""
    plan = R.serving_plan("balanced")
    hits = Q.fold_turns(_turns(s, sf), D.NOW_MS, turn_limit=3, token_limit=300).where("skip_reason IS NULL").withColumns({"query_id": F.col("session_id"), "rank": F.col("chunk_start")})
    return R.roi_filter(hits, plan["min_chunk_net"], plan["chunks"], F.col("tokens_before") - F.col("tokens_after")).select("query_id", "chunk_start", "net_tokens", "rank")


_q("c23_roi_filter_chunks", _chunk_roi, _with_recursive(*fold_sql(3, 300, 50), select="""
SELECT session_id AS query_id, chunk_start, tokens_before-tokens_after AS net_tokens, row_number() OVER (PARTITION BY session_id ORDER BY chunk_start) AS rank FROM fold
WHERE skip_reason IS NULL AND tokens_before-tokens_after>=80 QUALIFY rank<=2"""))


def _appended(s, sf):
    stored = Q.fold_turns(_turns(s, sf), D.NOW_MS, turn_limit=2, token_limit=300).where("skip_reason IS NULL")
    return Q.append_chunks(stored, Q.fold_turns(_turns(s, sf), D.NOW_MS, turn_limit=3, token_limit=300))


def _two_folds():
    a = fold_sql(2, 300, 50)[1]
    for name in ("tp", "tr_", "ts_", "tz", "walk", "ck", "cg", "cs", "ct", "fold"):
        import re
        a = re.sub(rf"\b{name}\b", f"{name}x", a)
    return [*fold_sql(3, 300, 50), a]


_APP = [*_two_folds(), """fre AS (SELECT session_id, turn_hash, min(chunk_start) AS chunk_start, min(chunk_end) AS chunk_end FROM fold WHERE skip_reason IS NULL
  AND (session_id, turn_hash) NOT IN (SELECT session_id, turn_hash FROM foldx WHERE skip_reason IS NULL) GROUP BY 1,2)"""]
_q("g7_append_chunks", lambda s, sf: _appended(s, sf)[0], _with_recursive(*_APP, select="SELECT * FROM fre"))
_q("g7_watermarks", lambda s, sf: _appended(s, sf)[1], _with_recursive(*_APP, select="""
SELECT session_id, max(chunk_end) AS watermark FROM (SELECT session_id, chunk_end FROM foldx WHERE skip_reason IS NULL UNION ALL SELECT session_id, chunk_end FROM fre) GROUP BY 1"""))


def _talk(s, sf):
    """Turns where every line of an assistant becomes a heading or a bullet by its number."""
    t = D.turns(s, sf)
    said = F.array_join(F.transform(F.split("content", "\n"), lambda l, i: F.concat(F.when(i % 4 == 0, "## ").when(i % 4 == 3, "").otherwise("- "), l)), "\n")
    return t.withColumn("content", F.when(F.col("role") == "assistant", said).otherwise(F.col("content")))


_q("g8_session_digest", lambda s, sf: Q.session_digest(_talk(s, sf)), S.with_(S.TURNS, f"""
ul AS (SELECT session_id, turn, 0 AS ix, 'user' AS kind, trim(string_split({TQ._trim('content')},chr(10))[1]) AS line FROM trn WHERE role='user' AND NOT {S.rx(TQ._trim('content'), V.TRANSCRIPT_META)}),
al AS (SELECT session_id, turn, unnest(list_transform(string_split(content,chr(10)), lambda l, i: CASE (i-1)%4 WHEN 0 THEN '## ' WHEN 3 THEN '' ELSE '- ' END || l)) AS raw, unnest(range(len(string_split(content,chr(10))))) AS ix FROM trn WHERE role='assistant'),
sl AS (SELECT session_id, turn, ix, {TQ._trim('raw')} AS line FROM al),
sb AS (SELECT *, lag(line) OVER (PARTITION BY session_id, turn ORDER BY ix) AS before FROM sl),
hd AS (SELECT session_id, turn, ix, 'head' AS kind, trim(regexp_extract(line, '^#{{1,4}}\\s+(.+?)\\s*$', 1)) AS line FROM sl),
bl AS (SELECT session_id, turn, ix, 'bullet' AS kind, trim(regexp_extract(line, '^[-*•]\\s+(.+)$', 1)) AS line FROM sb WHERE regexp_matches(line, '^[-*•]\\s+.+$') AND NOT coalesce(regexp_matches(before, '^[-*•]\\s+.+$'),false)),
al2 AS (SELECT * FROM ul WHERE length(line) BETWEEN 12 AND 200 UNION ALL SELECT * FROM hd WHERE length(line) BETWEEN 4 AND 120 UNION ALL SELECT * FROM bl WHERE length(line) BETWEEN 10 AND 180 AND NOT (starts_with(line,'`') AND ends_with(line,'`'))),
kp AS (SELECT * FROM al2 QUALIFY row_number() OVER (PARTITION BY session_id, kind ORDER BY turn DESC, ix DESC) <= CASE kind WHEN 'user' THEN 5 WHEN 'head' THEN 4 ELSE 6 END),
dg AS (SELECT session_id, concat_ws(chr(10)||chr(10), 'Recent user questions:'||chr(10)||string_agg('- '||line, chr(10) ORDER BY turn, ix) FILTER (kind='user'),
  'Discussion topics:'||chr(10)||string_agg('- '||line, chr(10) ORDER BY turn, ix) FILTER (kind='head'), 'Key points:'||chr(10)||string_agg('- '||line, chr(10) ORDER BY turn, ix) FILTER (kind='bullet')) AS d FROM kp GROUP BY 1),
db AS (SELECT session_id, CASE WHEN length(d)>{V.DIGEST_MAX_CHARS} THEN d[1:{V.DIGEST_MAX_CHARS - 1}]||'…' ELSE d END AS b FROM dg)""", select=f"""
SELECT session_id, CASE WHEN length(b)>=40 AND ({S.first_rule('b', V.LEAKAGE_EXTENDED)}) IS NULL THEN b END AS digest FROM db"""))
_q("g9_reuse_window", lambda s, sf: Q.reuse_window(D.tool_obs(s, sf)), S.with_(S.OBS, f"l AS (SELECT * FROM obs ORDER BY ts DESC, event_id DESC LIMIT {V.REUSE_CACHE_ROWS})", f"""
li AS (SELECT *, {TQ.intent_sql('arg_summary', 'tool_name')} AS intent FROM l)""", select="SELECT session_id, intent, count(*) AS n, max(ts) AS last_ts FROM li GROUP BY 1,2"))


# --- evidence -----------------------------------------------------------------------------------

def _shown(s, sf):
    """Injections name a document by event number; a transcript is a later purchase quoting a document."""
    e = D.raw_events(s, sf)
    n = D.documents(s, sf).agg(F.count("*").alias("n")).select("n").scalar()
    inj = e.where("event_type IN ('click','view')").select(F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("query_id"), F.concat(F.lit("d"), (F.col("k") % n).cast("string")).alias("block_id"),
                                                          F.concat(F.lit("r"), (F.col("user_id") % 10).cast("string")).alias("run_id"), "ts")
    shadow = e.select(F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("query_id"), (F.col("event_id") % 4 == 0).alias("shadow"))
    docs = D.blocks(s, sf).select("block_id", "unlock", "verification")
    tr = (e.where("event_type = 'purchase'").select(F.col("event_id").alias("transcript_id"), F.concat(F.lit("r"), (F.col("user_id") % 10).cast("string")).alias("run_id"), "ts",
                                                    F.concat(F.lit("d"), (F.col("k") % n).cast("string")).alias("block_id"))
          .join(docs, "block_id").select("transcript_id", "run_id", "ts", F.concat_ws("\n", "unlock", "verification", F.lit("tests passed and it is fixed")).alias("text")))
    return inj, shadow, tr, docs


def _uses(s, sf):
    inj, shadow, tr, docs = _shown(s, sf)
    return EV.infer_use(inj, shadow, tr, docs, lookback_ms=7_200_000)


_EVS = [S.RAW, S.BLOCKS, f"""nd AS (SELECT count(*) AS n FROM documents),
ij AS (SELECT 'q'||event_id AS query_id, 'd'||(k%n) AS block_id, 'r'||(user_id%10) AS run_id, ts FROM raw, nd WHERE event_type IN ('click','view') AND event_id%4<>0),
bt AS (SELECT block_id, concat_ws(chr(10), unlock, verification) AS body, {S.split_set("concat_ws(chr(10), unlock, verification)", '[^a-z0-9_-]+', 3)} AS bt FROM blk),
tx AS (SELECT event_id AS transcript_id, 'r'||(user_id%10) AS run_id, ts, body||chr(10)||'tests passed and it is fixed' AS text FROM raw, nd, bt WHERE event_type='purchase' AND bt.block_id='d'||(k%n)),
tt AS (SELECT *, {S.split_set('text', '[^a-z0-9_-]+', 3)} AS tt FROM tx),
nr AS (SELECT transcript_id, query_id, block_id, min(i.ts) AS injection_ts, any_value(tt) AS tt FROM ij i JOIN tt t ON t.run_id=i.run_id AND i.ts<=t.ts AND i.ts>t.ts-7200000 GROUP BY 1,2,3),
us AS (SELECT transcript_id, query_id, block_id, injection_ts, {S.jac('bt', 'tt')} AS score FROM nr JOIN bt USING (block_id) WHERE {S.jac('bt', 'tt')}>={V.MODERATE_JACCARD})"""]
_q("e22_infer_use", _uses, S.with_(*_EVS, select="SELECT transcript_id, query_id, block_id, injection_ts, round(score,6) AS score FROM us"))


def _inferred(s, sf):
    inj, shadow, tr, docs = _shown(s, sf)
    outs = D.raw_events(s, sf).where("event_id % 6 = 1").select(F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("query_id"))
    return EV.infer_outcomes(inj, shadow, tr, docs, outs, lookback_ms=7_200_000)


_q("e22_inferred_outcomes", _inferred, S.with_(*_EVS, select=f"""
SELECT DISTINCT query_id, true AS resolved, 'inferred' AS attribution FROM us JOIN tx USING (transcript_id) WHERE length({TQ._flat('text')})>=40 AND NOT {S.rx(TQ._flat('text'), V.RESOLVED_NEGATIVE)}
  AND {S.rx(TQ._flat('text'), V.RESOLVED_POSITIVE)} AND query_id[2:]::BIGINT%6<>1"""))


def _touched(s, sf):
    p = RQ.files(s, sf)
    edits = p.select(F.concat(F.lit("q"), (F.col("file_id") % 20).cast("string")).alias("query_id"), F.concat(F.lit(" "), F.upper("rel_path")).alias("path"))
    rec = p.select(F.concat(F.lit("q"), (F.col("file_id") % 30).cast("string")).alias("query_id"), F.col("file_id").alias("item_id"), F.replace("rel_path", F.lit("/"), F.lit("\\")).alias("path"))
    return EV.touched_recalled(edits, rec)


_q("e23_touched_recalled", _touched, S.with_(S.FILES, select="""
SELECT 'q'||(file_id%30) AS query_id, file_id AS item_id, 'diff_touches_recalled_file' AS kind FROM fil WHERE EXISTS (SELECT 1 FROM fil e WHERE lower(e.rel_path)=lower(fil.rel_path) AND e.file_id%20=fil.file_id%30)"""))


def _argmatch(s, sf):
    q = RQ.queries(s, sf).select("query_id", "text")
    calls = q.select("query_id", F.col("text").alias("arg_summary"))
    slate = RQ._slate(s, sf)
    found = P.few(cut(slate.select(F.col("item_id").alias("doc_id")).distinct()))  # lines are taken of recalled texts only
    texts = cut(D.blocks_of(D.documents(s, sf).join(found, "doc_id", "left_semi")).select(F.col("n").alias("item_id"), "unlock", "verification"))
    return EV.args_match_memory(calls, slate.join(texts, "item_id").select("query_id", "item_id", "unlock", "verification"))


_q("e23_args_match_memory", _argmatch, S.with_(*RQ._SL, S.BLOCKS, """a AS (SELECT query_id, lower(text) AS arg FROM qry WHERE length(text)>=6),
g AS (SELECT query_id, unnest(list_transform(range(1,length(arg)-4), lambda i: arg[i:i+5])) AS g FROM a)""", select="""
SELECT DISTINCT s.query_id, s.doc_id AS item_id, 'tool_path_matches_memory' AS kind FROM sl s JOIN blk ON n=s.doc_id JOIN g ON g.query_id=s.query_id AND contains(lower(concat_ws(chr(10), unlock, verification)), g.g)"""))


def _followed(s, sf):
    o = D.tool_obs(s, sf).withColumn("ok", F.col("event_id") % 2 == 0)
    loops = Q.detect_loops(D.tool_obs(s, sf)).where("kind <> 'none'").select("event_id", F.lit("b1").alias("anchor_id"))
    return EV.redirect_followed(o, loops)


_q("e23_redirect_followed", _followed, S.with_(S.OBS, signal_sql("sg", "obs", 6, "arg_key"), """
n AS (SELECT *, lead(tool_name) OVER w AS nt, lead(arg_key) OVER w AS nk, lead(event_id) OVER w AS ne FROM sg WINDOW w AS (PARTITION BY session_id ORDER BY pos))""", select="""
SELECT event_id, session_id, 'b1' AS anchor_id, 'loop_redirect_followed' AS kind, ne%2=0 AS success FROM n WHERE kind<>'none' AND ne IS NOT NULL AND (nt<>tool_name OR nk<>arg_key)"""))
