"""Queries over sources and sinks (A operators, E32)."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlens import fixed_values as V
from memlens.operators import analytics as A
from memlens.plans import adapters as D
from memlens.plans import sqlbase as S
from memlens.plans.catalog import Query, Registry, rounded
from memlens.sources import events as EVT
from memlens.sources import files as FL
from memlens.sources import traces as TR
from memlens.sources import transcripts as TX

QUERIES: Registry = {}


def _q(key, run, sql=None):
    QUERIES[key] = Query(lambda spark, sf: rounded(run(spark, sf)), sql)


_q("a1_read_events", lambda s, sf: EVT.read_events(D.event_log(s, sf), after=1_704_300_000_000, before=1_706_000_000_000, types=("injection", "outcome"), limit=1000).select("event_id", "ts", "event", "query_id", "block_id"),
   S.with_(S.LOG, select="SELECT event_id, ts, event, query_id, block_id FROM log WHERE ts>1704300000000 AND ts<1706000000000 AND event IN ('injection','outcome') ORDER BY ts, event_id LIMIT 1000"))

# JSON lines of every event; how a line is spoilt depends on k.
_TS = "CASE WHEN k%8=2 THEN '\"' || ts || '\"' ELSE '' || ts END"
_LINE = f"""concat('{{"ts":', {_TS}, ',"queryId":"', CASE WHEN k%8=3 THEN '' ELSE 'q' || user_id END, '","event":"', CASE WHEN k%8=4 THEN 'mystery' ELSE event_name END, '"', CASE WHEN k%8=6 THEN ',"runId":5' ELSE '' END,
 CASE event_name WHEN 'retrieval' THEN concat(',"shadow":', CASE WHEN k%8=5 THEN '1' ELSE 'false' END, ',"candidates":[{{"blockId":"b', k%5, '","score":0.5}},{{"blockId":"', CASE WHEN k%16=7 THEN '' ELSE 'c' END, '","score":1}}]')
  WHEN 'injection' THEN concat(',"blockId":"b', k%5, '","score":', CASE WHEN k%8=5 THEN '"x"' ELSE '0.25' END)
  WHEN 'agent_used' THEN concat(',"blockId":"b', k%5, '","matchSignal":"', CASE WHEN k%8=5 THEN 'guess' ELSE 'jaccard' END, '","matchScore":0.5')
  WHEN 'outcome' THEN concat(',"resolved":true,"tokens":', k, CASE WHEN k%8=5 THEN '' ELSE ',"control":false' END)
  ELSE concat(',"factId":"', CASE WHEN k%8=5 THEN '' ELSE 'f1' END, '","score":1') END, CASE WHEN k%8=1 THEN '' ELSE '}}' END)"""
_NAME = "CASE event_type WHEN 'view' THEN 'retrieval' WHEN 'click' THEN 'injection' WHEN 'signup' THEN 'agent_used' WHEN 'purchase' THEN 'outcome' ELSE 'fact_injection' END"


def event_lines(s, sf):
    e = D.raw_events(s, sf).withColumn("event_name", F.expr(_NAME))
    return e.select(F.col("event_id").alias("line_id"), F.expr(_LINE.replace("'' || ts", "cast(ts as string)").replace("'\"' || ts || '\"'", "concat('\"', ts, '\"')").replace("'q' || user_id", "concat('q', user_id)")).alias("line"))


_LN = S.RAW + f""",
rn AS (SELECT *, {_NAME} AS event_name FROM raw), ln AS (SELECT event_id AS line_id, k, {_LINE} AS line FROM rn)"""
_jt = lambda f: f"json_type(j, '$.{f}')"
_num = lambda f: f"coalesce({_jt(f)} IN ('BIGINT','UBIGINT','DOUBLE'),false)"
_txt = lambda f: f"coalesce({_jt(f)}='VARCHAR' AND json_extract_string(j,'$.{f}')<>'',false)"
_boo = lambda f: f"coalesce({_jt(f)}='BOOLEAN',false)"
_VALID = f"""{_num('ts')} AND {_txt('queryId')} AND ({_jt('runId')} IS NULL OR {_jt('runId')}='VARCHAR') AND CASE json_extract_string(j,'$.event')
  WHEN 'retrieval' THEN {_boo('shadow')} AND {_jt('candidates')}='ARRAY' AND {_txt('candidates[0].blockId')} AND {_txt('candidates[1].blockId')}
  WHEN 'injection' THEN {_txt('blockId')} AND {_num('score')} WHEN 'fact_injection' THEN {_txt('factId')} AND {_num('score')}
  WHEN 'agent_used' THEN {_txt('blockId')} AND json_extract_string(j,'$.matchSignal') IN ('jaccard','embedding','explicit') AND {_num('matchScore')}
  WHEN 'outcome' THEN {_boo('resolved')} AND {_boo('control')} AND {_num('tokens')} ELSE false END"""
_q("a2_import_events_jsonl", lambda s, sf: EVT.parse_event_lines(event_lines(s, sf)).select("line_id", "status"), S.with_(_LN, f"""
lj AS (SELECT line_id, CASE WHEN json_valid(line) THEN line END AS j FROM ln)""", select=f"SELECT line_id, CASE WHEN j IS NULL THEN 'bad-json' WHEN {_VALID} THEN 'good' ELSE 'invalid' END AS status FROM lj"))
_q("a4_normalize_events", lambda s, sf: EVT.normalize_events(EVT.parse_event_lines(event_lines(s, sf)).where("status = 'good'").select(
    F.col("line_id").alias("event_id"), F.col("line").alias("payload"), F.concat(F.lit("r"), F.col("line_id").cast("string")).alias("run_id"))), S.with_(_LN, f"""
lj AS (SELECT line_id, k, CASE WHEN json_valid(line) THEN line END AS j FROM ln), g AS (SELECT *, json_extract_string(j,'$.event') AS event FROM lj WHERE j IS NOT NULL AND {_VALID})""", select="""
SELECT line_id AS event_id, json_extract_string(j,'$.ts')::BIGINT AS ts, event, json_extract_string(j,'$.queryId') AS query_id, 'r'||line_id AS run_id,
  CASE WHEN event IN ('injection','agent_used') THEN json_extract_string(j,'$.blockId') END AS block_id, CASE WHEN event='fact_injection' THEN json_extract_string(j,'$.factId') END AS fact_id,
  CASE WHEN event IN ('retrieval','outcome') THEN false END AS shadow, json_extract_string(j,'$.score')::DOUBLE AS score, json_extract_string(j,'$.resolved')::BOOLEAN AS resolved,
  json_extract_string(j,'$.tokens')::DOUBLE AS tokens FROM g"""))


def _import(s, sf):
    stored = D.table(s, sf, "labels").select(F.col("doc_id").alias("trace_id"))
    new = D.documents(s, sf).select((F.col("doc_id") - F.col("doc_id") % 3).alias("trace_id"), F.col("doc_id").alias("seq"), (F.lit(10_000) - F.col("doc_id") % 5).alias("created_at"), F.col("text").alias("description"))
    return TR.import_traces(new, stored)


_q("a3_import_traces", _import, """
SELECT doc_id-doc_id%3 AS trace_id, doc_id AS seq, 10000-doc_id%5 AS created_at, text AS description FROM documents WHERE doc_id-doc_id%3 NOT IN (SELECT doc_id FROM labels)
QUALIFY row_number() OVER (PARTITION BY doc_id-doc_id%3 ORDER BY 10000-doc_id%5, doc_id)=1""")


def _lines(s, sf):
    """Transcript lines: plain user text, assistant parts (one per text line plus a tool part), some broken or meta."""
    t = D.turns(s, sf)
    body = F.when(F.col("turn") % 4 == 2, F.concat(F.lit("<system-reminder> "), "content")).otherwise(F.col("content"))
    user = F.to_json(F.struct(F.lit("user").alias("type"), F.struct(F.lit("user").alias("role"), body.alias("content")).alias("message")))
    part = lambda x: F.struct(F.lit("text").alias("type"), x.alias("text"))
    parts = F.concat(F.transform(F.split("content", "\n"), part), F.array(F.struct(F.lit("tool_use").alias("type"), F.lit("ls").alias("text")), part(F.lit("  "))))
    said = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.lit("assistant").alias("role"), parts.alias("content")).alias("message")))
    line = F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", said).otherwise(F.concat(F.lit("{"), "content"))
    return t.select("session_id", F.col("turn").alias("line_no"), line.alias("line"))


_tr = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_q("a5_parse_transcripts", lambda s, sf: TX.parse_transcripts(_lines(s, sf)), S.with_(S.TURNS, select=f"""
SELECT session_id, turn AS line_no, role, {_tr('content')} AS content FROM trn WHERE role='user' AND turn%4<>2 AND {_tr('content')}<>'' UNION ALL
SELECT session_id, turn, role, {_tr(f"array_to_string(list_filter(string_split(content,chr(10)), lambda x: {_tr('x')}<>''), chr(10))")} FROM trn WHERE role='assistant' AND {_tr('content')}<>''"""))


def scanned(s, sf):
    f = D.files(s, sf).withColumn("size_bytes", F.octet_length("content").cast("bigint"))
    return FL.scan_files(f.select("file_id", "rel_path", "content", "size_bytes"), max_bytes=9000, max_files=80, byte_budget=220_000)


_SFX = "(" + "|".join(x.replace(".", "\\.") for x in V.EXCLUDED_SUFFIXES) + ")$"
_SCAN = f"""sc0 AS (SELECT file_id, rel_path, content, strlen(content)::BIGINT AS size_bytes,
  CASE WHEN {" OR ".join(f"list_contains(string_split(rel_path,'/')[1:-2], {S.q(d)})" for d in V.EXCLUDED_DIRS)} THEN 'excluded-dir' WHEN starts_with(rel_path,'../') THEN 'out-of-repo'
   WHEN regexp_matches(lower(string_split(rel_path,'/')[-1]), {S.q(_SFX)}) THEN 'excluded-suffix' WHEN strlen(content)>9000 THEN 'too-large' WHEN contains(content[1:8192], chr(0)) THEN 'binary' END AS reason FROM fil),
sc1 AS (SELECT file_id, NULL AS reason, size_bytes, CASE WHEN sum(size_bytes) OVER (ORDER BY rel_path)<=220000 AND row_number() OVER (ORDER BY rel_path)<=80 THEN 'kept' ELSE 'pending' END AS state FROM sc0 WHERE reason IS NULL),
sc AS (SELECT * FROM sc1 UNION ALL SELECT file_id, reason, size_bytes, 'skipped' FROM sc0 WHERE reason IS NOT NULL)"""
_q("a6_scan_files", lambda s, sf: scanned(s, sf).select("file_id", "reason", "size_bytes", "state"), S.with_(S.FILES, _SCAN, select="SELECT * FROM sc"))
_q("e32_index_coverage", lambda s, sf: A.index_coverage(scanned(s, sf)), S.with_(S.FILES, _SCAN, select="SELECT state, coalesce(reason,'-') AS reason, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM sc GROUP BY 1,2"))


def _index(s, sf):
    f = D.files(s, sf)
    i = F.col("file_id")
    text = F.concat(F.col("content"), F.when(i % 5 == 2, D.marker(i)).otherwise(F.lit("")))
    now = f.where(i % 6 != 5).select("rel_path", text.alias("content"), F.col("rel_path").alias("summary"), text.alias("symbols"))
    old = f.where(i % 4 != 0).select("rel_path", F.when(i % 4 == 1, F.sha2(text, 256)).otherwise(F.lit("old")).alias("hash"))
    return FL.index_files(now, old)


_IDX = S.MARKED.replace("FROM documents", "FROM (SELECT *, page_id AS doc_id, html AS text, '' AS lang, '' AS source, 0 AS n_chars FROM pages)")
_RE2 = [(n, r"(?i)(^|[^`])<\s*/?\s*(system|user|assistant)\s*>([^`]|$)" if n == "system-spoof" else p) for n, p in V.PROMPT_INJECTION]
_q("a7_index_files", _index, S.with_(S.FILES, _IDX, f"""
fx AS (SELECT file_id, rel_path, content || CASE WHEN file_id%5=2 THEN m ELSE '' END AS text FROM fil JOIN md0 ON md0.doc_id=fil.file_id),
nw AS (SELECT rel_path, sha256(text) AS nh, rel_path||chr(10)||text AS c FROM fx WHERE file_id%6<>5),
od AS (SELECT rel_path, CASE WHEN file_id%4=1 THEN sha256(text) ELSE 'old' END AS oh FROM fx WHERE file_id%4<>0),
a AS (SELECT coalesce(nw.rel_path,od.rel_path) AS rel_path, nh, oh, CASE WHEN nh IS NULL THEN 'missing' WHEN nh=oh THEN 'no-op' WHEN ({S.first_rule('c', V.LEAKAGE_EXTENDED)}) IS NOT NULL THEN 'leakage'
   WHEN ({S.first_rule('c', _RE2)}) IS NOT NULL THEN 'injection' WHEN oh IS NOT NULL THEN 'updated' ELSE 'indexed' END AS action FROM nw FULL JOIN od ON nw.rel_path=od.rel_path)""",
  select="SELECT rel_path, action, CASE WHEN action IN ('updated','indexed') THEN nh ELSE oh END AS hash FROM a"))

ALLOWED = {"installation": True, "metrics": {"counts": {"chars": True}, "lang": True, "text": {"x": True}}, "parts": {"n": True}, "missing": True}


def _nested(s, sf):
    """Documents as nested samples with text and paths that must not leave."""
    d = D.documents(s, sf)
    return d.select(
        F.col("doc_id").alias("installation"), F.col("text").alias("secret"),
        F.struct(F.struct(F.col("n_chars").alias("chars"), F.col("text").alias("raw")).alias("counts"), F.col("lang").alias("lang"), F.col("text").alias("text")).alias("metrics"),
        F.array(F.struct(F.col("n_chars").alias("n"), F.col("source").alias("path")), F.struct(F.lit(1).cast("bigint").alias("n"), F.lit("p").alias("path"))).alias("parts"))


_q("a9_export_allowlisted", lambda s, sf: TR.export_allowlisted(_nested(s, sf), ALLOWED).select(F.to_json(F.struct("*")).alias("sample")), """
SELECT '{"installation":'||doc_id||',"metrics":{"counts":{"chars":'||n_chars||'},"lang":"'||lang||'"},"parts":[{"n":'||n_chars||'},{"n":1}]}' AS sample FROM documents""")
