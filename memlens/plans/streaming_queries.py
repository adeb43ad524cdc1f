"""Streaming jobs run to the end of the given tables; their rows must equal the batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlens import fixed_values as V
from memlens.operators import usage as U
from memlens.operators import maintenance as M
from memlens.operators import postings as P
from memlens.operators import retrieval as R
from memlens.plans import adapters as D
from memlens.plans import event_queries as EQ
from memlens.plans import maintenance_queries as MQ
from memlens.plans import retrieval_queries as RQ
from memlens.plans import sequence_queries as SQ
from memlens.plans import sqlbase as S
from memlens.plans.catalog import Query, Registry, rounded
from memlens.streaming import jobs as J
from memlens.streaming import loops as LP

QUERIES: Registry = {}


def _q(key, run, sql=None):
    QUERIES[key] = Query(lambda spark, sf: rounded(run(spark, sf)), sql)


def _events(s, sf):
    return D.raw_events_of(J.parquet_stream(s, sf, "events.parquet"))


def _ingest(s, sf):
    """The event stream with every row sent twice; each id arrives once."""
    w = J.workspace(s, "ingest")
    twice = D.event_log_of(_events(s, sf)).withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    J.run_available(J.ingest_events(twice, f"{w}/out", f"{w}/checkpoint", delay="60 days"))
    return s.read.parquet(f"{w}/out").select("event_id", "ts", "event", "query_id", "block_id", "fact_id", "score", "shadow", "resolved")


_q("g10_streaming_ingest", _ingest, S.with_(S.LOG, select="SELECT event_id, ts, event, query_id, block_id, fact_id, round(score,6) AS score, shadow, resolved FROM log"))


def _ingest_lines(s, sf):
    """JSON lines in four files, each line twice, some cut short and some without a type; good ones and the quarantine."""
    w = J.workspace(s, "lines")
    n = F.col("line_id") % 50
    line = F.when(n == 7, F.expr("substring(line, 1, int(length(line) / 2))")).when(n == 9, F.replace("line", F.lit('"event":'), F.lit('"evnt":'))).otherwise(F.col("line"))
    lines = EQ.event_lines(s, sf).withColumn("line", line).withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    lines.repartitionByRange(4, "line_id").write.parquet(f"{w}/in")
    stream = J.parquet_stream(s, f"{w}/in", files_per_trigger=1)
    J.run_available(J.ingest_lines(stream, f"{w}/out", f"{w}/quarantine", f"{w}/checkpoint", delay_ms=60 * V.DAY_MS))
    good = s.read.parquet(f"{w}/out").select("event_id", F.lit("good").alias("status"), "event", "ts", "query_id", "resolved")
    return good.unionByName(s.read.parquet(f"{w}/quarantine").select(F.col("line_id").alias("event_id"), "status"), allowMissingColumns=True)


_q("g10_streaming_lines", _ingest_lines, S.with_(S.LOG, "m AS (SELECT *, CASE event_id%50 WHEN 7 THEN 'bad-json' WHEN 9 THEN 'invalid' ELSE 'good' END AS status FROM log)", select="""
SELECT event_id, status, CASE WHEN status='good' THEN event END AS event, CASE WHEN status='good' THEN ts END AS ts, CASE WHEN status='good' THEN query_id END AS query_id, CASE WHEN status='good' THEN resolved END AS resolved FROM m"""))


def _loops(s, sf):
    w = J.workspace(s, "loops")
    J.run_available(LP.loops_to_parquet(D.tool_obs_of(_events(s, sf)), f"{w}/out", f"{w}/checkpoint"))
    return s.read.parquet(f"{w}/out")


_q("g11_streaming_loops", _loops, S.with_(S.OBS, SQ.signal_sql("sg", "obs", 6, "arg_key"), f"""
d AS (SELECT event_id, session_id, ts, pos, tool_name, arg_key, {SQ._SIGCOLS} FROM sg),
wa AS (SELECT session_id, arg_key, min(pos) AS fs FROM d WHERE kind<>'none' GROUP BY 1,2)""", select="""
SELECT d.*, CASE WHEN kind<>'none' THEN CASE WHEN fs<pos THEN 'suppressed' ELSE 'warned' END END AS logged FROM d LEFT JOIN wa USING (session_id, arg_key)"""))


def _usage(s, sf):
    w = J.workspace(s, "usage")
    J.run_available(J.usage_by_day(D.event_log_of(_events(s, sf)), f"{w}/store", f"{w}/out", f"{w}/checkpoint", delay="60 days"))
    return s.read.parquet(f"{w}/out").withColumn("day", F.col("day").cast("string")).select("day", *U.USAGE_COLS)


_q("g12_streaming_usage", _usage, EQ.QUERIES["a8_daily_usage_windows"].sql)


def _upsert(s, sf):
    """Documents stream in as statements (as in the batch upsert) on top of the stored facts."""
    w = J.workspace(s, "facts")
    docs = J.parquet_stream(s, sf, "documents.parquet")
    keep = ["dedupe_key", "scope", "fact_type", "statement", "confidence", "status", "verified_at", "ttl_until"]
    step = lambda stored, batch: M.upsert_facts(stored, MQ.incoming_of(batch), D.NOW_MS).select(*keep)
    J.run_available(J.upsert_stream(docs, f"{w}/store", f"{w}/checkpoint", step, MQ.stored_facts(s, sf).select(*keep)))
    swept = M.expire(J.latest_version(s, f"{w}/store"), D.NOW_MS)
    return swept.select("dedupe_key", "scope", "fact_type", "confidence", "status", "verified_at", "ttl_until")


_D3 = MQ.QUERIES["d3_upsert_facts"].sql
_q("g13_streaming_upsert", _upsert, f"""SELECT dedupe_key, scope, fact_type, confidence, CASE WHEN ttl_until<={D.NOW_MS} AND status<>'retired' THEN 'retired' ELSE status END AS status,
  verified_at, ttl_until FROM ({_D3})""")


def _recall(s, sf):
    w = J.workspace(s, "recall")
    blocks = RQ.blocks(s, sf)
    R.block_counts(blocks).write.parquet(f"{w}/counts")  # texts are read once; a trigger makes the postings of its own words
    stored = s.read.parquet(f"{w}/counts")
    items = J.parquet_stream(s, sf, "benchmark.parquet")

    def recall(batch):
        asked = RQ.queries_of(batch)
        hits = R.block_recall(asked, blocks, 8, P.build_counted(stored, R.query_terms(asked, "block")))
        return R.gate_and_holdout(RQ.gate_input(hits), V.GATE_THRESHOLD, 0.3, "salt")

    J.run_available(J.recall_stream(items, recall, f"{w}/out", f"{w}/checkpoint"))
    return s.read.parquet(f"{w}/out").drop("trigger")


_q("g14_streaming_recall", _recall, RQ.QUERIES["c17_gate_and_holdout"].sql)
