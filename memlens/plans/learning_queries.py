"""Queries that learn from outcomes (F operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlens import fixed_values as V
from memlens.functions import text as T
from memlens.operators import analytics as A
from memlens.operators import learning as L
from memlens.plans import adapters as D
from memlens.plans import sqlbase as S
from memlens.plans.catalog import Query, Registry, rounded

QUERIES: Registry = {}


def _q(key, run, sql=None):
    QUERIES[key] = Query(lambda spark, sf: rounded(run(spark, sf)), sql)


def feedback(s, sf):
    """Every event as feedback on the document its k names, with five signal values."""
    e = D.raw_events(s, sf)
    v, k = F.col("value"), F.col("k")
    return e.select(
        "event_id", "ts", k.alias("trace_id"), (v >= 30).alias("helpful"), F.least(F.lit(1.0), v / 100).alias("bm25"), F.least(F.lit(1.0), k / 100).alias("jaccard"),
        F.when(k % 3 == 0, 0.0).otherwise(0.5).alias("structural"), F.when(k % 2 == 0, 0.0).otherwise(0.25).alias("cosine"), (F.lit(1.0) / (k + 1)).alias("freshness"),
        L.bucket_key(F.col("event_type"), F.when(k % 2 == 0, F.lit(" Django ")), F.lit(None).cast("string")).alias("bucket"))


_FB = S.RAW + """,
fb AS (SELECT event_id, ts, k AS trace_id, value>=30 AS helpful, least(1.0,value/100) AS bm25, least(1.0,k/100) AS jaccard, CASE WHEN k%3=0 THEN 0.0 ELSE 0.5 END AS structural,
  CASE WHEN k%2=0 THEN 0.0 ELSE 0.25 END AS cosine, 1.0/(k+1) AS freshness, event_type||'|'||CASE WHEN k%2=0 THEN 'django' ELSE '_' END||'|_' AS bucket FROM raw)"""
_q("f2_trace_quality", lambda s, sf: L.trace_quality(D.documents(s, sf).select(F.col("doc_id").alias("trace_id")), feedback(s, sf)), S.with_(_FB, """
a AS (SELECT trace_id, count(*) AS n, count(*) FILTER (helpful) AS h, max(ts) AS last_recalled_at FROM fb GROUP BY 1)""", select=f"""
SELECT doc_id AS trace_id, coalesce(n,0) AS recall_count, coalesce(h,0) AS helpful_count, last_recalled_at, round(CASE WHEN n IS NULL THEN 0.5 ELSE {S.wilson('h', 'n')} END,6) AS q_score FROM documents LEFT JOIN a ON trace_id=doc_id"""))
_SIG = "sg AS (" + " UNION ALL ".join(f"SELECT bucket, helpful, '{x}' AS signal, {x}::DOUBLE AS v FROM fb WHERE {x}>0" for x in V.SIGNALS) + ")"
_PRI = "pr AS (" + " UNION ALL ".join(f"SELECT '{x}' AS signal, {a}::DOUBLE AS a0, {b}::DOUBLE AS b0" for x, (a, b) in V.SIGNAL_PRIORS.items()) + ")"
_GP = """gp AS (SELECT signal, a0+coalesce(a,0) AS alpha, b0+coalesce(b,0) AS beta FROM pr LEFT JOIN (SELECT signal, sum(v) FILTER (helpful) AS a, sum(v) FILTER (NOT helpful) AS b FROM sg GROUP BY 1) USING (signal)),
gw AS (SELECT *, alpha/(alpha+beta) AS mean, alpha/(alpha+beta)/sum(alpha/(alpha+beta)) OVER () AS weight FROM gp)"""
_q("f3_global_posteriors", lambda s, sf: L.global_posteriors(feedback(s, sf)), S.with_(_FB, _SIG, _PRI, _GP,
   select="SELECT signal, round(alpha,6) AS alpha, round(beta,6) AS beta, round(mean,6) AS mean, round(weight,6) AS weight FROM gw"))
_q("f4_bucket_posteriors", lambda s, sf: L.bucket_posteriors(feedback(s, sf)), S.with_(_FB, _SIG, _PRI, _GP, f"""
bk AS (SELECT b.bucket, gw.signal, {V.BUCKET_STRENGTH}*gw.weight+coalesce(o.a,0) AS alpha, {V.BUCKET_STRENGTH}*(1-gw.weight)+coalesce(o.b,0) AS beta FROM (SELECT DISTINCT bucket FROM fb) b CROSS JOIN gw
  LEFT JOIN (SELECT bucket, signal, sum(v) FILTER (helpful) AS a, sum(v) FILTER (NOT helpful) AS b FROM sg GROUP BY 1,2) o ON o.bucket=b.bucket AND o.signal=gw.signal)""", select="""
SELECT bucket, signal, round(alpha,6) AS alpha, round(beta,6) AS beta, round(alpha/(alpha+beta),6) AS mean, round(alpha/(alpha+beta)/sum(alpha/(alpha+beta)) OVER (PARTITION BY bucket),6) AS weight FROM bk"""))


def _draws(s, sf):
    fb = feedback(s, sf)
    q = D.documents(s, sf).select(F.col("doc_id").alias("query_id"), F.concat(F.element_at(T.literal_array(["view", "click", "nothing"]), (F.col("doc_id") % 3 + 1).cast("int")), F.lit("|_|_")).alias("bucket"))
    return L.draw_weights(q, L.bucket_posteriors(fb), L.global_posteriors(fb), seed=7, embeddings=True)


_q("f5_draw_weights", _draws)


def _points(s, sf):
    return A.calibration_points(D.event_log(s, sf)).select(F.col("prediction").alias("x"), F.col("label").cast("double").alias("y"), "ts", "event_id")


# The isotonic fit as a max-min over means of all index ranges: quadratic, but plain SQL.
_ISO = """op AS (SELECT prediction AS x, label::DOUBLE AS y, row_number() OVER (ORDER BY prediction, ts, event_id) AS i FROM pts),
cs AS (SELECT *, sum(y) OVER (ORDER BY i) AS c FROM op),
av AS (SELECT a.i AS j, b.i AS k, (b.c-a.c+a.y)/(b.i-a.i+1) AS m FROM cs a JOIN cs b ON b.i>=a.i),
mn AS (SELECT j, k AS i, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS lo FROM av),
ft AS (SELECT i, max(lo) AS fit FROM mn GROUP BY 1)"""
_q("f6_fit_isotonic", lambda s, sf: L.fit_calibrator(_points(s, sf)).withColumn("y", F.round("y", 6)).groupBy("y").agg(
    F.sum("weight").alias("weight"), (F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("x")),
   S.with_(S.LOG, S.log_parts(), S.POINTS, _ISO, select="SELECT round(fit,6) AS y, count(*) AS weight, round(avg(x),6) AS x FROM ft JOIN op USING (i) GROUP BY round(fit,6) HAVING (SELECT count(*) FROM pts)>=20"))


def _model(s, sf):
    """A model of decile means, for comparing interpolation alone."""
    p = A.calibration_points(D.event_log(s, sf)).groupBy(F.floor(F.col("prediction") * 20).alias("position")).agg(F.avg("prediction").alias("x"), F.avg("label").alias("y"))
    return p


_q("f7_predict_isotonic", lambda s, sf: L.predict_isotonic(D.event_log(s, sf).where("event = 'injection'").select("event_id", "score"), _model(s, sf)), S.with_(S.LOG, S.log_parts(), S.POINTS, """
md AS (SELECT floor(prediction*20) AS p, avg(prediction) AS x, avg(label) AS y FROM pts GROUP BY 1),
sg AS (SELECT x AS ax, y AS ay, lead(x) OVER (ORDER BY p) AS bx, lead(y) OVER (ORDER BY p) AS by_ FROM md),
en AS (SELECT arg_min(x,p) AS lx, arg_min(y,p) AS ly, arg_max(x,p) AS hx, arg_max(y,p) AS hy FROM md)""", select="""
SELECT event_id, round(score,6) AS score, round(CASE WHEN score<=lx THEN ly WHEN score>=hx THEN hy ELSE (SELECT ay+(score-ax)/(bx-ax)*(by_-ay) FROM sg WHERE score>ax AND score<=bx) END,6) AS prob FROM log, en WHERE event='injection'"""))
_q("f8_calibration_set", lambda s, sf: A.calibration_points(D.event_log(s, sf)), S.with_(S.LOG, S.log_parts(), S.POINTS,
   select="SELECT query_id, block_id, ts, event_id, round(prediction,6) AS prediction, label FROM pts"))
_q("f9_refit_due", lambda s, sf: L.refit_due(D.event_log(s, sf)), S.with_(S.LOG, "lf AS (SELECT run_id, max(ts) AS last_fit FROM log WHERE event='calibrator_refit' GROUP BY 1)", select=f"""
SELECT run_id, count(*) FILTER (last_fit IS NULL OR ts>last_fit) AS outcomes_since_fit, max(last_fit) AS last_fit, count(*) FILTER (last_fit IS NULL OR ts>last_fit)>={V.REFIT_AFTER_OUTCOMES} AS due FROM log LEFT JOIN lf USING (run_id) WHERE event='outcome' GROUP BY 1"""))
