"""Queries that rank memories (C operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlens import fixed_values as V
from memlens.functions import text as T
from memlens.operators import postings as P
from memlens.operators import retrieval as R
from memlens.operators import vectors as VC
from memlens.plans import adapters as D
from memlens.plans import sqlbase as S
from memlens.plans.catalog import Query, Registry, rounded

QUERIES: Registry = {}
NOW = D.NOW_MS


def _q(key, run, sql=None):
    QUERIES[key] = Query(lambda spark, sf: rounded(run(spark, sf)), sql)


# --- entities ------------------------------------------------------------------------------

def queries(s, sf):
    """Benchmark items as queries with features, tokens, fingerprint and the fields filters need."""
    return queries_of(D.table(s, sf, "benchmark"))


def queries_of(items):
    q = D.queries_of(items).withColumn("error_type", F.lit(None).cast("string"))
    return _enrich(q, "text", "query_id").withColumn("scope", F.concat(F.lit("project.src"), (F.col("query_id") % 20).cast("string"), F.lit("/en"))).withColumn(
        "apis", F.when(F.col("query_id") % 3 == 0, F.array(F.lit("api0"), F.lit("api2"))).otherwise(F.array().cast("array<string>")))


def _enrich(d, text, id_col):
    none = F.lit(None).cast("string")
    f = T.features(F.col(text), none, F.col("language"), F.col("framework"), F.col("error_type"))
    d = d.withColumn("features", f).withColumn("tokens", T.tokenize(F.col(text)))
    return d.withColumn("fingerprint", T.fingerprint(F.col("features")))


def traces(s, sf):
    """Documents as traces."""
    return _enrich(D.traces(s, sf), "description", "trace_id")


def trace_queries(s, sf):
    """Benchmark queries plus every document text asked as it is (so exact matches exist)."""
    t = traces(s, sf).where("trace_id >= 0")
    own = t.select((F.col("trace_id") + 1_000_000_000).alias("query_id"), "fingerprint")
    return queries(s, sf).select("query_id", "fingerprint").unionByName(own)


def blocks(s, sf):
    b = D.blocks(s, sf)
    return b.withColumn("keywords", T.block_keywords(F.col("situation"), F.col("language"), F.col("framework"), F.lit(None).cast("string"), F.col("apis")))


def files(s, sf):
    """File rows with path-derived summary text and the whole content as symbols."""
    f = D.files(s, sf)
    return f.select("file_id", "rel_path", F.col("rel_path").alias("summary"), F.col("content").alias("symbols"), F.octet_length("content").cast("bigint").alias("size_bytes"))


# --- BM25 text ---------------------------------------------------------------------------------

def bm25_sql(name, qry, docs, cols, k, stop=(), min_len=0, keep_join="", k_sql=True):
    """CTEs ending in ``name(query_id, doc_id, bm25, rank)``.  ``docs`` is a CTE with doc_id and ``cols``."""
    toks = {c: S.terms_expr(f"coalesce({c},'')") for c in cols}
    length = "+".join(f"len({t})" for t in toks.values())
    occ = " UNION ALL ".join(f"SELECT doc_id, unnest({t}) AS term, {float(cols[c])} AS w FROM {docs}" for c, t in toks.items())
    base = f"list_distinct({S.terms_expr('text')})"
    flt = f"list_filter(t0, lambda x: length(x)>{min_len} AND NOT list_contains({S.arr([*stop, ''])}, x))"
    chosen = f"CASE WHEN len({flt})>0 THEN {flt} ELSE t0 END" if stop else (flt if min_len else "t0")
    return f"""{name}_q AS (SELECT query_id, {chosen} AS t FROM (SELECT query_id, {base} AS t0 FROM {qry})),
{name}_t AS (SELECT query_id, len(t) AS nt, unnest(t) AS term FROM {name}_q),
{name}_l AS (SELECT doc_id, {length} AS dl FROM {docs}),
{name}_s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM {name}_l),
{name}_o AS (SELECT doc_id, term, sum(w) AS wtf FROM ({occ}) WHERE term IN (SELECT term FROM {name}_t) GROUP BY 1,2),
{name}_d AS (SELECT term, CASE WHEN ln((n-count(*)+0.5)/(count(*)+0.5))<=0 THEN {V.BM25_IDF_FLOOR} ELSE ln((n-count(*)+0.5)/(count(*)+0.5)) END AS idf FROM {name}_o, {name}_s GROUP BY term, n),
{name}_p AS (SELECT t.query_id, o.doc_id, round(sum(d.idf*o.wtf*{V.BM25_K1 + 1}/(o.wtf+{V.BM25_K1}*({1 - V.BM25_B}+{V.BM25_B}*l.dl/s.avgdl))),6) AS bm25, count(*) AS hit, any_value(nt) AS nt
  FROM {name}_t t JOIN {name}_o o USING (term) JOIN {name}_d d USING (term) JOIN {name}_l l USING (doc_id), {name}_s s GROUP BY 1,2),
{name} AS (SELECT p.query_id, p.doc_id, p.bm25, row_number() OVER (PARTITION BY p.query_id ORDER BY p.bm25 DESC, p.doc_id) AS rank FROM {name}_p p {keep_join}
  {'AND' if 'WHERE' in keep_join else 'WHERE'} (p.nt>3 OR p.hit=p.nt) QUALIFY rank<={k})"""


_DOCS = "dd AS (SELECT doc_id, text, lang AS lang_col, source FROM documents)"
_q("c1_bm25_search", lambda s, sf: R.bm25_search(D.queries(s, sf), D.documents(s, sf).select("doc_id", "text", "source"), {"text": 5.0, "source": 3.0}, 10),
   S.with_(S.QUERIES, _DOCS, bm25_sql("bm", "qry", "dd", {"text": 5, "source": 3}, 10), select="SELECT query_id, doc_id, bm25, rank FROM bm"))
# Words that most documents hold, and short queries that need all their words.
_HEAD = lambda s, sf: D.queries(s, sf).select("query_id", F.concat_ws(" ", F.slice(T.index_terms(F.col("text")), 1, 3)).alias("text"))
_q("c1_bm25_all_words", lambda s, sf: R.bm25_search(_HEAD(s, sf), D.documents(s, sf).select("doc_id", "text"), {"text": 1.0}, 10),
   S.with_(S.QUERIES, _DOCS, f"hq AS (SELECT query_id, array_to_string(({S.terms_expr('text')})[1:3],' ') AS text FROM qry)", bm25_sql("bm", "hq", "dd", {"text": 1}, 10), select="SELECT query_id, doc_id, bm25, rank FROM bm"))

_FEAT_SQL = lambda name, src, text, extra: f"""{name} AS (SELECT *, list_sort(list_filter(toks, lambda x: length(x)>2)) AS kw FROM (SELECT *, {S.token_set(text)} AS toks,
  {extra} AS ferr, nullif(regexp_extract({text}, {S.q(V.ERROR_CODE_PATTERN)}, 1),'') AS fcode, lower(language) AS flang,
  coalesce(lower(framework), {"CASE " + " ".join(f"WHEN {S.rx(text, p)} THEN lower(" + (f"regexp_extract({text}, {S.q(p)}, 1)" if l == "$1" else S.q(l)) + ")" for p, l in V.FRAMEWORK_PATTERNS) + " END"}) AS ffw FROM {src}))"""
_ERR = lambda text: "CASE " + " ".join(f"WHEN {S.rx(text, p)} THEN lower(" + (f"{S.q(l.replace('$1', ''))}||regexp_extract({text}, {S.q(p)}, 1)" if "$1" in l else S.q(l)) + ")" for p, l in V.ERROR_TYPE_PATTERNS) + " END"
_FP = "sha256(array_to_string(list_concat(list_filter(['err:'||ferr,'code:'||fcode,'lang:'||flang,'fw:'||ffw], lambda x: x IS NOT NULL), kw),'|'))"
_QT = [S.QUERIES, S.TRACES, _FEAT_SQL("qf0", "qry", "text", _ERR("text")), f"qf AS (SELECT *, {_FP} AS fp FROM qf0)",
       _FEAT_SQL("tf0", "tr", "description", "lower(error_type)"), f"tf AS (SELECT *, {_FP} AS fp FROM tf0)"]

_q("c2_fingerprint_match", lambda s, sf: R.fingerprint_match(trace_queries(s, sf), traces(s, sf), 5), S.with_(*_QT, """
fq AS (SELECT query_id, fp FROM qf UNION ALL SELECT trace_id+1000000000, fp FROM tf)""", select="""
SELECT query_id, trace_id, round(q_score,6) AS q_score, 1.0 AS score, row_number() OVER (PARTITION BY query_id ORDER BY q_score DESC, trace_id) AS rank
FROM fq JOIN tf USING (fp) QUALIFY rank<=5"""))
_FITS = "(q.language IS NULL OR q.language=t.language) AND (q.framework IS NULL OR q.framework=t.framework)"
_CAND = lambda k: f"""cf AS (SELECT q.query_id, t.trace_id, t.q_score, row_number() OVER (PARTITION BY q.query_id ORDER BY t.q_score DESC, t.trace_id) AS rank
  FROM qry q JOIN tr t ON {_FITS} WHERE q.language IS NOT NULL OR q.framework IS NOT NULL QUALIFY rank<={k})"""
_q("c3_candidate_filter", lambda s, sf: R.candidate_filter(queries(s, sf), D.traces(s, sf), 20),
   S.with_(S.QUERIES, S.TRACES, _CAND(20), select="SELECT query_id, trace_id, round(q_score,6) AS q_score, rank FROM cf"))
_ELIG = f"el AS (SELECT q.query_id, count(t.trace_id) AS eligible FROM qry q LEFT JOIN tr t ON {_FITS} GROUP BY 1)"
_q("c3_count_eligible", lambda s, sf: R.count_eligible(queries(s, sf), D.traces(s, sf)), S.with_(S.QUERIES, S.TRACES, _ELIG, select="SELECT * FROM el"))


def _vectors(s, sf):
    return D.table(s, sf, "embeddings").select("vec_id", "embedding", "label")


_q("c4_cosine_topk", lambda s, sf: VC.cosine_topk(_vectors(s, sf).withColumnRenamed("vec_id", "query_id"), _vectors(s, sf), 5, block="label"), """
SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),6) AS cosine,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),6) DESC, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON a.label=b.label AND a.vec_id<>b.vec_id WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),6)>=0.3 QUALIFY rank<=5""")

# Without a blocking key: every hundredth vector against all
_q("c4_cosine_unblocked", lambda s, sf: VC.cosine_topk(_vectors(s, sf).where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), _vectors(s, sf), 5), """
SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),6) AS cosine,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),6) DESC, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id%100=0 AND a.vec_id<>b.vec_id WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),6)>=0.3 QUALIFY rank<=5""")

_q("c5_jaccard_pairs", lambda s, sf: R.jaccard_within(D.documents(s, sf).select(F.col("doc_id").alias("id"), T.tokenize(F.col("text")).alias("tokens")), 0.6), S.with_(f"""
ts AS (SELECT doc_id, {S.token_set('text')} AS t FROM documents),
tk AS (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM ts),
ov AS (SELECT a.doc_id AS a_id, b.doc_id AS b_id, a.n AS an, b.n AS bn, count(*) AS c FROM tk a JOIN tk b ON a.w=b.w AND a.doc_id<b.doc_id AND b.n BETWEEN 0.6*a.n-1 AND a.n/0.6+1 GROUP BY ALL)""",
  select="SELECT a_id, b_id, round(c/(an+bn-c),6) AS similarity FROM ov WHERE c/(an+bn-c)>=0.6"))

# C6 between traces that are neighbours in a framework, in id order.
_q("c6_structural_similarity", lambda s, sf: _neighbours(s, sf), S.with_(*_QT[1:2], _FEAT_SQL("tf", "tr", "description", "lower(error_type)"), f"""
nb AS (SELECT *, lead(trace_id) OVER w AS o_id, lead(ferr) OVER w AS oerr, lead(flang) OVER w AS olang, lead(ffw) OVER w AS ofw, lead(kw) OVER w AS okw FROM tf WHERE framework IS NOT NULL WINDOW w AS (PARTITION BY framework ORDER BY trace_id))""", select=f"""
SELECT trace_id, o_id, round(CASE WHEN mx=0 THEN 0.0 ELSE sc/mx END,6) AS similarity FROM (SELECT trace_id, o_id,
  (CASE WHEN ferr IS NOT NULL OR oerr IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN flang IS NOT NULL OR olang IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN ffw IS NOT NULL OR ofw IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN len(kw)>0 AND len(okw)>0 THEN 3 ELSE 0 END)::DOUBLE AS mx,
  CASE WHEN ferr=oerr THEN 4 ELSE 0 END + CASE WHEN flang=olang THEN 2 ELSE 0 END + CASE WHEN ffw=ofw THEN 2 ELSE 0 END + CASE WHEN len(kw)>0 AND len(okw)>0 THEN 3*({S.jac('kw', 'okw')}) ELSE 0 END AS sc
  FROM nb WHERE o_id IS NOT NULL)"""))


def _neighbours(s, sf):
    """Pairs (i, next i) inside a framework by an equi-join on a dense rank."""
    t = traces(s, sf).where("framework IS NOT NULL").select("trace_id", "framework", "features")
    from memlens.common import with_position
    p = with_position(t, "framework", "trace_id", "trace_id")
    a = p.select("framework", "pos", "trace_id", F.col("features").alias("qf"))
    b = p.select("framework", (F.col("pos") - 1).alias("pos"), F.col("trace_id").alias("o_id"), F.col("features").alias("tf"))
    return a.join(b, ["framework", "pos"]).select("trace_id", "o_id", R.structural().alias("similarity"))


def _custom_similarity(s, sf):
    """Neighbours compared with two named features of their texts; ``digits`` has a weight of its own."""
    rules = {"digits": "([0-9]+)", "mark": "([%$&])"}
    t = traces(s, sf).where("framework IS NOT NULL").withColumn("features", F.struct("features", T.custom_features(F.col("description"), rules).alias("custom")))
    from memlens.common import with_position
    p = with_position(t.select("trace_id", "framework", "features"), "framework", "trace_id", "trace_id")
    a = p.select("framework", "pos", "trace_id", F.col("features.features").alias("qf"), F.col("features.custom").alias("qc"))
    b = p.select("framework", (F.col("pos") - 1).alias("pos"), F.col("trace_id").alias("o_id"), F.col("features.features").alias("tf"), F.col("features.custom").alias("tc"))
    weights = {**V.STRUCTURAL_WEIGHTS, "digits": 1.5}
    return a.join(b, ["framework", "pos"]).select("trace_id", "o_id", R.structural(weights=weights, custom=(F.col("qc"), F.col("tc"))).alias("similarity"))


_q("c6_structural_custom", _custom_similarity, S.with_(*_QT[1:2], _FEAT_SQL("tf", "tr", "description", "lower(error_type)"), """
tc AS (SELECT *, nullif(regexp_extract(description, '([0-9]+)', 1),'') AS dg, nullif(regexp_extract(description, '([%$&])', 1),'') AS mk FROM tf),
nb AS (SELECT *, lead(trace_id) OVER w AS o_id, lead(ferr) OVER w AS oerr, lead(flang) OVER w AS olang, lead(ffw) OVER w AS ofw, lead(kw) OVER w AS okw, lead(dg) OVER w AS odg, lead(mk) OVER w AS omk
  FROM tc WHERE framework IS NOT NULL WINDOW w AS (PARTITION BY framework ORDER BY trace_id))""", select=f"""
SELECT trace_id, o_id, round(CASE WHEN mx=0 THEN 0.0 ELSE sc/mx END,6) AS similarity FROM (SELECT trace_id, o_id,
  (CASE WHEN ferr IS NOT NULL OR oerr IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN flang IS NOT NULL OR olang IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN ffw IS NOT NULL OR ofw IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN len(kw)>0 AND len(okw)>0 THEN 3 ELSE 0 END
   + CASE WHEN dg IS NOT NULL OR odg IS NOT NULL THEN 1.5 ELSE 0 END + CASE WHEN mk IS NOT NULL OR omk IS NOT NULL THEN 2 ELSE 0 END)::DOUBLE AS mx,
  CASE WHEN ferr=oerr THEN 4 ELSE 0 END + CASE WHEN flang=olang THEN 2 ELSE 0 END + CASE WHEN ffw=ofw THEN 2 ELSE 0 END + CASE WHEN len(kw)>0 AND len(okw)>0 THEN 3*({S.jac('kw', 'okw')}) ELSE 0 END
   + CASE WHEN dg=odg THEN 1.5 ELSE 0 END + CASE WHEN mk=omk THEN 2 ELSE 0 END AS sc
  FROM nb WHERE o_id IS NOT NULL)"""))

_q("c7_freshness", lambda s, sf: D.traces(s, sf).select("trace_id", R.scores.freshness(F.lit(1_710_000_000_000) - F.col("created_at")).alias("freshness")),
   S.with_(S.TRACES, select=f"SELECT trace_id, round(exp(-ln(2)*((1710000000000-created_at)/{V.DAY_MS})/30),6) AS freshness FROM tr"))


def _damp_sql(n):
    w = V.DEFAULT_WEIGHTS
    others = w["jaccard"] + w["structural"] + w["cosine"] + w["freshness"]
    d = f"least(1.0, {n}/{float(V.DAMPING_FLOOR)})"
    return {s: (f"({w[s]}*{d})" if s == "bm25" else f"({w[s]}*(1+{w['bm25']}*(1-{d})/{others}))") for s in V.SIGNALS}


_q("c8_small_corpus_damping", lambda s, sf: R.count_eligible(queries(s, sf), D.traces(s, sf)).select(
    "query_id", "eligible", *[c.alias(f"w_{n}") for n, c in R.damped_weights(F.col("eligible")).items()]),
   S.with_(S.QUERIES, S.TRACES, _ELIG, select="SELECT query_id, eligible, " + ", ".join(f"round({e},6) AS w_{n}" for n, e in _damp_sql("eligible").items()) + " FROM el"))


def _hybrid(s, sf, **kw):
    """Five index columns: whole text, its first and last line, framework and language, error type."""
    lines = F.split("description", "\n")
    t = D.traces(s, sf).withColumns({"summary": F.element_at(lines, 1), "explanation": F.element_at(lines, -1), "tags": F.concat_ws(" ", "framework", "language"), "error_message": F.col("error_type")})
    return R.hybrid_rank(queries(s, sf), t, 1_710_000_000_000, 5, enrich=lambda found: _enrich(found, "description", "trace_id"), **kw)


_DW = _damp_sql("eligible")
_HYBRID = [*_QT, """dt AS (SELECT trace_id AS doc_id, description, string_split(description, chr(10))[1] AS summary, string_split(description, chr(10))[-1] AS explanation,
  concat_ws(' ', framework, language) AS tags, error_type AS error_message FROM tr)""", bm25_sql("bm", "qry", "dt", V.TRACE_INDEX_WEIGHTS, 20), _CAND(20), _ELIG, f"""
ex AS (SELECT q.query_id, t.trace_id FROM qf q JOIN tf t USING (fp) QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY t.q_score DESC, t.trace_id)<=5),
cd AS (SELECT query_id, trace_id, bool_or(e) AS exact, max(raw) AS raw FROM (SELECT query_id, trace_id, true AS e, NULL AS raw FROM ex UNION ALL SELECT query_id, doc_id, false, bm25 FROM bm
   UNION ALL SELECT query_id, trace_id, false, NULL FROM cf) GROUP BY 1,2),
sg AS (SELECT c.query_id, c.trace_id, c.exact, coalesce(c.raw/nullif(max(c.raw) OVER (PARTITION BY c.query_id),0),0.0) AS bm25, {S.jac('q.toks', 't.toks')} AS jaccard, 0.0 AS cosine,
  exp(-ln(2)*((1710000000000-t.created_at)/{V.DAY_MS})/30) AS freshness, t.q_score, e.eligible,
  (CASE WHEN q.ferr IS NOT NULL OR t.ferr IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN q.flang IS NOT NULL OR t.flang IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN q.ffw IS NOT NULL OR t.ffw IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN len(q.kw)>0 AND len(t.kw)>0 THEN 3 ELSE 0 END)::DOUBLE AS mx,
  CASE WHEN q.ferr=t.ferr THEN 4 ELSE 0 END + CASE WHEN q.flang=t.flang THEN 2 ELSE 0 END + CASE WHEN q.ffw=t.ffw THEN 2 ELSE 0 END + CASE WHEN len(q.kw)>0 AND len(t.kw)>0 THEN 3*({S.jac('q.kw', 't.kw')}) ELSE 0 END AS sc
  FROM cd c JOIN qf q USING (query_id) JOIN tf t USING (trace_id) JOIN el e USING (query_id)),
s2 AS (SELECT *, CASE WHEN mx=0 THEN 0.0 ELSE sc/mx END AS structural, {", ".join(f"{e} AS w_{n}" for n, e in _DW.items())} FROM sg),
s3 AS (SELECT *, CASE WHEN exact THEN 1.0 ELSE bm25*w_bm25+jaccard*w_jaccard+structural*w_structural+cosine*w_cosine+freshness*w_freshness END AS base FROM s2),
s4 AS (SELECT *, round(least(1.0,greatest(0.0, base*(0.85+0.30*q_score))),6) AS score, CASE WHEN exact THEN 'exact' WHEN base>0.5 THEN 'similar' ELSE 'related' END AS match_type FROM s3),
hy AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, trace_id) AS rank FROM s4 WHERE score>=0.1 QUALIFY rank<=5)"""]
_cols = ", ".join(f"round({c},6) AS {c}" for c in [*V.SIGNALS, *[f"w_{x}" for x in V.SIGNALS]])
_q("c9_hybrid_rank", _hybrid, S.with_(*_HYBRID, select=f"SELECT query_id, trace_id, rank, score, match_type, {_cols} FROM hy"))
_q("c10_explain_scores", lambda s, sf: R.explain_scores(_hybrid(s, sf)), S.with_(*_HYBRID, select=" UNION ALL ".join(
    f"SELECT query_id, trace_id, '{x}' AS signal, round({x},6) AS value, round(w_{x},6) AS weight, round({x}*w_{x},6) AS contribution FROM hy" for x in V.SIGNALS)))

_KW = (f"list_sort(list_distinct(list_concat({S.split_set('situation', '[^a-z0-9_.]+', 2, V.BLOCK_STOP_WORDS)}, list_concat("
       "list_filter(['lang:'||lower(language), 'fw:'||lower(framework)], lambda x: x IS NOT NULL), list_transform(apis, lambda a: 'api:'||lower(a))))))")
_BLOCKDOCS = f"bd AS (SELECT block_id AS doc_id, mechanism AS text, array_to_string({_KW},' ') AS kw FROM blk)"
_QX = S.QUERIES + """,
qx AS (SELECT *, 'project.src'||(query_id%20)||'/en' AS scope, CASE WHEN query_id%3=0 THEN ['api0','api2'] ELSE []::VARCHAR[] END AS apis FROM qry)"""
_KEEPB = """JOIN blk b ON b.block_id=p.doc_id JOIN qx q ON q.query_id=p.query_id WHERE b.status='active' AND (b.language IS NULL OR q.language IS NULL OR b.language=q.language)
  AND (b.framework IS NULL OR q.framework IS NULL OR b.framework=q.framework) AND (len(q.apis)=0 OR len(b.apis)=0 OR list_has_any(q.apis,b.apis))"""
_BR = [_QX, S.BLOCKS, _BLOCKDOCS, bm25_sql("bm", "qx", "bd", {"text": 2, "kw": 1}, 8, V.SEARCH_STOP_WORDS, 1, _KEEPB),
       "br AS (SELECT query_id, doc_id AS block_id, rank, bm25, round(bm25/max(bm25) OVER (PARTITION BY query_id),6) AS score FROM bm)"]
_q("c11_block_recall", lambda s, sf: R.block_recall(queries(s, sf), blocks(s, sf), 8), S.with_(*_BR, select="SELECT * FROM br"))

_KEEPF = """JOIN fct f ON f.fact_id=p.doc_id JOIN qx q ON q.query_id=p.query_id WHERE f.status='active' AND (f.language IS NULL OR q.language IS NULL OR f.language=q.language)
  AND (f.scope='global' OR f.scope=q.scope OR starts_with(q.scope, f.scope||'.') OR starts_with(q.scope, f.scope||'/'))"""
_SPEC = "CASE WHEN f.scope='global' THEN 0 ELSE 1+length(regexp_replace(f.scope,'[^./]','','g')) END"
_q("c12_fact_search", lambda s, sf: R.fact_search(queries(s, sf), D.facts(s, sf), 5), S.with_(
    _QX, S.FACTS, "fd AS (SELECT fact_id AS doc_id, statement AS text FROM fct)", bm25_sql("bm", "qx", "fd", {"text": 1}, 5, keep_join=_KEEPF), select=f"""
SELECT query_id, f.fact_id, f.scope, row_number() OVER (PARTITION BY query_id ORDER BY {_SPEC} DESC, bm.rank) AS rank FROM bm JOIN fct f ON f.fact_id=bm.doc_id"""))
_q("c12_fact_search_no_text", lambda s, sf: R.fact_search(queries(s, sf), D.facts(s, sf), 5, use_text=False), S.with_(_QX, S.FACTS, f"""
m AS (SELECT q.query_id, f.fact_id, f.scope, row_number() OVER (PARTITION BY q.query_id ORDER BY f.confidence DESC, f.verified_at DESC, f.fact_id) AS r FROM qx q JOIN fct f
  ON f.status='active' AND (f.language IS NULL OR q.language IS NULL OR f.language=q.language)
  AND (f.scope='global' OR f.scope=q.scope OR starts_with(q.scope, f.scope||'.') OR starts_with(q.scope, f.scope||'/')) QUALIFY r<=5)""", select=f"""
SELECT query_id, f.fact_id, f.scope, row_number() OVER (PARTITION BY query_id ORDER BY {_SPEC} DESC, r) AS rank FROM m f"""))

_q("c13_file_recall", lambda s, sf: R.file_recall(D.queries(s, sf), files(s, sf), 3), S.with_(
    S.QUERIES, S.FILES, "ff AS (SELECT file_id AS doc_id, rel_path AS a, content AS b FROM fil)", bm25_sql("bm", "qry", "ff", {"a": 1, "b": 1}, 3, (), 1),
    select="SELECT query_id, doc_id AS file_id, bm25, rank FROM bm"))


def _prompts(s, sf):
    """Every third turn is a prompt; all other turns of the session are chunks."""
    t = D.turns(s, sf)
    n = F.col("turn") + F.substring("session_id", 2, 20).cast("bigint")
    return (t.where(n % 3 == 0).select(F.concat_ws("-", "session_id", "turn").alias("query_id"), "session_id", F.col("content").alias("text")),
            t.where(n % 3 != 0).select("session_id", F.col("turn").alias("chunk_start"), F.col("turn").alias("chunk_end"), F.col("content").alias("summary")))


def _ct(c):
    spaced = f"regexp_replace(lower({c}), '[*?\\[\\]()\\\\^$+|.{{}}/#''\"`_\\-\\s]+', ' ', 'g')"
    return f"list_distinct(list_filter(string_split(trim({spaced}),' '), lambda x: length(x)>=2 AND NOT list_contains({S.arr(V.CHUNK_STOP_WORDS)}, x)))"


_q("c14_chunk_recall", lambda s, sf: R.chunk_recall(*_prompts(s, sf), 2), S.with_(f"""
p AS (SELECT 'c'||conv_id||'-'||turn AS query_id, 'c'||conv_id AS session_id, {_ct('text')} AS pt FROM conversations WHERE (turn+conv_id)%3=0),
c AS (SELECT 'c'||conv_id AS session_id, turn, {_ct('text')} AS ct FROM conversations WHERE (turn+conv_id)%3<>0),
s AS (SELECT query_id, p.session_id, turn AS chunk_start, turn AS chunk_end, round({S.jac('pt', 'ct')},6) AS score FROM p JOIN c USING (session_id)),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_end DESC)<=2)""",
  select="SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_start) AS position FROM b"))


def _slate(s, sf):
    return R.bm25_search(D.queries(s, sf), D.documents(s, sf).select("doc_id", "text"), {"text": 1.0}, 10).select("query_id", F.col("doc_id").alias("item_id"), "rank", "bm25")


def _ext(s, sf):
    sl = _slate(s, sf)
    score = F.when((F.col("query_id") % 7 == 3) & (F.col("rank") == 2), 1.5).otherwise((F.col("item_id") % 11) / 11)
    return sl, sl.where((F.col("query_id") % 5 != 1) & ~((F.col("query_id") % 5 == 2) & (F.col("rank") == 1))).select("query_id", "item_id", score.alias("ext"))


_SL = [S.QUERIES, _DOCS, bm25_sql("sl", "qry", "dd", {"text": 1}, 10)]
_q("c15_apply_external_scores", lambda s, sf: R.apply_external_scores(*_ext(s, sf)), S.with_(*_SL, """
g AS (SELECT query_id, doc_id, CASE WHEN query_id%7=3 AND rank=2 THEN 1.5 ELSE (doc_id%11)/11 END AS ext FROM sl WHERE query_id%5<>1 AND NOT (query_id%5=2 AND rank=1)),
j AS (SELECT s.query_id, s.doc_id, s.rank, g.ext FROM sl s LEFT JOIN g USING (query_id, doc_id)),
st AS (SELECT query_id, CASE WHEN count(ext)=0 THEN 'null' WHEN count(ext)<>count(*) THEN 'empty' WHEN bool_or(ext<0 OR ext>1) THEN 'validation' END AS reason FROM j GROUP BY 1)""", select="""
SELECT j.query_id, doc_id AS item_id, rank AS old_rank, row_number() OVER (PARTITION BY j.query_id ORDER BY CASE WHEN reason IS NULL THEN ext END DESC NULLS LAST, rank) AS new_rank,
  reason IS NOT NULL AS fell_back, reason FROM j JOIN st USING (query_id)"""))

def _diverse(s, sf, **kw):
    slate = P.few(_slate(s, sf)).join(D.documents(s, sf).select(F.col("doc_id").alias("item_id"), "text", "source"), "item_id")
    return R.mmr(slate.withColumn("relevance", F.col("bm25") / 100), 5, **kw)


def _mmr_sql(similar: str, columns: str) -> str:
    """Five picks by recursion over a query's list; ``similar`` compares list items a and b."""
    gain = "0.7*rel[i] - (1-0.7)*coalesce(list_max(list_transform(chosen, lambda c: sim[i][c])), 0.0)"
    return S.recursive(*_SL, f"""g AS (SELECT query_id, list(sl.doc_id ORDER BY rank) AS ids, list(bm25/100 ORDER BY rank) AS rel, list({columns} ORDER BY rank) AS it FROM sl JOIN documents d ON d.doc_id=sl.doc_id GROUP BY 1),
m AS (SELECT query_id, ids, rel, list_transform(it, lambda a: list_transform(it, lambda b: {similar})) AS sim FROM g),
r AS (SELECT query_id, ids, rel, sim, []::BIGINT[] AS chosen FROM m UNION ALL
  SELECT query_id, ids, rel, sim, list_append(chosen, (list_sort(list_transform(list_filter(range(1, len(ids)+1), lambda i: NOT list_contains(chosen, i)), lambda i: {{'g': -({gain}), 'i': i}})))[1].i) FROM r WHERE len(chosen)<least(5, len(ids)))""", select="""
SELECT query_id, ids[unnest(chosen)] AS item_id, unnest(range(1, len(chosen)+1)) AS position FROM r WHERE len(chosen)=least(5, len(ids))""")


_MMR_WORDS = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text),'[^a-z0-9_\\s]',' ','g'),'\\s+'), lambda x: length(x)>=2))"
_q("c16_mmr", _diverse, _mmr_sql(S.jac("a", "b"), _MMR_WORDS))
# H4: a caller's own similarity, here 1 for one source and 0.25 for others
_q("c16_mmr_own_similarity", lambda s, sf: _diverse(s, sf, similarity=lambda a, b: F.when(a["source"] == b["source"], 1.0).otherwise(0.25)),
   _mmr_sql("CASE WHEN a=b THEN 1.0 ELSE 0.25 END", "source"))


def _gated(s, sf):
    b = R.block_recall(queries(s, sf), blocks(s, sf), 8)
    return R.gate_and_holdout(gate_input(b), V.GATE_THRESHOLD, 0.3, "salt")


def gate_input(hits):
    return hits.select("query_id", F.col("block_id").alias("item_id"), F.col("score").alias("prob"), F.concat(F.lit("fp"), F.col("query_id").cast("string")).alias("fingerprint"),
                       (F.col("query_id") % 10 == 9).alias("manual_shadow"))


_q("c17_gate_and_holdout", _gated, S.with_(*_BR, f"""g AS (SELECT *, score>={V.GATE_THRESHOLD} AS open FROM br),
p AS (SELECT query_id, bool_or(open) AS wi, query_id%10=9 AS man, {S.holdout("('fp'||query_id)", 0.3, 'salt')} AS ho FROM g GROUP BY query_id),
p2 AS (SELECT *, (NOT man AND wi AND ho) AS held FROM p)""", select="""
SELECT query_id, block_id AS item_id, score AS prob, (NOT (man OR held) AND open) AS passes_gate, (man OR held) AS shadow, (NOT (man OR held) AND wi) AS should_inject,
  CASE WHEN held THEN 'holdout' END AS control_reason FROM g JOIN p2 USING (query_id)"""))


_q("c19_naive_top1", lambda s, sf: R.naive_top1(D.queries(s, sf), D.documents(s, sf)), S.with_(S.QUERIES, f"""
a AS (SELECT query_id, {S.split_set('text', '[^a-z0-9]+', 3)} AS t FROM qry), b AS (SELECT doc_id, {S.split_set('text', '[^a-z0-9]+', 3)} AS t FROM documents),
ta AS (SELECT query_id, len(t) AS n, unnest(t) AS w FROM a), bt AS (SELECT doc_id, len(t) AS m, unnest(t) AS w FROM b),
o AS (SELECT query_id, doc_id, round(count(*)/(n+m-count(*)),6) AS score FROM ta JOIN bt USING (w) GROUP BY query_id, doc_id, n, m)""", select="""
SELECT query_id, doc_id, score FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)=1"""))


def _eval(s, sf):
    """Judgements: a document that holds the whole query text is expected to be found."""
    q, d = D.queries(s, sf), D.documents(s, sf)
    grams = d.select("doc_id", T.norm_space(F.col("text")).alias("text"))
    rel = R.like_search(q.select("query_id", T.norm_space(F.col("text")).alias("text")), grams.select(F.col("doc_id").alias("trace_id"), F.col("text").alias("description"), F.lit(0.0).alias("q_score")), None)
    return R.retrieval_eval(_slate(s, sf).select("query_id", F.col("item_id").alias("doc_id"), "rank"), rel.select("query_id", F.col("trace_id").alias("doc_id")))


_EV = [*_SL, """qr AS (SELECT q.query_id, d.doc_id FROM (SELECT query_id, lower(trim(regexp_replace(text,'\\s+',' ','g'))) AS n FROM qry) q JOIN (SELECT doc_id, lower(trim(regexp_replace(text,'\\s+',' ','g'))) AS h FROM documents) d ON contains(h, n)),
ne AS (SELECT query_id, count(*) AS expected FROM qr GROUP BY 1),
hi AS (SELECT query_id, count(*) FILTER (rank<=5) AS found, coalesce(sum(1/log2(rank+1)) FILTER (rank<=5),0.0) AS dcg, min(rank) AS first FROM sl SEMI JOIN qr USING (query_id, doc_id) GROUP BY 1),
ev AS (SELECT query_id, coalesce(found/expected,0.0) AS recall, coalesce(dcg/list_sum(list_transform(range(1,least(expected,5)+1), lambda i: 1/log2(i+1))),0.0) AS ndcg, coalesce(1/first,0.0) AS rr FROM ne LEFT JOIN hi USING (query_id))"""]
_q("c20_retrieval_eval", _eval, S.with_(*_EV, select="SELECT query_id, round(recall,6) AS recall, round(ndcg,6) AS ndcg, round(rr,6) AS rr FROM ev"))
_q("c20_retrieval_summary", lambda s, sf: R.retrieval_summary(_eval(s, sf)), S.with_(*_EV, select="""
SELECT count(*) AS cases, round(avg(recall),6) AS recall, round(avg(ndcg),6) AS ndcg, round(avg(rr),6) AS mrr, avg(recall)>=0.85 AND avg(ndcg)>=0.70 AND avg(rr)>=0.65 AS passed FROM ev"""))


def _candidates(s, sf):
    """Up to ten candidates per query from its slate, with the capability by item id."""
    i = F.col("item_id")
    return _slate(s, sf).select("query_id", i.alias("candidate_id"), F.element_at(F.array(*[F.lit(c) for c in D.CAPABILITIES]), (i % 6 + 1).cast("int")).alias("capability"),
                                (i % 200).alias("injection_tokens"), (i % 900).cast("double").alias("avoided_tokens"), (i % 100 / 100).alias("prob"),
                                (i % 13).cast("double").alias("noise"), F.when(i % 17 == 0, 1000.0).otherwise(0.0).alias("freshness"), (i % 23 == 0).alias("recent"))


def _arbitrate_sql(budget, blocks, files, chunks):
    limit = f"CASE x.cap WHEN 'reasoning_reuse' THEN {blocks} WHEN 'file_memory' THEN {files} WHEN 'context_fold' THEN {chunks} WHEN 'loop_redirect' THEN 1 WHEN 'tool_supervision' THEN 1 ELSE 1000000 END"
    return S.recursive(*_SL, _NETS, f"""l AS (SELECT query_id, list({{'i': i, 'cap': ({S.arr(D.CAPABILITIES)})[(i%6+1)::INT], 'net': net, 'inj': i%200}} ORDER BY net DESC, i) AS rows FROM nr WHERE reason='positive_roi' GROUP BY 1),
o AS (SELECT query_id, rows[1:1] AS done, rows[2:] AS rest FROM l UNION ALL
  SELECT query_id, list_append(done, CASE WHEN early THEN alt ELSE rest[1] END), CASE WHEN early THEN list_transform(rest[2:], lambda x: CASE WHEN x.i=alt.i THEN rest[1] ELSE x END) ELSE rest[2:] END
  FROM (SELECT *, rest[1].cap=done[-1].cap AND coalesce(alt.net >= rest[1].net-1, false) AS early FROM (SELECT *, list_filter(rest, lambda x: x.cap<>done[-1].cap)[1] AS alt FROM o WHERE len(rest)>0))),
w AS (SELECT query_id, done, {budget}::DOUBLE AS budget, []::VARCHAR[] AS used, []::VARCHAR[] AS why FROM o WHERE len(rest)=0 UNION ALL
  SELECT query_id, done, CASE WHEN y='positive_roi' THEN budget-x.inj ELSE budget END, CASE WHEN y='positive_roi' THEN list_append(used, x.cap) ELSE used END, list_append(why, y)
  FROM (SELECT *, CASE WHEN len(list_filter(used, lambda u: u=x.cap))>={limit} THEN 'profile_cap' WHEN x.inj>budget THEN 'budget' ELSE 'positive_roi' END AS y FROM (SELECT *, done[len(why)+1] AS x FROM w WHERE len(why)<len(done)))),
d AS (SELECT query_id, unnest(done) AS x, unnest(why) AS reason FROM w WHERE len(why)=len(done))""", select=f"""
SELECT query_id, x.i AS candidate_id, x.cap AS capability, round(x.net,6) AS net, reason, CASE WHEN reason='positive_roi' THEN 'inject' ELSE 'suppress' END AS action FROM d
UNION ALL SELECT query_id, i, ({S.arr(D.CAPABILITIES)})[(i%6+1)::INT], round(net,6), reason, 'suppress' FROM nr WHERE reason<>'positive_roi'""")


_NETS = """c AS (SELECT query_id, doc_id AS i FROM sl),
n AS (SELECT *, (i%100/100)*(i%900) - ((i%200)+(i%13)+CASE WHEN i%17=0 THEN 1000 ELSE 0 END) AS net FROM c),
nr AS (SELECT *, CASE WHEN i%23=0 THEN 'duplicate' WHEN i%100/100<0.10 THEN 'low_confidence' WHEN i%17=0 AND 1000>=i%900 THEN 'stale' WHEN net < -8 THEN 'low_confidence' ELSE 'positive_roi' END AS reason FROM n)"""
_q("c21_arbitrate", lambda s, sf: R.arbitrate(_candidates(s, sf), "balanced"), _arbitrate_sql(700, 2, 2, 2))
_q("c21_arbitrate_recovering", lambda s, sf: R.arbitrate(_candidates(s, sf), "balanced", plan=R.serving_plan("balanced", recovering=True, session=False, token_budget=800)), _arbitrate_sql(800, 3, 2, 0))
_q("c21_arbitration_scores", lambda s, sf: R.arbitration_scores(_candidates(s, sf), "balanced").select("query_id", "candidate_id", "net", "reason"), S.with_(*_SL, """
c AS (SELECT query_id, doc_id AS i FROM sl),
n AS (SELECT *, (i%100/100)*(i%900) - ((i%200)+(i%13)+CASE WHEN i%17=0 THEN 1000 ELSE 0 END) AS net FROM c)""", select="""
SELECT query_id, i AS candidate_id, round(net,6) AS net, CASE WHEN i%23=0 THEN 'duplicate' WHEN i%100/100<0.10 THEN 'low_confidence' WHEN i%17=0 AND 1000>=i%900 THEN 'stale' WHEN net < -8 THEN 'low_confidence' ELSE 'positive_roi' END AS reason FROM n"""))


def _packable(s, sf):
    i = F.col("item_id")
    return _slate(s, sf).select("query_id", F.element_at(F.array(*[F.lit(k) for k in R.PACK_KINDS]), (i % 4 + 1).cast("int")).alias("kind"), "item_id", "rank",
                                (F.lit(100) + (i * 7) % 1500).alias("line_chars"), (F.col("query_id") % 9 == 4).alias("shadow"))


def _pack_sql(budget_chars):
    prev, parts = "u0", [f"""h AS (SELECT query_id, (['block','fact','file','chunk'])[(doc_id%4+1)::INT] AS kind, doc_id AS item_id, rank, 100+(doc_id*7)%1500 AS line_chars FROM sl WHERE query_id%9<>4),
hp AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY rank) AS pos FROM h QUALIFY pos<=CASE kind WHEN 'block' THEN 4 WHEN 'fact' THEN 4 ELSE 3 END),
u0 AS (SELECT DISTINCT query_id, {R.FRAME_CHARS}::BIGINT AS used FROM hp)"""]
    for n, kind in enumerate(R.PACK_KINDS, 1):
        parts.append(f"""k{n} AS (SELECT * FROM (SELECT hp.*, used+sum(line_chars+1) OVER (PARTITION BY query_id ORDER BY pos) AS upto FROM hp JOIN {prev} USING (query_id) WHERE kind='{kind}') WHERE upto<={budget_chars}),
u{n} AS (SELECT query_id, coalesce(m, used) AS used FROM {prev} LEFT JOIN (SELECT query_id, max(upto) AS m FROM k{n} GROUP BY 1) USING (query_id))""")
        prev = f"u{n}"
    parts.append("""ka AS (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3 UNION ALL SELECT * FROM k4),
lo AS (SELECT *, NULL AS upto FROM hp WHERE query_id NOT IN (SELECT query_id FROM ka) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY list_position(['block','fact','file','chunk'],kind), pos)=1),
pk AS (SELECT * FROM ka UNION ALL SELECT * FROM lo)""")
    return parts


_pids = lambda k: f"coalesce(string_agg(item_id, ',' ORDER BY pos) FILTER (kind='{k}'),'') AS {k}_ids, coalesce(ceil(sum(line_chars+1) FILTER (kind='{k}')/4),0)::BIGINT AS {k}_tokens"
_q("c22_pack_budget", lambda s, sf: R.pack_summary(R.pack_budget(_packable(s, sf), 600)), S.with_(*_SL, *_pack_sql(2400), select=f"SELECT query_id, {', '.join(_pids(k) for k in R.PACK_KINDS)} FROM pk GROUP BY 1"))


def _roi(s, sf):
    hits = R.file_recall(D.queries(s, sf), files(s, sf), 4).join(files(s, sf).select("file_id", "rel_path", "size_bytes"), "file_id")
    line = F.concat(F.lit("* "), F.col("rel_path"))
    return R.roi_filter(hits, 700, 2, R.file_net_tokens(F.col("size_bytes"), line)).select("query_id", "file_id", "net_tokens", "rank")


_q("c23_roi_filter", _roi, S.with_(S.QUERIES, S.FILES, "ff AS (SELECT file_id AS doc_id, rel_path AS a, content AS b FROM fil)", bm25_sql("bm", "qry", "ff", {"a": 1, "b": 1}, 4, (), 1), """
n AS (SELECT query_id, file_id, (ceil(strlen(content)/4) - ceil((least(length('* '||rel_path),220)+32)/4))::BIGINT AS net_tokens, bm.rank AS r FROM bm JOIN fil ON file_id=doc_id)""",
  select="SELECT query_id, file_id, net_tokens, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM n WHERE net_tokens>=700 QUALIFY rank<=2"))

_q("c24_related_items", lambda s, sf: R.related_items(D.items(s, sf), D.item_files(s, sf), D.items(s, sf).select("item_id", "label")), S.with_(S.ITEMS, """
fs AS (SELECT a.item_id AS x, b.item_id AS y, count(*) AS n FROM (SELECT * FROM itf JOIN itm USING (item_id)) a JOIN (SELECT * FROM itf JOIN itm USING (item_id)) b ON a.repo=b.repo AND a.file_id=b.file_id AND a.item_id<>b.item_id GROUP BY 1,2),
sc AS (SELECT a.item_id, b.item_id AS related_id, coalesce(n,0)*4 + CASE WHEN a.label=b.label THEN 2 ELSE 0 END + (a.kind=b.kind)::INT + (a.author=b.author)::INT AS score
  FROM itm a JOIN itm b ON a.repo=b.repo AND a.item_id<>b.item_id LEFT JOIN fs ON x=a.item_id AND y=b.item_id)""", select="""
SELECT item_id, related_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, related_id) AS rank FROM sc WHERE score>0 QUALIFY rank<=6"""))


def _mem(s, sf):
    d = D.documents(s, sf)
    return d.select(F.col("doc_id").alias("memory_id"), F.element_at(F.split("text", "\n"), 1).alias("trigger"),
                    F.element_at(F.array(F.lit("active"), F.lit("retired"), F.lit("deleted")), (F.col("doc_id") % 3 + 1).cast("int")).alias("status"))


_q("c25_rank_memories", lambda s, sf: R.rank_memories(D.queries(s, sf).select(F.col("query_id").alias("item_id"), "text"), _mem(s, sf)), S.with_(S.QUERIES, """
m AS (SELECT doc_id AS memory_id, lower(string_split(text,chr(10))[1]) AS trig, (['active','retired','deleted'])[(doc_id%3+1)::INT] AS status FROM documents),
w AS (SELECT memory_id, status, list_filter(string_split_regex(trig,'\\s+'), lambda x: length(x)>=4) AS ws FROM m WHERE status<>'deleted' AND trig<>''),
u AS (SELECT memory_id, unnest(ws) AS word FROM w),
v AS (SELECT word, query_id FROM (SELECT DISTINCT word FROM u) JOIN qry ON contains(lower(text), word)),
n AS (SELECT query_id, memory_id, count(*) AS n FROM u JOIN v USING (word) GROUP BY 1,2),
s AS (SELECT q.query_id AS item_id, w.memory_id, coalesce(n.n,0) + CASE WHEN status='active' THEN 0.5 ELSE 0 END AS score FROM qry q CROSS JOIN w LEFT JOIN n ON n.query_id=q.query_id AND n.memory_id=w.memory_id)""", select="""
SELECT item_id, memory_id, score::DOUBLE AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, memory_id) AS rank FROM s WHERE score>0 QUALIFY rank<=5"""))


def _needles(s, sf):
    """Needles of one to nine words out of the queries."""
    q = D.queries(s, sf)
    return q.select("query_id", F.array_join(F.slice(F.split("text", " "), 2, (F.col("query_id") % 9 + 1).cast("int")), " ").alias("text"))


_q("c26_like_search", lambda s, sf: R.like_search(_needles(s, sf), D.traces(s, sf), 10), S.with_(S.QUERIES, S.TRACES, """
n AS (SELECT query_id, lower(array_to_string(string_split(text,' ')[2:(2+query_id%9)],' ')) AS needle FROM qry)""", select="""
SELECT query_id, trace_id, round(q_score,6) AS q_score, row_number() OVER (PARTITION BY query_id ORDER BY q_score DESC, trace_id) AS rank
FROM n JOIN tr ON contains(lower(description), needle) WHERE needle<>'' QUALIFY rank<=10"""))


def _tasks(s, sf):
    i = F.col("trace_id")
    return D.traces(s, sf).select(i.alias("task_id"), "language", "framework", F.when(i % 2 == 0, F.col("error_type")).alias("error_type"),
                                  F.when(i % 3 == 0, F.array(F.concat(F.lit("api"), (i % 5).cast("string")))).otherwise(F.array().cast("array<string>")).alias("apis"))


def _origin_blocks(s, sf):
    return D.blocks(s, sf).select("block_id", F.col("n").alias("origin_task"), "language", "framework", F.when(F.col("n") % 2 == 1, "oom").alias("error_type"), "apis")


_q("c27_heldout_match", lambda s, sf: R.heldout_match(_tasks(s, sf), _origin_blocks(s, sf)), S.with_(S.TRACES, S.BLOCKS, """
t AS (SELECT trace_id AS task_id, language, framework, CASE WHEN trace_id%2=0 THEN error_type END AS error_type, CASE WHEN trace_id%3=0 THEN ['api'||(trace_id%5)] ELSE []::VARCHAR[] END AS apis FROM tr),
b AS (SELECT block_id, n, language, framework, CASE WHEN n%2=1 THEN 'oom' END AS error_type, apis FROM blk)""", select="""
SELECT block_id, min(task_id) AS task_id FROM b JOIN t ON task_id<>n AND (b.language IS NULL OR t.language IS NULL OR b.language=t.language)
  AND (b.framework IS NULL OR t.framework IS NULL OR b.framework=t.framework) AND (b.error_type IS NULL OR t.error_type IS NULL OR b.error_type=t.error_type)
  AND (len(b.apis)=0 OR len(t.apis)=0 OR list_has_any(b.apis,t.apis)) GROUP BY 1"""))
