"""Ranking a table of queries against a table of memories (C operators).

Joins are equi-joins on terms, hashes or patterns, top-k is limited before its
exchange (``common.top_k``), and nothing is broadcast that was not counted and
found small (by ``postings.few``, or by the optimizer).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlens import fixed_values as V
from memlens.common import clamp01, count_if, ratio, top_k
from memlens.functions import scores
from memlens.functions import text as T
from memlens.operators import grams as G
from memlens.operators import postings as P
from memlens.operators import sketches as SK
from memlens.session import cut

# --- C1 BM25 ------------------------------------------------------------------------


def query_terms(queries: DataFrame, form: str = "trace") -> DataFrame:
    """(query_id, term, n_terms, need_all).  Up to three words must all match; more may match any.

    ``form``: ``trace`` keeps every word, ``block`` drops stop words and single
    letters unless nothing would remain, ``file`` drops single letters.
    """
    terms = F.array_distinct(T.index_terms(F.col("text")))
    if form == "block":
        kept = F.filter(F.array_except(terms, T.literal_array(V.SEARCH_STOP_WORDS)), lambda t: F.length(t) > 1)
        terms = T.let(F.struct(terms.alias("all"), kept.alias("kept")), lambda x: F.when(F.size(x["kept"]) > 0, x["kept"]).otherwise(x["all"]))
    elif form == "file":
        terms = F.filter(terms, lambda t: F.length(t) > 1)
    q = queries.select("query_id", terms.alias("_t"))
    return q.select("query_id", F.size("_t").alias("n_terms"), (F.size("_t") <= 3).alias("need_all"), F.explode("_t").alias("term"))


def bm25_scores(terms: DataFrame, docs: DataFrame, weights: dict[str, float], k: int,
                keep: Callable[[DataFrame], DataFrame] | None = None, index: P.Postings | None = None) -> DataFrame:
    """(query_id, doc_id, bm25, rank): the exact best ``k`` per query among pairs ``keep`` lets through.

    ``index``: stored postings of the same documents and weights; without it, postings of the asked terms are built.
    """
    return P.search(terms, index or P.build(docs, weights, terms), k, keep)


def bm25_search(queries: DataFrame, docs: DataFrame, weights: dict[str, float], k: int, form: str = "trace", index: P.Postings | None = None) -> DataFrame:
    return bm25_scores(query_terms(queries, form), docs, weights, k, index=index)


def asked_once(queries: DataFrame, fields: list[str], recall: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``recall`` of the first query per distinct ``fields`` (nulls equal), its rows given to all queries alike.  ``recall`` may read
    ``query_id`` and these fields only, and gives rows with a ``query_id``."""
    first = queries.groupBy(*fields).agg(F.min("query_id").alias("_first"))
    alike = [F.col(f"q.{c}").eqNullSafe(F.col(f"f.{c}")) for c in fields]
    same = queries.alias("q").join(first.alias("f"), reduce(and_, alike)).select("q.query_id", "_first")
    found = recall(cut(first.select(F.col("_first").alias("query_id"), *fields))).withColumnRenamed("query_id", "_first")
    return same.join(found, "_first").drop("_first")


# --- C2, C3, C8, C26 --------------------------------------------------------------------


def fingerprint_match(queries: DataFrame, traces: DataFrame, k: int = 5) -> DataFrame:
    """Best ``k`` traces of the query's fingerprint by quality.  Traces are cut to ``k`` per fingerprint before queries join, so
    however many copies share one, a query meets ``k`` rows.  A null fingerprint matches nothing."""
    order = [F.desc("q_score"), F.asc("trace_id")]
    best = top_k(traces.where("fingerprint IS NOT NULL").select("trace_id", "fingerprint", "q_score"), ["fingerprint"], order, k).drop("rank")
    hit = queries.select("query_id", "fingerprint").join(best, "fingerprint")
    return top_k(hit, ["query_id"], order, k).select("query_id", "trace_id", "q_score", F.lit(1.0).alias("score"), "rank")


PATTERN = ("language", "framework", "error_type")
_NONE = "\0any"


def pattern_rows(queries: DataFrame) -> DataFrame:
    """Query pattern columns with a mark for absent ones."""
    return queries.select("query_id", *[F.coalesce(c, F.lit(_NONE)).alias(c) for c in PATTERN])


def _generalise(rows: DataFrame) -> DataFrame:
    """Each row once per subset of its pattern columns replaced by the mark: an equi-join key for null-tolerant filters."""
    for c in PATTERN:
        rows = rows.withColumn(c, F.explode(F.array_distinct(F.array(F.coalesce(c, F.lit(_NONE)), F.lit(_NONE)))))
    return rows


def count_eligible(queries: DataFrame, traces: DataFrame) -> DataFrame:
    """Traces that a query's language/framework/error filter lets through."""
    counts = _generalise(traces.groupBy(*PATTERN).agg(F.count("*").alias("n"))).groupBy(*PATTERN).agg(F.sum("n").alias("eligible"))
    return pattern_rows(queries).join(counts, list(PATTERN), "left").select("query_id", F.coalesce("eligible", F.lit(0)).alias("eligible"))


def candidate_filter(queries: DataFrame, traces: DataFrame, k: int) -> DataFrame:
    """Best ``k`` traces by quality per query passing its filter; only queries with some filter.

    Traces are cut to ``k`` per distinct pattern, then per generalised pattern,
    before queries join, so a pattern shared by most traces stays small.
    """
    order = [F.desc("q_score"), F.asc("trace_id")]
    slim = traces.select("trace_id", "q_score", *[F.coalesce(c, F.lit(_NONE)).alias(c) for c in PATTERN])
    per = _generalise(top_k(slim, list(PATTERN), order, k).drop("rank"))
    per = top_k(per, list(PATTERN), order, k)
    asked = pattern_rows(queries).where(" OR ".join(f"{c} <> '{_NONE}'" for c in PATTERN))
    return asked.join(per, list(PATTERN)).select("query_id", "trace_id", "q_score", "rank")


def damped_weights(eligible: Column, weights: dict[str, Column | float] = V.DEFAULT_WEIGHTS) -> dict[str, Column]:
    """Lexical weight shrinks with n/20 on a small corpus; the freed share goes to the other signals."""
    w = {s: (v if isinstance(v, Column) else F.lit(float(v))) for s, v in weights.items()}
    damp = F.least(F.lit(1.0), eligible / F.lit(float(V.DAMPING_FLOOR)))
    others = w["jaccard"] + w["structural"] + w["cosine"] + w["freshness"]
    share = F.when(others == 0, F.lit(0.0)).otherwise(w["bm25"] * (1 - damp) / others)
    return {s: (w[s] * damp if s == "bm25" else w[s] * (1 + share)) for s in V.SIGNALS}


def like_search(queries: DataFrame, traces: DataFrame, k: int | None, gram: int = 12) -> DataFrame:
    """Traces whose text contains the query text, best quality first; ``k=None`` gives all of them without a rank.

    A query of three or more words has whole inner words, which the text must hold in this order: the rarest two that
    follow each other (of three words the middle one) are the join key.  A shorter query's longest word (or the query itself
    when it has none) lies inside one word (or one run of other signs) of the text; it is looked up in the distinct words first.
    """
    seps = lambda c: F.array_remove(F.split(c, r"[\p{L}\p{N}]+"), "")
    q = cut(queries.where("text <> ''").select("query_id", F.lower("text").alias("needle")).withColumn("_t", T.index_terms(F.col("needle"))))
    t = traces.select("trace_id", F.lower("description").alias("hay"))
    later = lambda c, at: F.slice(c, at, F.greatest(F.size(c) - 1, F.lit(0)))
    pairs = lambda c: F.zip_with(later(c, 1), later(c, 2), lambda x, y: F.xxhash64(x, y))
    alone = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    inside = F.slice("_t", 2, F.size("_t") - 2)
    keys = F.when(F.size("_t") > 3, pairs(inside)).otherwise(alone(inside))
    inner = cut(q.where(F.size("_t") > 2).select("query_id", F.explode(keys).alias("key")).distinct())
    words = T.index_terms(F.col("hay"))
    every = pairs(words) if q.where(F.size("_t") == 3).isEmpty() else T.let(words, lambda w: F.concat(pairs(w), alone(w)))
    held = cut(t.select("trace_id", F.explode(F.array_distinct(every)).alias("key")).join(P.few(cut(inner.select("key").distinct())), "key"))
    df = held.groupBy("key").agg(F.count("*").alias("df"))
    rarest = inner.join(df, "key").groupBy("query_id").agg(F.min(F.struct("df", "key")).alias("m")).select("query_id", F.col("m.key").alias("key"))
    cand = rarest.join(held, "key").select("query_id", "trace_id")
    longest = F.array_max(F.transform("_t", lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"]
    short = q.where(F.size("_t") <= 2).select("query_id", F.coalesce(longest, F.col("needle")).alias("part")).withColumn("head", F.substring("part", 1, gram)).withColumn("g", F.length("head"))
    if not short.isEmpty():
        tokens = t.select("trace_id", F.explode(F.array_distinct(F.concat(words, seps(F.col("hay"))))).alias("tok"))
        lens = short.agg(F.sort_array(F.collect_set("g")).alias("l")).select("l").scalar()  # at most `gram` values
        vocab = tokens.select("tok").distinct().withColumn("g", F.explode(lens)).where(F.length("tok") >= F.col("g"))
        windows = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("tok") - F.col("g") + 1), lambda i: F.substring(F.col("tok"), i, F.col("g"))))
        within = vocab.select("tok", F.explode(windows).alias("head")).join(short, "head").where(F.contains("tok", "part")).select("query_id", "tok")
        cand = cand.unionByName(within.join(tokens, "tok").select("query_id", "trace_id"))
    cand = P.few(cut(cand.distinct()))
    hits = t.join(cand, "trace_id").join(P.few(q.select("query_id", "needle")), "query_id").where(F.contains("hay", "needle")).select("query_id", "trace_id")
    if k is None:
        return hits
    return top_k(hits.join(traces.select("trace_id", "q_score"), "trace_id"), ["query_id"], [F.desc("q_score"), F.asc("trace_id")], k)


# --- C4..C7 -------------------------------------------------------------------------------


def keyed_sets(rows: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(id, set_id, tokens) of every row, checkpointed: texts are cut into words once.  Equal token sets have equal ``set_id``."""
    keyed = rows.select(id_col, F.array_sort(tokens).alias("tokens"))
    return cut(keyed.select(id_col, F.sha2(F.array_join("tokens", " "), 256).alias("set_id"), "tokens"))


def token_sets(rows: DataFrame, id_col: str, tokens: Column) -> tuple[DataFrame, DataFrame]:
    """Equal token sets once: (set_id, tokens, copies) and (id, set_id).  Copies then pair as one set."""
    keyed = keyed_sets(rows, id_col, tokens)
    sets = keyed.groupBy("set_id").agg(F.first("tokens").alias("tokens"), F.count("*").alias("copies")).where(F.size("tokens") > 0)
    return sets, keyed.select(id_col, "set_id")


def set_members(keyed: DataFrame, id_col: str) -> DataFrame:
    """(id, set_id, n) of every row, n the size of its set: checkpointed, since a reader of ``keyed`` reads all tokens."""
    return cut(keyed.select(id_col, "set_id", F.size("tokens").alias("n")))


def set_copies(members: DataFrame) -> DataFrame:
    """(set_id, copies) of sets with tokens."""
    return members.where("n > 0").groupBy("set_id").agg(F.count("*").alias("copies"))


def jaccard_within(rows: DataFrame, threshold: float) -> DataFrame:
    """C5 inside one table: ``rows(id, tokens)`` -> (a_id, b_id, similarity) with a_id < b_id, copies included."""
    keyed = keyed_sets(rows, "id", F.col("tokens"))
    near = SK.similar(keyed, keyed, threshold, same=True)
    members = set_members(keyed, "id")
    copies = set_copies(members).where("copies > 1").select(F.col("set_id").alias("l_set"), F.col("set_id").alias("r_set"), F.lit(1.0).alias("similarity"))
    m = lambda p: members.select(F.col("id").alias(f"{p}_id"), F.col("set_id").alias(f"{p}_set"))
    out = near.unionByName(copies).join(m("l"), "l_set").join(m("r"), "r_set").where((F.col("l_set") != F.col("r_set")) | (F.col("l_id") < F.col("r_id")))
    return out.select(F.least("l_id", "r_id").alias("a_id"), F.greatest("l_id", "r_id").alias("b_id"), F.round("similarity", 6).alias("similarity"))


def jaccard_pairs(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """``a(a_id, tokens)`` and ``b(b_id, tokens)`` -> pairs at or above the threshold."""
    ka, kb = keyed_sets(a, "a_id", F.col("tokens")), keyed_sets(b, "b_id", F.col("tokens"))
    m = lambda d, i, p: d.select(i, F.col("set_id").alias(f"{p}_set"))
    return (SK.similar(ka, kb, threshold, same=False).join(m(ka, "a_id", "l"), "l_set").join(m(kb, "b_id", "r"), "r_set")
            .select("a_id", "b_id", F.round("similarity", 6).alias("similarity")))


def structural(a: str = "qf", b: str = "tf", weights: dict[str, float] = V.STRUCTURAL_WEIGHTS, custom: tuple[Column, Column] | None = None) -> Column:
    """C6 between two feature structs; a feature counts only when one side has it.

    ``custom``: two maps of named features; each name that either side fills weighs ``weights[name]``, or ``weights["custom"]``.
    """
    score, most = F.lit(0.0), F.lit(0.0)
    for f in ("error_type", "language", "framework", "file_extension"):
        x, y, w = F.col(f"{a}.{f}"), F.col(f"{b}.{f}"), F.lit(weights[f])
        most = most + F.when(x.isNotNull() | y.isNotNull(), w).otherwise(0.0)
        score = score + F.when(x == y, w).otherwise(0.0)
    kx, ky, w = F.col(f"{a}.keywords"), F.col(f"{b}.keywords"), F.lit(weights["keywords"])
    both = (F.size(kx) > 0) & (F.size(ky) > 0)
    most = most + F.when(both, w).otherwise(0.0)
    score = score + F.when(both, w * T.jaccard(kx, ky)).otherwise(0.0)
    if custom is not None:
        x, y = (F.coalesce(c, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))) for c in custom)
        filled = lambda m: F.map_filter(m, lambda k, v: F.coalesce(v, F.lit("")) != "")
        own = {n: w for n, w in weights.items() if n not in V.STRUCTURAL_WEIGHTS}
        weight = lambda n: T.lookup(n, {k: str(w) for k, w in own.items()}, F.lit(str(weights["custom"]))).cast("double") if own else F.lit(weights["custom"])
        names = F.array_union(F.map_keys(filled(x)), F.map_keys(filled(y)))
        total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, n: s + weight(n))
        most = most + total(names)
        score = score + total(F.filter(names, lambda n: F.coalesce(F.try_element_at(x, n) == F.try_element_at(y, n), F.lit(False))))
    return F.when(most == 0, F.lit(0.0)).otherwise(score / most)


# --- C9, C10 ------------------------------------------------------------------------------------


def exact_matches(queries: DataFrame, traces: DataFrame, k: int, enrich: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """C2 where fingerprints are not stored: equal fingerprints have equal keywords, so a hash of these proposes and only proposed
    traces are enriched."""
    if enrich is None:
        return fingerprint_match(queries, traces, k)
    key = lambda tokens: F.xxhash64(F.array_join(F.array_sort(F.filter(tokens, lambda t: F.length(t) > 2)), "|"))
    asked = queries.select("query_id", "fingerprint", key(F.col("tokens")).alias("_key"))
    near = traces.withColumn("_key", key(T.tokenize(F.col("description")))).join(asked.select("_key").distinct(), "_key", "left_semi")
    return fingerprint_match(queries, enrich(near.drop("_key")), k)


def hybrid_rank(queries: DataFrame, traces: DataFrame, now_ms: int, k: int = 5, weights: dict[str, float] = V.DEFAULT_WEIGHTS,
                cosine: DataFrame | None = None, query_weights: DataFrame | None = None, min_score: float = V.MIN_SCORE,
                normalization: str = "query-level", index_weights: dict[str, float] = V.TRACE_INDEX_WEIGHTS,
                enrich: Callable[[DataFrame], DataFrame] | None = None, index: P.Postings | None = None) -> DataFrame:
    """Candidates from exact hash, BM25 and filter (each bounded per query), rescored and ranked.

    ``queries`` carry ``features`` (struct), ``tokens`` and ``fingerprint``.  Traces carry them too, or ``enrich`` adds them: then
    candidates are found on ids, words and filter columns first, and only their texts are analysed.  BM25 is over the columns of
    ``index_weights``; ``query_weights`` may give one column per signal and query (see F5).
    """
    fetch = k * V.CANDIDATE_MULTIPLIER
    exact = exact_matches(queries, traces, k, enrich).select("query_id", "trace_id", F.lit(True).alias("exact"), F.lit(None).cast("double").alias("raw"))
    docs = traces.select(F.col("trace_id").alias("doc_id"), *index_weights)
    lex = bm25_search(queries, docs, index_weights, fetch, index=index).select("query_id", F.col("doc_id").alias("trace_id"), F.lit(False).alias("exact"), F.col("bm25").alias("raw"))
    filt = candidate_filter(queries, traces, fetch).select("query_id", "trace_id", F.lit(False).alias("exact"), F.lit(None).cast("double").alias("raw"))
    cand = cut(exact.unionByName(lex).unionByName(filt).groupBy("query_id", "trace_id").agg(F.max("exact").alias("exact"), F.max("raw").alias("raw")))
    if enrich is not None:
        traces_of = enrich(traces.join(cand.select("trace_id").distinct(), "trace_id", "left_semi"))
    else:
        traces_of = traces
    if normalization == "saturation":
        cand = cand.withColumn("bm25", F.coalesce(F.col("raw") / (F.col("raw") + V.SATURATION_K), F.lit(0.0)))
    else:
        # A query has at most k + 2 * fetch candidates, so this window is over a bounded group.
        top = F.max("raw").over(W.partitionBy("query_id"))
        cand = cand.withColumn("bm25", F.coalesce(ratio(F.col("raw"), top), F.lit(0.0)))
    q = queries.select("query_id", F.col("features").alias("qf"), F.col("tokens").alias("qt"))
    t = traces_of.select("trace_id", F.col("features").alias("tf"), F.col("tokens").alias("tt"), "created_at", "q_score")
    s = cand.join(q, "query_id").join(t, "trace_id").join(count_eligible(queries, traces), "query_id")
    if cosine is not None:
        s = s.join(cosine.select("query_id", "trace_id", F.col("cosine").alias("_cos")), ["query_id", "trace_id"], "left")
    s = (s.withColumn("cosine", F.coalesce("_cos", F.lit(0.0)) if cosine is not None else F.lit(0.0))
         .withColumn("jaccard", T.jaccard(F.col("qt"), F.col("tt"))).withColumn("structural", structural())
         .withColumn("freshness", scores.freshness(F.lit(now_ms) - F.col("created_at"))))
    w: dict[str, Column | float] = dict(weights)
    if query_weights is not None:
        s = s.join(query_weights.select("query_id", *[F.col(x).alias(f"_w_{x}") for x in V.SIGNALS]), "query_id")
        w = {x: F.col(f"_w_{x}") for x in V.SIGNALS}
    damped = damped_weights(F.col("eligible"), w)
    for name, col in damped.items():
        s = s.withColumn(f"w_{name}", col)
    base = sum((F.col(x) * F.col(f"w_{x}") for x in V.SIGNALS), F.lit(0.0))
    s = s.withColumn("base", F.when(F.col("exact"), F.lit(1.0)).otherwise(base))
    label = F.when(F.col("exact"), "exact").when(F.col("base") > V.SIMILAR_THRESHOLD, "similar").otherwise("related")
    span = V.QUALITY_MULT_MAX - V.QUALITY_MULT_MIN
    s = s.withColumn("match_type", label).withColumn("score", F.round(clamp01(F.col("base") * (V.QUALITY_MULT_MIN + span * F.col("q_score"))), 6))
    return top_k(s.where(F.col("score") >= min_score), ["query_id"], [F.desc("score"), F.asc("trace_id")], k).select(
        "query_id", "trace_id", "rank", "score", "match_type", *V.SIGNALS, *[f"w_{x}" for x in V.SIGNALS])


def explain_scores(ranked: DataFrame) -> DataFrame:
    """One row per hit and signal with value, weight and their product."""
    parts = F.array(*[F.struct(F.lit(x).alias("signal"), F.col(x).alias("value"), F.col(f"w_{x}").alias("weight")) for x in V.SIGNALS])
    return ranked.select("query_id", "trace_id", F.explode(parts).alias("p")).select(
        "query_id", "trace_id", "p.signal", "p.value", "p.weight", (F.col("p.value") * F.col("p.weight")).alias("contribution"))


# --- C11..C14 ----------------------------------------------------------------------------------------


BLOCK_INDEX_WEIGHTS = {"text": 2.0, "kw": 1.0}


def _block_docs(blocks: DataFrame) -> DataFrame:
    return blocks.select(F.col("block_id").alias("doc_id"), F.col("mechanism").alias("text"), F.array_join("keywords", " ").alias("kw"))


def block_index(blocks: DataFrame) -> P.Postings:
    """Postings of all blocks, to be stored and searched many times (``block_recall(..., index=...)``)."""
    return P.build(_block_docs(blocks), BLOCK_INDEX_WEIGHTS)


def block_counts(blocks: DataFrame) -> DataFrame:
    """Word counts of all blocks, to be stored; ``postings.build_counted`` makes the postings of asked words from them."""
    return P.counts(_block_docs(blocks), BLOCK_INDEX_WEIGHTS)


def block_recall(queries: DataFrame, blocks: DataFrame, k: int, index: P.Postings | None = None) -> DataFrame:
    """Active blocks compatible with the query's invariants and APIs, BM25 score over the query's best.

    Filters run before the top-k, so nothing is lost to over-fetching.
    """
    q = queries.select("query_id", F.col("language").alias("ql"), F.col("framework").alias("qw"), F.col("apis").alias("qa"))
    b = blocks.select(F.col("block_id").alias("doc_id"), "status", "language", "framework", "apis")
    same = lambda x, y: F.col(x).isNull() | F.col(y).isNull() | (F.col(x) == F.col(y))

    def keep(hits: DataFrame) -> DataFrame:
        j = hits.join(b.where("status = 'active'"), "doc_id").join(q, "query_id")
        api = (F.size("qa") == 0) | (F.size("apis") == 0) | F.arrays_overlap("qa", "apis")
        return j.where(same("language", "ql") & same("framework", "qw") & api).select("query_id", "doc_id", "bm25")

    hits = bm25_scores(query_terms(queries, "block"), _block_docs(blocks), BLOCK_INDEX_WEIGHTS, k, keep, index)
    top = F.max("bm25").over(W.partitionBy("query_id"))  # over the k rows kept
    return hits.select("query_id", F.col("doc_id").alias("block_id"), "rank", "bm25", F.round(clamp01(ratio(F.col("bm25"), top)), 6).alias("score"))


def fact_search(queries: DataFrame, facts: DataFrame, k: int, use_text: bool = True) -> DataFrame:
    """Active facts visible from the query's scope and compatible with its language.

    With text: best ``k`` by BM25; without: by confidence, then latest check.
    The kept ones are then listed by scope specificity, stable within it.
    """
    q = queries.select("query_id", F.col("language").alias("ql"), F.explode(T.expand_scope(F.col("scope"))).alias("scope"))
    f = facts.where("status = 'active'").select("fact_id", "scope", F.col("language").alias("fl"), "confidence", "verified_at")
    fits = F.col("ql").isNull() | F.col("fl").isNull() | (F.col("ql") == F.col("fl"))
    if use_text:
        keep = lambda hits: (hits.join(f.withColumnRenamed("fact_id", "doc_id"), "doc_id").join(q, ["query_id", "scope"]).where(fits)
                             .select("query_id", "doc_id", "bm25"))
        docs = facts.select(F.col("fact_id").alias("doc_id"), F.col("statement").alias("text"))
        best = bm25_scores(query_terms(queries, "trace"), docs, {"text": 1.0}, k, keep).withColumnRenamed("doc_id", "fact_id")
        best = best.join(facts.select("fact_id", "scope"), "fact_id")
    else:
        # Facts are limited per (scope, language) before the queries join them.
        order = [F.desc("confidence"), F.desc("verified_at"), F.asc("fact_id")]
        slim = top_k(f, ["scope", "fl"], order, k).drop("rank")
        best = top_k(slim.join(q, "scope").where(fits), ["query_id"], order, k)
    final = W.partitionBy("query_id").orderBy(F.desc(T.scope_specificity(F.col("scope"))), "rank")
    return best.select("query_id", "fact_id", "scope", F.row_number().over(final).alias("rank"))


def file_recall(queries: DataFrame, files: DataFrame, k: int = 3) -> DataFrame:
    """BM25 over summary and symbols; ``files`` has one row per path; at most ten."""
    docs = files.select(F.col("file_id").alias("doc_id"), F.col("summary").alias("a"), F.col("symbols").alias("b"))
    asked = queries.where(F.length(T.trim_ws(F.col("text"))) >= 4)
    return bm25_scores(query_terms(asked, "file"), docs, {"a": 1.0, "b": 1.0}, min(max(1, k), 10)).withColumnRenamed("doc_id", "file_id")


def chunk_tokens(text: Column) -> Column:
    spaced = F.regexp_replace(F.lower(text), r"""[*?\[\]()\\^$+|.{}/#'"`_\-\s]+""", " ")
    return F.array_except(F.filter(F.split(F.trim(spaced), " "), lambda t: F.length(t) >= 2), T.literal_array(V.CHUNK_STOP_WORDS))


def chunk_recall(prompts: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """Chunks of the prompt's own session by token overlap, newest first on ties and without words; in turn order.

    Overlap is counted over an equi-join on (session, token), which spreads a long
    session over its words; places no overlapping chunk fills go to the session's
    newest chunks, of which at most ``k`` per session are needed.
    """
    newest = [F.desc("score"), F.desc("chunk_end"), F.desc("chunk_start")]
    p = prompts.select("query_id", "session_id", chunk_tokens(F.col("text")).alias("t"))
    c = chunks.select("session_id", "chunk_start", "chunk_end", chunk_tokens(F.col("summary")).alias("t"))
    pt = p.select("query_id", "session_id", F.size("t").alias("pn"), F.explode("t").alias("tok"))
    ct = c.select("session_id", "chunk_start", "chunk_end", F.size("t").alias("cn"), F.explode("t").alias("tok"))
    keys = ["query_id", "session_id", "chunk_start", "chunk_end"]
    over = pt.join(ct, ["session_id", "tok"]).groupBy(*keys, "pn", "cn").agg(F.count("*").alias("n"))
    hits = top_k(over.select(*keys, F.round(F.col("n") / (F.col("pn") + F.col("cn") - F.col("n")), 6).alias("score")), ["query_id"], newest, k).drop("rank")
    # 2k newest: up to k of them may already be in the hits.
    late = top_k(c.select("session_id", "chunk_start", "chunk_end", F.lit(0.0).alias("score")), ["session_id"], newest, 2 * k).drop("rank")
    short = p.select("query_id", "session_id").join(hits.groupBy("query_id").agg(F.count("*").alias("got")), "query_id", "left").where(F.coalesce("got", F.lit(0)) < k)
    fill = short.select("query_id", "session_id").join(late, "session_id").select(*keys, "score").join(hits, keys, "left_anti")
    best = top_k(hits.unionByName(fill), ["query_id"], newest, k)
    return best.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("chunk_start"))).drop("rank")


# --- C15, C16 ------------------------------------------------------------------------------------------


def apply_external_scores(slate: DataFrame, given: DataFrame) -> DataFrame:
    """Re-rank ``slate(query_id, item_id, rank)`` by ``given(query_id, item_id, ext)``.

    A query keeps its order, with the reason, when it has no scores, a wrong
    count, or any score missing or outside [0, 1].
    """
    n_given = given.groupBy("query_id").agg(F.count("*").alias("n_given"))
    one = W.partitionBy("query_id")  # a slate is bounded
    bad = F.col("ext").isNull() | F.isnan("ext") | (F.col("ext") < 0) | (F.col("ext") > 1)
    s = (slate.join(given.withColumn("_given", F.lit(1)), ["query_id", "item_id"], "left").join(n_given, "query_id", "left")
         .withColumn("_n", F.count("*").over(one)).withColumn("_m", F.count("_given").over(one))
         .withColumn("_bad", F.max(F.col("_given").isNotNull() & bad).over(one)))
    s = s.withColumn("reason", F.when(F.col("n_given").isNull(), "null").when((F.col("n_given") != F.col("_n")) | (F.col("_m") != F.col("_n")), "empty")
                     .when(F.col("_bad"), "validation"))
    order = [F.desc(F.when(F.col("reason").isNull(), F.col("ext"))), F.asc("rank")]
    return s.select("query_id", "item_id", F.col("rank").alias("old_rank"), F.row_number().over(one.orderBy(*order)).alias("new_rank"),
                    F.col("reason").isNotNull().alias("fell_back"), "reason")


def slate_similarity(columns: list[str]) -> Callable[[Column, Column], Column]:
    """Cosine (0 at least) of two items whose vectors have one length, else overlap of their words."""
    def of(a: Column, b: Column) -> Column:
        out = T.jaccard(a["_words"], b["_words"]) if "text" in columns else F.lit(0.0)
        if "embedding" in columns:
            both = (F.size(a["_unit"]) > 0) & (F.size(a["_unit"]) == F.size(b["_unit"]))
            out = F.when(both, F.greatest(F.lit(0.0), scores.dot(a["_unit"], b["_unit"]))).otherwise(out)
        return out

    return of


def mmr(slate: DataFrame, k: int, lam: float = V.MMR_LAMBDA, similarity: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Greedy diversity pick per query; ties keep the input rank.

    ``slate(query_id, item_id, rank, relevance, text?, embedding?, ...)`` is what was fetched for a query; it is gathered in one
    array and picked from by an expression, each pick comparing the chosen item with what is left: k * n similarities.
    ``similarity`` takes two item structs with all columns of the slate and gives a number; no Python runs on rows.
    """
    lam = max(0.0, min(1.0, lam))
    similarity = similarity or slate_similarity(slate.columns)
    extra = []
    if "text" in slate.columns:
        spaced = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z0-9_\s]", " ")
        extra.append(F.array_distinct(F.filter(F.split(spaced, r"\s+"), lambda w: F.length(w) >= 2)).alias("_words"))
    if "embedding" in slate.columns:
        extra.append(scores.unit(F.coalesce("embedding", F.array().cast(slate.schema["embedding"].dataType))).alias("_unit"))
    item = F.struct(*slate.columns, *extra)
    q = slate.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", item.alias("item")))).alias("rows"))
    q = q.withColumn("left", F.transform("rows", lambda x, i: F.struct(i.alias("i"), x["item"].alias("item"), F.lit(0.0).alias("nearest"))))

    def pick(acc: Column, _: Column) -> Column:
        gain = lambda x: x["item"]["relevance"].cast("double") * lam - (1 - lam) * x["nearest"]
        ranked = F.transform(acc["left"], lambda x: F.struct(gain(x).alias("gain"), (-x["i"]).alias("first")))
        best = T.let(F.array_max(ranked), lambda m: F.get(F.filter(acc["left"], lambda x: x["i"] == -m["first"]), 0))
        return T.let(best, lambda b: F.when(F.size(acc["left"]) == 0, acc).otherwise(F.struct(
            F.concat(acc["chosen"], F.array(b["item"]["item_id"])).alias("chosen"),
            F.transform(F.filter(acc["left"], lambda x: x["i"] != b["i"]), lambda x: F.struct(
                x["i"].alias("i"), x["item"].alias("item"), F.greatest(x["nearest"], F.coalesce(F.lit(similarity(x["item"], b["item"])), F.lit(0.0))).alias("nearest"))).alias("left"))))

    start = F.struct(F.transform(F.slice("left", 1, 0), lambda x: x["item"]["item_id"]).alias("chosen"), F.col("left"))
    turns = F.slice(F.sequence(F.lit(1), F.lit(max(k, 1))), F.lit(1), F.lit(max(k, 0)))
    q = q.withColumn("chosen", F.aggregate(turns, start, pick, lambda acc: acc["chosen"]))
    return q.select("query_id", F.posexplode("chosen").alias("position", "item_id")).select("query_id", "item_id", (F.col("position") + 1).cast("long").alias("position"))


# --- C17..C20 ---------------------------------------------------------------------------------------------


def gate_and_holdout(hits: DataFrame, gate: Column | float = V.GATE_THRESHOLD, rate: float = 0.0, salt: str = "") -> DataFrame:
    """``hits(query_id, item_id, prob, fingerprint, manual_shadow)`` -> gate and control decision per hit.

    Holdout applies only when something would have been shown.
    """
    gate = gate if isinstance(gate, Column) else F.lit(float(gate))
    slate = W.partitionBy("query_id")  # a query's hits are a bounded slate
    h = (hits.withColumn("_open", F.col("prob") >= gate).withColumn("_would", F.max("_open").over(slate))
         .withColumn("_fp", F.max("fingerprint").over(slate)).withColumn("_manual", F.max("manual_shadow").over(slate)))
    held = ~F.col("_manual") & F.col("_would") & F.col("_fp").isNotNull() & scores.holdout(F.coalesce("_fp", F.lit("")), rate, salt)
    h = h.withColumn("_held", held).withColumn("shadow", F.col("_manual") | F.col("_held"))
    return h.select("query_id", "item_id", "prob", (~F.col("shadow") & F.col("_open")).alias("passes_gate"), "shadow",
                    (~F.col("shadow") & F.col("_would")).alias("should_inject"), F.when(F.col("_held"), F.lit("holdout")).alias("control_reason"))


def drift_augment(queries: DataFrame, windows: DataFrame, fragments: int = V.DRIFT_FRAGMENTS, gate: float = V.GATE_THRESHOLD,
                  drift_gate: float = V.DRIFT_GATE_THRESHOLD) -> DataFrame:
    """``windows(query_id, signal, summaries)`` -> query text plus the latest argument summaries and a halved gate."""
    j = queries.join(windows, "query_id", "left")
    drift = F.coalesce(F.col("signal"), F.lit("none")) != "none"
    recent = F.slice(F.filter(F.reverse("summaries"), lambda s: s != ""), 1, fragments)
    return j.select("query_id", F.when(drift, F.concat_ws(" ", F.nullif(F.trim("text"), F.lit("")), recent)).otherwise(F.col("text")).alias("text"),
                    F.when(drift, F.lit(drift_gate)).otherwise(F.lit(gate)).alias("gate"), F.when(drift, F.size(recent)).otherwise(0).alias("fragments"))


def naive_top1(queries: DataFrame, docs: DataFrame, opening: int = 2) -> DataFrame:
    """Best document by plain word overlap, no gate: (query_id, doc_id, score); a query that shares no word has no row.

    Equal texts are one set.  A query's ``opening`` rarest known words propose sets, and the best Jaccard among these is a floor.  A set
    that reaches a floor f shares at least f of the query's n words, so it holds one of its n - ceil(f * n) + 1 rarest: only
    those propose.  Common words open their lists only where nothing rarer settles the query.
    """
    words = lambda c: T.split_terms(c, "[^a-z0-9]+", 3)
    sets, members = token_sets(docs, "doc_id", words(F.col("text")))
    sets = cut(sets.select("set_id", "tokens"))
    lists = sets.select("set_id", F.explode("tokens").alias("tok"))
    q = queries.select("query_id", F.array_distinct(words(F.col("text"))).alias("asked"))
    tok = q.select("query_id", F.size("asked").alias("qn"), F.explode("asked").alias("tok"))
    df = lists.join(tok.select("tok").distinct(), "tok", "left_semi").groupBy("tok").agg(F.count("*").alias("df"))
    # words that no set holds come first: they use up the words a good set may miss
    known = tok.join(df, "tok", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    by_query = W.partitionBy("query_id").orderBy("df", "tok")
    placed = cut(known.withColumns({"place": F.row_number().over(by_query), "seen": F.sum(F.when(F.col("df") > 0, 1).otherwise(0)).over(by_query)}))

    def scored(opened: DataFrame) -> DataFrame:
        pairs = opened.where("df > 0").select("query_id", "tok").join(lists, "tok").select("query_id", "set_id").distinct()
        both = pairs.join(q, "query_id").join(sets, "set_id")
        shared = F.size(F.array_intersect("asked", "tokens"))
        return both.select("query_id", "set_id", F.round(shared / (F.size("asked") + F.size("tokens") - shared), 6).alias("score"))

    floors = scored(placed.where(F.col("seen") <= opening)).groupBy("query_id").agg(F.max("score").alias("floor"))
    must = F.greatest(F.ceil((F.col("floor") - 1e-6) * F.col("qn") - 1e-9), F.lit(1))  # scores are compared as rounded
    best = scored(placed.join(floors, "query_id").where(F.col("place") <= F.col("qn") - must + 1))
    first = members.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    best = best.join(best.groupBy("query_id").agg(F.max("score").alias("score")), ["query_id", "score"])
    return best.join(first, "set_id").groupBy("query_id", "score").agg(F.min("doc_id").alias("doc_id")).select("query_id", "doc_id", "score")


def retrieval_eval(ranked: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """Per query with judgements: recall@k, nDCG@k, reciprocal rank."""
    rel = qrels.select("query_id", "doc_id").distinct()
    n = rel.groupBy("query_id").agg(F.count("*").alias("expected"))
    hits = ranked.join(rel, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(
        count_if(F.col("rank") <= k).alias("found"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.min("rank").alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("expected", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return n.join(hits, "query_id", "left").select("query_id", z(F.col("found") / F.col("expected")).alias("recall"), z(F.col("dcg") / ideal).alias("ndcg"), z(1 / F.col("first")).alias("rr"))


def retrieval_summary(per_query: DataFrame, recall: float = 0.85, ndcg: float = 0.70, mrr: float = 0.65) -> DataFrame:
    out = per_query.agg(F.count("*").alias("cases"), F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"), F.avg("rr").alias("mrr"))
    return out.withColumn("passed", (F.col("recall") >= recall) & (F.col("ndcg") >= ndcg) & (F.col("mrr") >= mrr))


# --- C21..C23 -----------------------------------------------------------------------------------------------

def serving_plan(profile: str, recovering: bool = False, session: bool = True, token_budget: int | None = None) -> dict:
    """Token budget and item caps of a profile.  While ``recovering`` from a loop some are wider; without a session there are
    no chunks; a requested budget counts up to the profile's own, and ``recall-heavy`` takes it as it is."""
    plan = V.SERVING_PLANS[profile]
    own = plan["recovery_budget" if recovering else "budget"]
    asked = token_budget if token_budget is not None and token_budget > 0 else own
    return {"profile": profile, "budget": asked if profile == "recall-heavy" else min(asked, own), "blocks": plan["recovery_blocks" if recovering else "blocks"],
            "facts": plan["facts"], "files": plan["files"], "chunks": plan["chunks"] if session else 0,
            "min_file_net": plan["min_file_net"], "min_chunk_net": plan["min_chunk_net"]}


def arbitration_scores(cands: DataFrame, profile: str, shadow: bool = False) -> DataFrame:
    """Expected net tokens and the reason each candidate is (not) eligible."""
    pos = lambda c: F.greatest(F.lit(0.0), F.col(c).cast("double"))
    net = clamp01(F.col("prob")) * pos("avoided_tokens") - (pos("injection_tokens") + pos("noise") + pos("freshness"))
    why = (F.when(F.lit(shadow), "holdout").when(F.coalesce("recent", F.lit(False)), "duplicate")
           .when(F.col("prob") < V.CONFIDENCE_FLOOR[profile], "low_confidence")
           .when((F.col("freshness") >= F.col("avoided_tokens")) & (F.col("freshness") > 0), "stale"))
    if profile == "cost-saver":
        why = why.when(F.col("net") <= 0, "low_confidence")
    elif profile == "balanced":
        why = why.when(F.col("net") < V.NEAR_ZERO_FLOOR, "low_confidence")
    return cands.withColumn("net", net).withColumn("reason", why.otherwise("positive_roi"))


def _interleaved(rows: Column) -> Column:
    """Candidates in net order, where the next one of another capability goes before a neighbour of the same capability if it
    gives up at most one token of net."""
    def place(acc: Column, _: Column) -> Column:
        last, head = F.element_at(acc["out"], -1), F.element_at(acc["rest"], 1)
        other = F.get(F.filter(acc["rest"], lambda x: x["capability"] != last["capability"]), 0)

        def put(t: Column) -> Column:
            early = (t["head"]["capability"] == t["last"]["capability"]) & F.coalesce(t["other"]["net"] >= t["head"]["net"] - 1, F.lit(False))
            behind = F.slice(acc["rest"], F.lit(2), F.size(acc["rest"]))
            swapped = F.transform(behind, lambda x: F.when(x["place"] == t["other"]["place"], t["head"]).otherwise(x))
            return F.struct(F.concat(acc["out"], F.array(F.when(early, t["other"]).otherwise(t["head"]))).alias("out"), F.when(early, swapped).otherwise(behind).alias("rest"))

        return T.let(F.struct(last.alias("last"), head.alias("head"), other.alias("other")), put)

    start = F.struct(F.slice(rows, F.lit(1), F.lit(1)).alias("out"), F.slice(rows, F.lit(2), F.size(rows)).alias("rest"))
    turns = F.slice(F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1))), F.lit(1), F.size(rows) - 1)
    return F.aggregate(turns, start, place, lambda acc: acc["out"])


def arbitrate(cands: DataFrame, profile: str, shadow: bool = False, plan: dict | None = None) -> DataFrame:
    """Inject or suppress each candidate of a query: net order, capability interleave, caps, token budget.

    Candidates that a column decides stay rows; a query's eligible ones are gathered in one array, ordered and spent by
    expressions.  ``plan``: see ``serving_plan``; capabilities that it does not name are capped at 0.
    """
    plan = plan or serving_plan(profile)
    caps = [("reasoning_reuse", plan["blocks"]), ("file_memory", plan["files"]), ("context_fold", plan["chunks"]), ("loop_redirect", 1), ("tool_supervision", 1), ("context_pruning", 2**31 - 1)]
    scored = arbitration_scores(cands, profile, shadow)
    kind = F.coalesce(*[F.when(F.col("capability") == name, i) for i, (name, _) in enumerate(caps)], F.lit(-1))
    row = F.struct((-F.col("net")).alias("_loss"), "candidate_id", "capability", "net", "injection_tokens", kind.alias("kind"))
    q = scored.where("reason = 'positive_roi'").groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    q = q.withColumn("rows", F.transform("rows", lambda x, i: F.struct(i.alias("place"), *[x[c].alias(c) for c in ("candidate_id", "capability", "net", "injection_tokens", "kind")])))
    q = q.withColumn("rows", _interleaved(F.col("rows")))
    limits = F.array(*[F.lit(n) for _, n in caps])

    def spend(acc: Column, x: Column) -> Column:
        known = x["kind"] >= 0
        full = ~known | (F.get(acc["used"], x["kind"]) >= F.get(limits, x["kind"]))
        dear = x["injection_tokens"].cast("double") > acc["left"]
        reason = F.when(full, "profile_cap").when(dear, "budget").otherwise("positive_roi")
        return T.let(reason, lambda why: F.struct(
            F.when(why == "positive_roi", acc["left"] - x["injection_tokens"].cast("double")).otherwise(acc["left"]).alias("left"),
            F.transform(acc["used"], lambda n, i: n + F.when((why == "positive_roi") & (i == x["kind"]), 1).otherwise(0)).alias("used"),
            F.concat(acc["reasons"], F.array(why)).alias("reasons")))

    start = F.struct(F.lit(float(plan["budget"])).alias("left"), F.array_repeat(F.lit(0), len(caps)).alias("used"), F.array().cast("array<string>").alias("reasons"))
    q = q.withColumn("reasons", F.aggregate("rows", start, spend, lambda acc: acc["reasons"]))
    decided = q.select("query_id", F.explode(F.arrays_zip("rows", "reasons")).alias("d")).select(
        "query_id", "d.rows.candidate_id", "d.rows.capability", "d.rows.net", F.col("d.reasons").alias("reason"),
        F.when(F.col("d.reasons") == "positive_roi", "inject").otherwise("suppress").alias("action"))
    rest = scored.where("reason <> 'positive_roi'").select("query_id", "candidate_id", "capability", "net", "reason", F.lit("shadow" if shadow else "suppress").alias("action"))
    return decided.unionByName(rest)


PACK_KINDS = ("block", "fact", "file", "chunk")
PACK_CAPS = {"block": 4, "fact": 4, "file": 3, "chunk": 3}
FRAME_CHARS = 120  # fixed headroom of our own frame around the packed lines


def pack_budget(hits: DataFrame, budget_tokens: int = 1200) -> DataFrame:
    """``hits(query_id, kind, item_id, rank, line_chars, shadow)`` -> packed items per query.

    Kinds are packed in order; a kind stops at its first line that does not fit;
    when nothing fits the single first hit stays.  The caps leave at most fourteen
    rows per query, gathered in one short array and walked by an expression.
    """
    h = hits.where(~F.col("shadow")).select("query_id", "kind", "item_id", "line_chars", F.col("rank").alias("_r"))
    h = top_k(h, ["query_id", "kind"], [F.asc("_r")], max(PACK_CAPS.values()), "pos")
    cap = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in PACK_CAPS.items()])
    order = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(PACK_KINDS)])
    row = F.struct(order.alias("o"), "pos", "kind", "item_id", F.col("line_chars").cast("bigint").alias("line_chars"))
    q = h.where(F.col("pos") <= cap).groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    empty = F.slice("rows", 1, 0)
    start = F.struct(F.lit(FRAME_CHARS).cast("bigint").alias("used"), F.lit(-1).alias("stopped"), empty.alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        cost = acc["used"] + x["line_chars"] + 1
        fits = (acc["stopped"] != x["o"]) & (cost <= budget_tokens * 4)
        return F.struct(F.when(fits, cost).otherwise(acc["used"]).alias("used"), F.when(fits, acc["stopped"]).otherwise(x["o"]).alias("stopped"),
                        F.when(fits, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    q = q.withColumn("_w", F.aggregate("rows", start, step))
    kept = F.when(F.size("_w.kept") > 0, F.col("_w.kept")).otherwise(F.slice("rows", 1, 1))
    return q.select("query_id", F.explode(kept).alias("x")).select("query_id", "x.kind", "x.item_id", "x.pos", "x.line_chars")


def pack_summary(packed: DataFrame) -> DataFrame:
    est = lambda k: F.coalesce(F.ceil(F.sum(F.when(F.col("kind") == k, F.col("line_chars") + 1)) / 4), F.lit(0)).alias(f"{k}_tokens")
    ids = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("pos", F.col("item_id").cast("string").alias("id"))))), lambda x: x["id"]), ",").alias(f"{k}_ids")
    return packed.groupBy("query_id").agg(*[ids(k) for k in PACK_KINDS], *[est(k) for k in PACK_KINDS])


def roi_filter(hits: DataFrame, min_net: int, max_items: int, net: Column) -> DataFrame:
    """Hits saving at least ``min_net`` tokens, first ``max_items`` per query in rank order."""
    kept = hits.withColumn("net_tokens", net)
    if min_net > 0:
        kept = kept.where(F.col("net_tokens") >= min_net)
    return top_k(kept.withColumnRenamed("rank", "_r"), ["query_id"], [F.asc("_r")], max_items).drop("_r")


def file_net_tokens(size_bytes: Column, line: Column) -> Column:
    return F.ceil(F.greatest(F.lit(0), size_bytes) / 4) - F.ceil((F.least(F.length(line), F.lit(220)) + 32) / 4)


# --- C24, C25, C27 ----------------------------------------------------------------------------------------------


def _subsets(arr: Column, most: int) -> Column:
    """Every subset of a short array with at most ``most`` members, as sorted arrays."""
    start = F.array(F.array().cast("array<string>"))
    grown = F.aggregate(F.array_sort(arr), start, lambda acc, x: F.concat(
        acc, F.transform(F.filter(acc, lambda s: F.size(s) < most), lambda s: F.concat(s, F.array(x)))))
    return grown


def related_items(items: DataFrame, item_files: DataFrame, item_labels: DataFrame, k: int = 6, hot_items: int = 200) -> DataFrame:
    """4 per shared file, 2 per shared label, 1 same kind, 1 same author, inside one repo; best ``k`` each.

    Never pairs a whole group.  A file in more than ``hot_items`` items of a repo is hot.  For every item at most its two hottest
    hot files become class dimensions; its other files that some item shares open pairs by an equi-join, scored in full.  What is
    left can only match on a class (hot files, labels, kind, author).  Items of equal dimensions have equal class scores, so
    these are found once per combination: everyone in a class scores at least as much as a member matching nothing else, so the
    first ``k`` + 1 ids of each class hold every winner, and the best ``k`` + 1 of a combination hold those of its items.  Classes are
    cut one dimension after the other, so an item is copied only while few like it come before it.
    """
    s_ = lambda c: F.col(c).cast("string")
    place, none = ["repo", "file_id"], F.array().cast("array<string>")
    files = (item_files.select("item_id", "file_id").distinct().join(items.select("item_id", "repo"), "item_id")
             .select("item_id", "repo", s_("file_id").alias("file_id")).repartition("repo", "file_id"))
    df = files.groupBy(*place).agg(F.count("*").alias("df"))
    crowded = files.join(df.where(F.col("df") > hot_items), place)
    hot = crowded.groupBy("item_id").agg(F.array_sort(F.collect_set(F.struct((-F.col("df")).alias("d"), "file_id"))).alias("hot"))
    labels = item_labels.groupBy("item_id").agg(F.array_sort(F.collect_set(s_("label"))).alias("labels"))
    # values are marked, so that none is taken for an open dimension; a null matches nothing
    value = lambda c: F.coalesce(F.concat(F.lit("="), s_(c)), F.lit(""))
    base = items.join(labels, "item_id", "left").join(hot, "item_id", "left").select(
        "item_id", "repo", value("kind").alias("kind"), value("author").alias("author"), F.coalesce("labels", none).alias("labels"),
        F.coalesce(F.transform("hot", lambda h: h["file_id"]), none).alias("hot")).withColumn("top", F.slice("hot", 1, 2))

    shared = files.join(df.where(F.col("df").between(2, hot_items)), place)
    cold = shared.select(*place, F.col("item_id").alias("a_id")).join(shared.select(*place, F.col("item_id").alias("b_id")), place)
    rest = (base.where(F.size("hot") > 2).select(F.col("item_id").alias("a_id"), "repo", F.explode(F.array_except("hot", "top")).alias("file_id"))
            .join(crowded.select(*place, F.col("item_id").alias("b_id")), place))
    pairs = cold.select("a_id", "b_id").unionByName(rest.select("a_id", "b_id")).where(F.col("a_id") != F.col("b_id")).repartition("a_id").groupBy("a_id", "b_id").agg(F.count("*").alias("n"))
    side = lambda p: base.select(F.col("item_id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("labels", "kind", "author", "hot", "top")])
    same = lambda c: F.when((F.col(f"a_{c}") == F.col(f"b_{c}")) & (F.col(f"a_{c}") != ""), 1).otherwise(0)
    score = 4 * (F.col("n") + F.size(F.array_intersect("a_top", "b_hot"))) + 2 * F.size(F.array_intersect("a_labels", "b_labels")) + same("kind") + same("author")
    scored = pairs.join(side("a"), "a_id").join(side("b"), "b_id").select(F.col("a_id").alias("item_id"), F.col("b_id").alias("related_id"), score.cast("int").alias("score"))
    best = top_k(scored, ["item_id"], [F.desc("score"), F.asc("related_id")], k)
    mates = best.groupBy("item_id").agg(F.collect_list(F.struct((-F.col("score")).alias("neg"), "related_id")).alias("mates"))

    key, combination = ["repo", "_h", "_l", "_k", "_a"], ["repo", "top", "labels", "kind", "author"]
    first = lambda d: top_k(d, key, [F.asc("item_id")], k + 1).drop("rank")
    real = (F.col("_k") != "") & (F.col("_a") != "") & ((F.size("_h") > 0) | (F.size("_l") > 0) | (F.col("_k") != "*") | (F.col("_a") != "*"))
    subsets = lambda d, h, l: d.withColumn("_h", F.explode(_subsets(F.col(h), 2))).withColumn("_l", F.explode(_subsets(F.col(l), 64)))
    members = first(base.select("item_id", "repo", F.col("hot").alias("_h"), F.col("labels").alias("_l"), F.col("kind").alias("_k"), F.col("author").alias("_a")))
    for c in ("_a", "_k"):
        members = members.unionByName(first(members.withColumn(c, F.lit("*"))))
    classes = first(subsets(members, "_h", "_l").where(real)).groupBy(*key).agg(F.collect_list("item_id").alias("ids"))
    asked = subsets(base.select(*combination).distinct(), "top", "labels")
    for c, own in (("_k", "kind"), ("_a", "author")):
        asked = asked.withColumn(c, F.explode(F.array(own, F.lit("*"))))
    weight = 4 * F.size("_h") + 2 * F.size("_l") + F.when(F.col("_k") != "*", 1).otherwise(0) + F.when(F.col("_a") != "*", 1).otherwise(0)
    met = asked.where(real).join(classes, key).select(*combination, F.transform("ids", lambda i: F.struct((-weight).alias("neg"), i.alias("related_id"))).alias("found"))
    found = met.groupBy(*combination).agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    ids = F.slice(F.array_distinct(F.transform("found", lambda x: x["related_id"])), 1, k + 1)
    lists = found.select(*combination, F.transform(ids, lambda i: F.filter("found", lambda x: x["related_id"] == i)[0]).alias("list"))

    empty = F.array().cast(mates.schema["mates"].dataType)
    every = base.select("item_id", *combination).join(mates, "item_id", "left").join(lists, combination, "left").select(
        "item_id", F.coalesce("mates", empty).alias("mates"), F.coalesce("list", empty).alias("list"))
    more = F.filter("list", lambda x: (x["related_id"] != F.col("item_id")) & ~F.exists("mates", lambda y: y["related_id"] == x["related_id"]))
    ranked = every.select("item_id", F.posexplode(F.slice(F.array_sort(F.concat("mates", more)), 1, k)).alias("at", "r"))
    return ranked.select("item_id", "r.related_id", (-F.col("r.neg")).alias("score"), (F.col("at") + 1).alias("rank"))


def rank_memories(items: DataFrame, memories: DataFrame, k: int = 5) -> DataFrame:
    """Trigger words (>= 4 characters) contained in the item's text, +0.5 when active; deleted ones are out.

    Words meet texts on positional grams (``grams.contained``): distinct words, rarest gram first, no text beside a gram.
    """
    words = F.filter(F.split(F.lower("trigger"), r"\s+"), lambda t: F.length(t) >= 4)
    m = memories.where("status <> 'deleted'").select("memory_id", F.explode(words).alias("word"))
    m = m.groupBy("memory_id", "word").agg(F.count("*").alias("times"))
    found = G.contained(m, items.select("item_id", F.lower("text").alias("hay")), "item_id", "hay")
    hits = found.join(m, "word").groupBy("item_id", "memory_id").agg(F.sum("times").alias("n"))
    active = memories.where("status <> 'deleted'").select("memory_id", F.when(F.col("status") == "active", 0.5).otherwise(0.0).alias("bonus"))
    scored = hits.join(active, "memory_id").select("item_id", "memory_id", (F.col("n") + F.col("bonus")).alias("score"))
    # An active memory scores 0.5 without any hit; only the first k by id can fill free places.
    spare = top_k(active.where("bonus > 0").join(memories.select("memory_id", "trigger"), "memory_id").where("trigger <> ''").select(F.lit(0).alias("z"), "memory_id"), ["z"], [F.asc("memory_id")], 2 * k)
    lists = spare.agg(F.array_sort(F.collect_list("memory_id")).alias("l")).select("l").scalar()
    best = top_k(scored, ["item_id"], [F.desc("score"), F.asc("memory_id")], k)
    per = best.groupBy("item_id").agg(F.collect_list(F.struct("memory_id", "score")).alias("have"))
    all_ = items.select("item_id").join(per, "item_id", "left").withColumn("_spare", lists)
    have = F.coalesce(F.col("have.memory_id"), F.array().cast(f"array<{dict(memories.dtypes)['memory_id']}>"))
    extra = all_.select("item_id", F.explode(F.array_except("_spare", have)).alias("memory_id")).withColumn("score", F.lit(0.5))
    return top_k(best.select("item_id", "memory_id", "score").unionByName(extra), ["item_id"], [F.desc("score"), F.asc("memory_id")], k)


def heldout_match(tasks: DataFrame, blocks: DataFrame) -> DataFrame:
    """First compatible task per block that is not its origin: (block_id, task_id).

    Compatible = null-tolerant equality of language, framework and error type plus
    API overlap.  Tasks are reduced to their first few per (pattern, apis, origin)
    group; blocks meet them through generalised pattern keys.
    """
    mark = lambda c: F.coalesce(c, F.lit(_NONE))
    apis = lambda c: F.array_sort(F.coalesce(c, F.array().cast("array<string>")))
    # Two rows per group suffice: a block has one origin id, which can exclude at most one of them.
    t = tasks.select("task_id", *[mark(c).alias(c) for c in PATTERN], apis("apis").alias("ta"))
    t = top_k(t, [*PATTERN, "ta"], [F.asc("task_id")], 2).drop("rank")
    b = blocks.select("block_id", "origin_task", apis("apis").alias("ba"), *[mark(c).alias(f"b_{c}") for c in PATTERN])
    for c in PATTERN:  # a null on either side fits everything: match on the pair of null marks
        b = b.withColumn(f"j_{c}", F.explode(F.when(F.col(f"b_{c}") == _NONE, F.array(F.lit("*"))).otherwise(F.array(F.col(f"b_{c}"), F.lit(_NONE)))))
        t = t.withColumn(f"j_{c}", F.explode(F.array(F.col(c), F.lit("*"))))
    j = b.join(t, [f"j_{c}" for c in PATTERN]).where(
        (F.col("task_id") != F.coalesce("origin_task", F.lit(-1))) & ((F.size("ba") == 0) | (F.size("ta") == 0) | F.arrays_overlap("ba", "ta")))
    return j.groupBy("block_id").agg(F.min("task_id").alias("task_id"))
