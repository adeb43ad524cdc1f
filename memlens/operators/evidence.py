"""Evidence that a shown memory was used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlens import fixed_values as V
from memlens.common import with_halo_chunks, with_position
from memlens.functions import text as T
from memlens.operators.grams import gram_places, index
from memlens.session import cut


def evidence_tokens(text):
    return T.split_terms(text, "[^a-z0-9_-]+", 3)


def _similar_uses(injections: DataFrame, shadow: DataFrame, transcripts: DataFrame, blocks: DataFrame, lookback_ms: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Injections, transcripts and similar texts, to be joined on ``run_id``, ``_b`` and the keys of texts.

    Injections and transcripts are first reduced to the distinct texts of a run's time bucket; each pair of texts that meets
    somewhere is compared once, however many injections and transcripts carry it.
    """
    b = lambda c: F.floor(F.col(c) / lookback_ms)
    key = lambda c: F.unhex(F.sha2(F.encode(c, "UTF-8"), 256))
    body, text = F.concat_ws("\n", "unlock", "verification"), F.col("text")
    shown = injections.join(shadow.where(~F.col("shadow")), "query_id", "left_semi").groupBy("query_id", "block_id", "run_id", F.col("ts").alias("i_ts")).agg(F.lit(True))
    inj = shown.join(blocks.select("block_id", key(body).alias("_bk")), "block_id").select("query_id", "block_id", "run_id", "i_ts", b("i_ts").alias("_b"), "_bk")
    tr = transcripts.where(text.isNotNull()).select("transcript_id", "run_id", F.col("ts").alias("t_ts"), F.explode(F.array(b("ts"), b("ts") - 1)).alias("_b"), key(text).alias("_tk"))
    met = (inj.select("run_id", "_b", "_bk").distinct().join(tr.select("run_id", "_b", "_tk").distinct(), ["run_id", "_b"]).select("_bk", "_tk").distinct())
    bt = blocks.select(body.alias("body")).distinct().select(key(F.col("body")).alias("_bk"), evidence_tokens(F.col("body")).alias("bt"))
    tt = transcripts.where(text.isNotNull()).select("text").distinct().select(key(text).alias("_tk"), evidence_tokens(text).alias("tt"))
    similar = met.join(bt, "_bk").join(tt, "_tk").withColumn("score", T.jaccard(F.col("bt"), F.col("tt"))).where(F.col("score") >= threshold).select("_bk", "_tk", "score")
    return inj, tr, cut(similar)


def infer_use(injections: DataFrame, shadow: DataFrame, transcripts: DataFrame, blocks: DataFrame, lookback_ms: int = 90_000,
              threshold: float = V.MODERATE_JACCARD) -> DataFrame:
    """Injected blocks whose unlock and verification words show up in a transcript of the same run soon after.

    ``injections(query_id, block_id, run_id, ts)``, ``shadow(query_id, shadow)``,
    ``transcripts(transcript_id, run_id, ts, text)``.  Runs join on lookback-sized time buckets and on texts known to be similar,
    so a long run is spread out and only pairs of the result meet.
    """
    inj, tr, similar = _similar_uses(injections, shadow, transcripts, blocks, lookback_ms, threshold)
    near = tr.join(similar, "_tk").join(inj, ["run_id", "_b", "_bk"]).where((F.col("i_ts") <= F.col("t_ts")) & (F.col("i_ts") > F.col("t_ts") - lookback_ms))
    return (near.groupBy("transcript_id", "query_id", "block_id").agg(F.min("i_ts").alias("injection_ts"), F.first("score").alias("score"))
            .select("transcript_id", "query_id", "block_id", "injection_ts", "score"))


def inferred_outcomes(uses: DataFrame, outcomes: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Resolved outcomes for credited queries whose transcript says so and that have none yet."""
    ok = transcripts.where(T.resolved_signal(F.col("text"))).select("transcript_id")
    return _unsettled(uses.join(ok, "transcript_id", "left_semi").select("query_id").distinct(), outcomes)


def infer_outcomes(injections: DataFrame, shadow: DataFrame, transcripts: DataFrame, blocks: DataFrame, outcomes: DataFrame, lookback_ms: int = 90_000,
                   threshold: float = V.MODERATE_JACCARD) -> DataFrame:
    """``inferred_outcomes`` of ``infer_use`` without a list of uses: an injection is credited when the next similar transcript of its
    run that says so is near enough, so the work grows with injections and transcripts, not with their pairs."""
    inj, tr, similar = _similar_uses(injections, shadow, transcripts.where(T.resolved_signal(F.col("text"))), blocks, lookback_ms, threshold)
    said = tr.join(similar, "_tk").groupBy("run_id", "_b", "_bk", F.col("t_ts").alias("_at")).agg(F.lit(None).cast(inj.schema["query_id"].dataType).alias("query_id"))
    asked = inj.select("run_id", "_b", "_bk", F.col("i_ts").alias("_at"), "query_id")
    heard = F.min(F.when(F.col("query_id").isNull(), F.col("_at"))).over(W.partitionBy("run_id", "_b", "_bk").orderBy("_at").rangeBetween(0, W.unboundedFollowing))
    credited = asked.unionByName(said).withColumn("_heard", heard).where(F.col("query_id").isNotNull() & (F.col("_at") > F.col("_heard") - lookback_ms))
    return _unsettled(credited.select("query_id").distinct(), outcomes)


def _unsettled(credited: DataFrame, outcomes: DataFrame) -> DataFrame:
    return (credited.join(outcomes.select("query_id"), "query_id", "left_anti")
            .withColumn("resolved", F.lit(True)).withColumn("attribution", F.lit("inferred")))


def norm_path(path):
    return F.lower(F.trim(F.replace(path, F.lit("\\"), F.lit("/"))))


def touched_recalled(edits: DataFrame, recalled: DataFrame) -> DataFrame:
    """Recalled items whose path was edited in the same query."""
    e = edits.select("query_id", norm_path(F.col("path")).alias("p")).distinct()
    return recalled.withColumn("p", norm_path(F.col("path"))).join(e, ["query_id", "p"], "left_semi").select("query_id", "item_id", F.lit("diff_touches_recalled_file").alias("kind"))


def args_match_memory(calls: DataFrame, recalled: DataFrame, n: int = 6) -> DataFrame:
    """Recalled blocks sharing any ``n`` characters with a tool argument of the same query.

    Distinct grams of whole arguments meet distinct grams of block texts: a block's text is cut once, however many queries
    recalled it, and only grams that some argument has are kept.
    """
    distinct = lambda c: F.array_distinct(F.transform(gram_places(c, n), lambda g: g["gram"]))
    asked = calls.select("query_id", F.explode(distinct(F.lower("arg_summary"))).alias("gram")).distinct()
    texts = recalled.select("item_id", F.lower(F.concat_ws("\n", "unlock", "verification")).alias("hay")).distinct()
    held = index(texts, "item_id", "hay", asked, n).select("item_id", "gram").distinct()
    met = recalled.select("query_id", "item_id").distinct().join(asked, "query_id").join(held, ["item_id", "gram"], "left_semi")
    return met.select("query_id", "item_id", F.lit("tool_path_matches_memory").alias("kind")).distinct()


def redirect_followed(obs: DataFrame, redirects: DataFrame) -> DataFrame:
    """Redirects after which the next call of the session differs; ``success`` when that call went well.

    ``obs(event_id, session_id, ts, tool_name, arg_key, ok)``; ``redirects(event_id, anchor_id)``.
    """
    placed = with_halo_chunks(with_position(obs, "session_id", "ts", "event_id"), "pos", 1, ahead=True)
    seq = W.partitionBy("session_id", "_chunk").orderBy("pos")
    nxt = F.lead(F.struct("tool_name", "arg_key", "ok")).over(seq)
    calls = placed.withColumn("n", nxt).where(~F.col("_halo") & F.col("n").isNotNull())
    differs = (F.col("n.tool_name") != F.col("tool_name")) | (F.col("n.arg_key") != F.col("arg_key"))
    return calls.where(differs).join(redirects, "event_id").select("event_id", "session_id", "anchor_id", F.lit("loop_redirect_followed").alias("kind"), F.col("n.ok").alias("success"))
