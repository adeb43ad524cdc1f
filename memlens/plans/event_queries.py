"""Queries over the event log and run tables (E operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlens import fixed_values as V
from memlens.operators import analytics as A
from memlens.operators import usage as U
from memlens.plans import adapters as D
from memlens.plans import sqlbase as S
from memlens.plans.catalog import Query, Registry, rounded
from memlens.session import cut
from memlens.sources import events as EV

QUERIES: Registry = {}


def _q(key, run, sql=None):
    QUERIES[key] = Query(lambda spark, sf: rounded(run(spark, sf)), sql)


def _log(fn, **kw):
    return lambda spark, sf: fn(D.event_log(spark, sf), **kw)


def _sql(*parts, select):
    return S.with_(S.LOG, *parts, select=select)


_q("e1_event_counts", _log(A.event_counts),
   _sql(select="SELECT event, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM log GROUP BY 1"))

_q("e2_retrieval_split", _log(A.retrieval_split), _sql(select="""
SELECT count(DISTINCT query_id) FILTER (NOT shadow) AS treatment, count(DISTINCT query_id) FILTER (shadow) AS shadow,
  count(DISTINCT query_id) FILTER (NOT shadow) + count(DISTINCT query_id) FILTER (shadow) AS total,
  coalesce(sum(injected_tokens),0)::BIGINT AS injected_tokens FROM log WHERE event='retrieval'"""))

_SPLIT = """SELECT {by}count(*) FILTER (NOT in_shadow) AS total_treatment, count(*) FILTER (in_shadow) AS total_shadow,
  count(*) FILTER (NOT in_shadow AND resolved) AS resolved_treatment, count(*) FILTER (in_shadow AND resolved) AS resolved_shadow,
  avg(tokens) FILTER (NOT in_shadow) AS mean_tokens_treatment, avg(tokens) FILTER (in_shadow) AS mean_tokens_shadow,
  avg(duration_ms) FILTER (NOT in_shadow) AS mean_duration_treatment, avg(duration_ms) FILTER (in_shadow) AS mean_duration_shadow,
  count(tokens) FILTER (NOT in_shadow) AS n_tokens_treatment, count(tokens) FILTER (in_shadow) AS n_tokens_shadow,
  count(duration_ms) FILTER (NOT in_shadow) AS n_duration_treatment, count(duration_ms) FILTER (in_shadow) AS n_duration_shadow FROM oarm{group}"""


def _r(*cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


_q("e3_outcome_split", _log(A.outcome_split), _sql(
    S.log_parts(), S.arms(), "s AS (" + _SPLIT.format(by="", group="") + ")",
    select=f"""SELECT total_treatment, total_shadow, resolved_treatment, resolved_shadow,
  {_r('mean_tokens_treatment', 'mean_tokens_shadow', 'mean_duration_treatment', 'mean_duration_shadow')},
  n_tokens_treatment, n_tokens_shadow, n_duration_treatment, n_duration_shadow,
  round(resolved_treatment/nullif(total_treatment,0) - resolved_shadow/nullif(total_shadow,0), 6) AS resolved_lift,
  round(mean_tokens_treatment - mean_tokens_shadow, 6) AS token_lift FROM s"""))

_FUNNEL = ", ".join(f"count(*) FILTER ({f}) AS {f}_runs" for f in
                    ("eligible", "recalled", "injected", "used", "helpful", "verified_helpful"))
_q("e4_funnel", _log(A.funnel), _sql(S.log_parts(), S.flags(), select=f"SELECT {_FUNNEL} FROM qf"))

_q("e5_per_block_stats", _log(A.per_item_stats, item="block"),
   _sql(S.log_parts(), S.item_stats("block"), select="SELECT * FROM st_block"))
_q("e6_per_fact_stats", _log(A.per_item_stats, item="fact"),
   _sql(S.log_parts(), S.item_stats("fact"), select="SELECT * FROM st_fact"))

_RATE = lambda item, p: ", ".join(
    f"(SELECT round(sum({c})::DOUBLE/nullif(sum(injected),0),6) FROM st_{item}) AS {p}{n}" for c, n in
    (("agent_used", "hit_rate"), ("helpful", "helpful_rate"), ("counterproductive", "counterproductive_rate")))
_q("e7_rates", _log(A.rates), _sql(
    S.log_parts(), S.flags(), S.item_stats("block"), S.item_stats("fact"),
    select=f"""SELECT round(coalesce(count(*) FILTER (treated AND injected)::DOUBLE/nullif(count(*) FILTER (treated),0),0.0),6) AS coverage,
  {_RATE('block', '')}, {_RATE('fact', 'fact_')} FROM qf"""))

_CAUSAL = """ca AS (SELECT {by}*, CASE WHEN in_shadow AND control_reason='holdout' THEN 'holdout'
   WHEN NOT in_shadow AND EXISTS (SELECT 1 FROM (SELECT {sel}item_id, query_id FROM inj_b UNION ALL SELECT {sel}item_id, query_id FROM inj_f) x
      WHERE x.query_id=o.query_id{daycond}) THEN 'assisted' END AS arm FROM oarm o)"""
_q("e8_causal_cohorts", _log(A.causal_cohorts), _sql(
    S.log_parts(), S.arms(), _CAUSAL.format(by="", sel="", daycond=""), select="""
SELECT arm, count(*) AS n, count(*) FILTER (resolved) AS resolved, round(avg(tokens),6) AS mean_tokens, round(avg(duration_ms),6) AS mean_duration_ms,
  count(tokens) AS n_tokens, count(duration_ms) AS n_durations FROM ca WHERE arm IS NOT NULL GROUP BY 1"""))

_q("e9_integrity", _log(A.integrity), _sql(S.log_parts(), S.arms(), select="""
SELECT count(*) FILTER (seen AND shadow<>control) AS shadow_control_mismatches, count(*) FILTER (NOT seen) AS outcomes_without_retrieval FROM oarm"""))

_AUC = """rk AS (SELECT *, rank() OVER (PARTITION BY {part} ORDER BY prediction) + (count(*) OVER (PARTITION BY {part}, prediction) - 1)/2.0 AS rnk FROM pts),
cal AS (SELECT {by}count(*) AS scored_injections, avg((prediction-label)*(prediction-label)) AS brier_score,
  CASE WHEN sum(label)>0 AND sum(1-label)>0 THEN (sum(rnk) FILTER (label=1) - sum(label)*(sum(label)+1)/2.0)/(sum(label)*sum(1-label)) END AS auc FROM rk{group})"""
_q("e10_calibration", _log(A.calibration), _sql(
    S.log_parts(), S.POINTS, _AUC.format(part="1", by="", group=""),
    select="SELECT scored_injections, round(brier_score,6) AS brier_score, round(auc::DOUBLE,6) AS auc FROM cal"))

_FILT = """SELECT {by}coalesce(sum(CASE WHEN event='retrieval' AND NOT shadow THEN len(candidates)+coalesce(len(fact_candidates),0) END),0)::BIGINT AS candidates_seen,
  count(*) FILTER (event IN ('injection','fact_injection')) AS candidates_shown, count(*) FILTER (event='calibrator_refit') AS refits,
  max(ts) FILTER (event='calibrator_refit') AS last_refit_ts, count(*) FILTER (event='drift_injection') AS drift_injections FROM log{group}"""
_q("e11_candidate_filtering", _log(A.candidate_filtering), _sql("f AS (" + _FILT.format(by="", group="") + ")", select="""
SELECT *, greatest(0, candidates_seen-candidates_shown) AS candidates_filtered,
  round(greatest(0, candidates_seen-candidates_shown)::DOUBLE/nullif(candidates_seen,0),6) AS candidate_filter_rate FROM f"""))

_c = lambda e: f"count(*) FILTER (event='{e}')"
_s = lambda c, e: f"coalesce(sum({c}) FILTER (event='{e}'),0)::BIGINT"
_q("e12_mechanism_totals", lambda s, sf: A.mechanism_totals(D.mechanism_log(s, sf)), S.with_(S.MECH, select=f"""
SELECT {_c('file_index.completed')} AS index_completed, {_s('bytes', 'file_index.completed')} AS bytes_summarized,
  (SELECT pending FROM mech WHERE event='file_index.completed' ORDER BY ts DESC, event_id DESC LIMIT 1) AS index_pending,
  {_c('file_index.skipped')} AS index_skipped, {_c('file_memory.recalled')} AS file_recalls,
  {_s('tokens_after', 'file_memory.recalled')} AS file_tokens_injected, {_s('bytes', 'file_memory.recalled')} AS file_bytes_avoided,
  {_c('tool_supervision.warned')} AS warned, {_c('tool_supervision.suppressed')} AS suppressed,
  {", ".join(f"count(*) FILTER (event IN ('tool_supervision.warned','tool_supervision.suppressed') AND family='{f}') AS supervised_{f}" for f in V.FAMILY_TOKEN_ESTIMATE)},
  {_c('loop.redirected')} AS redirects, {_c('loop.fallback')} AS redirect_fallbacks, {_c('context.folded')} AS folded,
  {_s('tokens_before', 'context.folded')} AS fold_tokens_before, {_s('tokens_after', 'context.folded')} AS fold_tokens_after,
  {_c('context.fold_skipped')} AS fold_skipped, {_c('store.injection_rejected')} AS injection_rejected,
  {_c('cache.prompt_hit')} AS cache_hits, {_s('tokens_before', 'cache.prompt_hit')} AS cache_tokens_saved FROM mech"""))

_q("e13_arbitration_matrix", lambda s, sf: A.arbitration_matrix(D.arbitration_log(s, sf)), S.with_(S.RAW, S.ARB, select="""
SELECT capability, count(*) FILTER (action='inject') AS inject, count(*) FILTER (action='suppress') AS suppress, count(*) FILTER (action='shadow') AS shadow,
  coalesce(sum(greatest(0,injection_tokens)) FILTER (action='inject'),0)::BIGINT AS injected_tokens,
  coalesce(sum(greatest(0,injection_tokens)) FILTER (action='suppress'),0)::BIGINT AS suppressed_tokens,
  round(coalesce(sum(expected_net) FILTER (action='inject'),0.0),6) AS injected_net FROM dec GROUP BY 1"""))
_q("e13_arbitration_reasons", lambda s, sf: A.arbitration_reasons(D.arbitration_log(s, sf)), S.with_(S.RAW, select=f"""
SELECT ({S.arr(D.REASONS)})[(k%7+1)::INT] AS reason, count(*) FILTER (event_id%3=0) AS inject, count(*) FILTER (event_id%3=1) AS suppress,
  count(*) FILTER (event_id%3=2) AS shadow, count(*) AS decisions FROM raw GROUP BY 1"""))
_q("e13_arbitration_totals", lambda s, sf: A.arbitration_totals(D.arbitration_log(s, sf), D.event_log(s, sf)),
   S.with_(S.LOG, S.ARB, S.log_parts(), select="""
SELECT *, inject_decisions - prompt_visible_items AS divergence FROM (SELECT (SELECT count(*) FROM dec) AS decisions,
  (SELECT count(DISTINCT query_id) FROM dec) AS queries_with_decisions,
  (SELECT count(*) FROM dec WHERE capability='reasoning_reuse' AND action='inject') AS inject_decisions,
  (SELECT count(*) FROM (SELECT query_id FROM inj_b UNION ALL SELECT query_id FROM inj_f) x
    WHERE query_id IN (SELECT query_id FROM dec WHERE capability='reasoning_reuse')) AS prompt_visible_items)"""))

_EST = "CASE family " + " ".join(f"WHEN '{f}' THEN {t}" for f, t in V.FAMILY_TOKEN_ESTIMATE.items()) + " END"
_q("e14_mechanism_savings", lambda s, sf: A.mechanism_savings(D.mechanism_log(s, sf)), S.with_(S.MECH, f"""m AS (
SELECT coalesce(sum(greatest(0,tokens_before-tokens_after)) FILTER (event='context.folded'),0)::BIGINT AS context_saved,
  coalesce(sum(greatest(0,ceil(bytes/4)-tokens_after)) FILTER (event='file_memory.recalled'),0)::BIGINT AS file_saved,
  coalesce(sum({_EST}) FILTER (event IN ('tool_supervision.warned','tool_supervision.suppressed') AND mode='block'),0)::BIGINT AS supervision_saved,
  coalesce(sum(greatest(0,tokens_before)) FILTER (event='cache.prompt_hit'),0)::BIGINT AS cache_saved FROM mech)""",
  select="SELECT *, context_saved+file_saved+supervision_saved+cache_saved AS total_saved FROM m"))

_q("e15_impact", _log(A.impact), _sql(
    S.log_parts(), S.arms(), S.flags(), S.item_stats("block"), "sp AS (" + _SPLIT.format(by="", group="") + ")",
    """l AS (SELECT mean_tokens_treatment-mean_tokens_shadow AS tl, resolved_treatment/nullif(total_treatment,0)-resolved_shadow/nullif(total_shadow,0) AS rl,
  total_treatment AS tt FROM sp)""",
    f"""h AS (SELECT coalesce(sum(helpful),0)::BIGINT AS helped_tasks, coalesce(sum(verified_helpful),0)::BIGINT AS verified_helped_tasks,
  count(*) FILTER (agent_used>0) AS memories_used FROM st_block)""", select=f"""
SELECT (SELECT count(*) FROM qf WHERE treated AND injected) AS assisted_tasks, helped_tasks, verified_helped_tasks, memories_used,
  CASE WHEN tl IS NOT NULL AND rl IS NOT NULL THEN 'measured' ELSE 'estimated' END AS confidence, helped_tasks*{V.IMPACT_MINUTES_PER_HELP} AS minutes_saved,
  CASE WHEN tl IS NOT NULL AND rl IS NOT NULL AND tl<0 THEN round(-tl*tt)::BIGINT WHEN tl IS NOT NULL AND rl IS NOT NULL THEN 0 ELSE helped_tasks*{V.IMPACT_TOKENS_PER_HELP} END AS tokens_saved
FROM h, l"""))
_q("e15_impact_lists", _log(A.impact_lists), _sql(S.log_parts(), S.item_stats("block"), select="""
SELECT list, block_id, score, injected, row_number() OVER (PARTITION BY list ORDER BY score DESC, block_id) AS rank FROM (
  SELECT 'top' AS list, block_id, helpful AS score, injected FROM st_block WHERE helpful>0 UNION ALL
  SELECT 'attention', block_id, counterproductive, injected FROM st_block WHERE counterproductive>0) QUALIFY rank<=5"""))


def _usage_parts(by: str) -> list[str]:
    """CTEs up to ``us``; ``by`` is '' or 'day'."""
    c, g, d = (f"{by}, ", " GROUP BY ALL", f" AND x.{by}=o.{by}") if by else ("", "", "")
    join = lambda t: f"LEFT JOIN {t} USING ({by})" if by else f"CROSS JOIN {t}"
    ready = lambda a: f"(coalesce(assisted_{a},0)>={V.MIN_CAUSAL_COHORT} AND coalesce(holdout_{a},0)>={V.MIN_CAUSAL_COHORT})"
    one = lambda arm, n, e: f"{e} FILTER (arm='{arm}') AS {arm}_{n}"
    cols = ", ".join(one(a, n, e) for a in ("assisted", "holdout") for n, e in (
        ("n", "count(*)"), ("resolved", "count(*)"), ("mean_tokens", "avg(tokens)"), ("mean_duration_ms", "avg(duration_ms)"),
        ("n_tokens", "count(tokens)"), ("n_durations", "count(duration_ms)")))
    cols = cols.replace("count(*) FILTER (arm='assisted') AS assisted_resolved", "count(*) FILTER (arm='assisted' AND resolved) AS assisted_resolved")
    cols = cols.replace("count(*) FILTER (arm='holdout') AS holdout_resolved", "count(*) FILTER (arm='holdout' AND resolved) AS holdout_resolved")
    causal = _CAUSAL.format(by="", sel=c, daycond=d)
    return [S.log_parts(c), S.arms(c), S.flags(c), causal,
            f"fu AS (SELECT {c}{_FUNNEL} FROM qf{g})", "sp AS (" + _SPLIT.format(by=c, group=g) + ")",
            f"rs AS (SELECT {c}coalesce(sum(injected_tokens),0)::BIGINT AS injected_tokens_estimate FROM log WHERE event='retrieval'{g})",
            f"ig AS (SELECT {c}count(*) FILTER (seen AND shadow<>control) AS shadow_control_mismatches, count(*) FILTER (NOT seen) AS outcomes_without_retrieval FROM oarm{g})",
            f"ch AS (SELECT {c}{cols} FROM ca WHERE arm IS NOT NULL{g})",
            S.POINTS if not by else S.POINTS.replace("JOIN outc o USING (query_id)", "JOIN outc o USING (query_id, day)").replace(
                "u.item_id=l.block_id", "u.item_id=l.block_id AND u.day=day").replace("u.query_id=l.query_id", "u.query_id=query_id").replace("l.day", "day").replace("l.query_id", "query_id"),
            _AUC.format(part=by or "1", by=c, group=g), "fl AS (" + _FILT.format(by=c, group=g) + ")",
            f"""us AS (SELECT *, (mean_tokens_shadow-mean_tokens_treatment)*injected_runs AS tokens_saved, least(n_tokens_shadow,n_tokens_treatment) AS tokens_saved_n, least(n_duration_shadow,n_duration_treatment) AS latency_saved_n,
  (mean_duration_shadow-mean_duration_treatment)*injected_runs AS latency_saved_ms,
  helpful_runs*{V.TOKENS_PER_HELPFUL} AS heuristic_tokens_saved, helpful_runs*{V.LATENCY_MS_PER_HELPFUL} AS heuristic_latency_saved_ms,
  helpful_runs::DOUBLE/nullif(injected_runs,0) AS resolved_rate_with_memory,
  CASE WHEN {ready('n')} THEN assisted_resolved/assisted_n - holdout_resolved/holdout_n END AS causal_resolved_lift,
  CASE WHEN {ready('n_tokens')} THEN (holdout_mean_tokens-assisted_mean_tokens)*assisted_n END AS causal_tokens_lift,
  CASE WHEN {ready('n_durations')} THEN (holdout_mean_duration_ms-assisted_mean_duration_ms)*assisted_n END AS causal_latency_lift,
  CASE WHEN holdout_n>0 AND {ready('n_tokens')} THEN (holdout_mean_tokens-assisted_mean_tokens)*assisted_n - injected_tokens_estimate END AS net_token_impact,
  greatest(0, candidates_seen-candidates_shown) AS candidates_filtered
  FROM fu {join('sp')} {join('rs')} {join('ig')} {join('ch')} {join('cal')} {join('fl')} WHERE eligible_runs>0)"""]


_INT_USAGE = {"eligible_runs", "recalled_runs", "injected_runs", "used_runs", "helpful_runs", "verified_helpful_runs", "heuristic_tokens_saved",
              "heuristic_latency_saved_ms", "assisted_n", "holdout_n", "injected_tokens_estimate", "shadow_control_mismatches",
              "outcomes_without_retrieval", "scored_injections"}
_USAGE_SELECT = ", ".join(f"coalesce({c},0)::BIGINT AS {c}" if c in _INT_USAGE else f"round({c}::DOUBLE,6) AS {c}" for c in U.USAGE_COLS)


def _usage(spark, sf):
    return U.usage_metrics(D.event_log(spark, sf), price_per_million=3.0).select(*U.USAGE_COLS, "net_value")


_q("e16_usage_metrics", _usage, _sql(*_usage_parts(""), select=f"SELECT {_USAGE_SELECT}, round((net_token_impact*0.000003)::DOUBLE,6) AS net_value FROM us"))


def event_lines(spark, sf):
    """The event log as JSON lines: (line_id, line)."""
    e = D.event_log(spark, sf)
    ids = lambda c, name: F.transform(c, lambda i: F.struct(i.alias(name), F.lit(0.5).alias("score")))
    only = lambda event, value: F.when(F.col("event") == event, value)
    line = F.to_json(F.struct(
        "ts", "event", F.col("query_id").alias("queryId"), F.col("run_id").alias("runId"), F.col("block_id").alias("blockId"), F.col("fact_id").alias("factId"),
        F.coalesce("score", only("fact_injection", F.lit(0.0))).alias("score"), "shadow", F.col("control_reason").alias("controlReason"),
        ids(F.col("candidates"), "blockId").alias("candidates"), ids(F.col("fact_candidates"), "factId").alias("factCandidates"),
        F.col("injected_tokens").alias("injectedTokensEstimate"), "resolved", "tokens", F.col("duration_ms").alias("durationMs"), "control", "attribution",
        F.col("match_signal").alias("matchSignal"), F.col("match_score").alias("matchScore"), F.col("evidence_strength").alias("evidenceStrength"),
        F.col("policy_id").alias("cascadePolicyId"), F.col("reranker_name").alias("rerankerName"), F.col("fell_back").alias("rerankerFellBack"), F.col("fallback_reason").alias("rerankerFallbackReason"),
        only("calibrator_refit", F.lit(1)).alias("freshOutcomes"), only("calibrator_refit", F.col("ts")).alias("fittedAt"), only("drift_injection", F.lit("straight")).alias("signalKind"),
        only("drift_injection", F.lit(1)).alias("patternsInjected"), only("drift_injection", F.lit(0.5)).alias("gateThreshold")))
    return e.select(F.col("event_id").alias("line_id"), line.alias("line"))


def imported_log(spark, sf):
    """The event log written as JSON lines, checked line by line, and read back into report columns."""
    lines = cut(event_lines(spark, sf))
    good = cut(EV.parse_event_lines(lines).select("line_id", "line", "status")).where("status = 'good'")
    return cut(EV.event_log(good.select(F.col("line_id").alias("event_id"), F.col("line").alias("payload"))))  # a table: the reports read it many times


_q("a4_imported_per_block_stats", lambda s, sf: A.per_item_stats(imported_log(s, sf), item="block"), QUERIES["e5_per_block_stats"].sql)
_q("a4_imported_usage_metrics", lambda s, sf: U.usage_metrics(imported_log(s, sf), price_per_million=3.0).select(*U.USAGE_COLS, "net_value"), QUERIES["e16_usage_metrics"].sql)


def daily_usage(spark, sf):
    """One usage row per UTC day with an eligible run."""
    return U.usage_metrics(A.with_day(D.event_log(spark, sf)), by=("day",))


_q("a8_daily_usage_windows", lambda s, sf: daily_usage(s, sf).select("day", *U.USAGE_COLS),
   _sql(*_usage_parts("day"), select=f"SELECT day, {_USAGE_SELECT} FROM us"))

_q("e17_fold_days", lambda s, sf: U.fold_days(daily_usage(s, sf)), _sql(*_usage_parts("day"), """fd AS (SELECT
  sum(eligible_runs)::BIGINT AS eligible_runs, sum(recalled_runs)::BIGINT AS recalled_runs, sum(injected_runs)::BIGINT AS injected_runs,
  sum(used_runs)::BIGINT AS used_runs, sum(helpful_runs)::BIGINT AS helpful_runs, sum(shadow_control_mismatches)::BIGINT AS shadow_control_mismatches,
  sum(outcomes_without_retrieval)::BIGINT AS outcomes_without_retrieval, sum(scored_injections)::BIGINT AS scored_injections,
  sum(candidates_seen)::BIGINT AS candidates_seen, sum(candidates_shown)::BIGINT AS candidates_shown, sum(candidates_filtered)::BIGINT AS candidates_filtered,
  sum(assisted_n)::BIGINT AS assisted_n, sum(assisted_resolved)::BIGINT AS assisted_resolved, sum(holdout_n)::BIGINT AS holdout_n, sum(holdout_resolved)::BIGINT AS holdout_resolved,
  sum(brier_score*scored_injections)/sum(scored_injections) FILTER (brier_score IS NOT NULL) AS brier_score,
  sum(auc*scored_injections)/sum(scored_injections) FILTER (auc IS NOT NULL) AS auc, max(last_refit_ts) AS last_refit_ts,
  sum(tokens_saved) FILTER (tokens_saved_n>0) AS tokens_saved, sum(tokens_saved_n) FILTER (tokens_saved IS NOT NULL)::BIGINT AS tokens_saved_n,
  sum(latency_saved_ms) FILTER (latency_saved_n>0) AS latency_saved_ms, sum(latency_saved_n) FILTER (latency_saved_ms IS NOT NULL)::BIGINT AS latency_saved_n,
  sum(causal_tokens_lift) AS ct, sum(least(coalesce(assisted_n_tokens,0),coalesce(holdout_n_tokens,0)))::BIGINT AS causal_tokens_n,
  sum(causal_latency_lift) AS cl, sum(least(coalesce(assisted_n_durations,0),coalesce(holdout_n_durations,0)))::BIGINT AS causal_latency_n, count(*) AS days FROM us)""", select=f"""
SELECT * EXCLUDE (ct, cl) REPLACE (round(brier_score,6) AS brier_score, round(auc::DOUBLE,6) AS auc, round(tokens_saved,6) AS tokens_saved, round(latency_saved_ms,6) AS latency_saved_ms),
  CASE WHEN assisted_n>={V.MIN_CAUSAL_COHORT} AND holdout_n>={V.MIN_CAUSAL_COHORT} THEN round(ct,6) END AS causal_tokens_lift,
  CASE WHEN assisted_n>={V.MIN_CAUSAL_COHORT} AND holdout_n>={V.MIN_CAUSAL_COHORT} THEN round(cl,6) END AS causal_latency_lift,
  round(helpful_runs::DOUBLE/nullif(injected_runs,0),6) AS resolved_rate_with_memory, round(candidates_filtered::DOUBLE/nullif(candidates_seen,0),6) AS candidate_filter_rate,
  round(CASE WHEN assisted_n>={V.MIN_CAUSAL_COHORT} AND holdout_n>={V.MIN_CAUSAL_COHORT} THEN assisted_resolved/assisted_n - holdout_resolved/holdout_n END,6) AS resolved_lift FROM fd"""))


def _cascade(by: str) -> list[str]:
    c = f"{by}, " if by else ""
    fb = ", ".join(f"count(*) FILTER (arm='cascade' AND fell_back AND fallback_reason='{x}') AS fallback_{x}" for x in ("timeout", "error", "null", "empty", "validation"))
    return [S.log_parts(c), f"""r0 AS (SELECT *, CASE WHEN coalesce(policy_id,'')<>'' THEN 'cascade' ELSE 'sync' END AS arm FROM log WHERE event='retrieval'),
qa AS (SELECT {c}query_id, CASE WHEN bool_or(arm='cascade') THEN 'cascade' ELSE 'sync' END AS arm FROM r0 GROUP BY ALL),
ra AS (SELECT {c}arm, count(*) AS retrievals, count(*) FILTER (arm='cascade' AND NOT fell_back AND reranker_name IS NOT NULL) AS reranker_ran, {fb} FROM r0 GROUP BY ALL),
pa AS (SELECT {c}query_id, bool_or(coalesce(strength_rank>=1,false)) AS strong FROM inj_b LEFT JOIN use_b USING ({c}query_id, item_id) GROUP BY ALL),
sa AS (SELECT {c}arm, count(strong) AS injections, count(resolved) AS total_runs, count(*) FILTER (resolved AND coalesce(strong,false)) AS helpful_runs
  FROM qa LEFT JOIN pa USING ({c}query_id) LEFT JOIN outc USING ({c}query_id) GROUP BY ALL),
cmp AS (SELECT *, helpful_runs::DOUBLE/nullif(total_runs,0) AS helpful_rate FROM ra LEFT JOIN sa USING ({c}arm))"""]


_CMP = "* REPLACE (round(helpful_rate,6) AS helpful_rate)"
_q("e18_cascade_compare", _log(A.cascade_compare), _sql(*_cascade(""), select=f"SELECT {_CMP} FROM cmp"))
_q("e18_cascade_lift", lambda s, sf: A.cascade_lift(A.cascade_compare(D.event_log(s, sf))), _sql(*_cascade(""), select="""
SELECT round(max(helpful_rate) FILTER (arm='cascade') - max(helpful_rate) FILTER (arm='sync'),6) AS lift,
  coalesce(max(total_runs) FILTER (arm='cascade'),0)<50 OR coalesce(max(total_runs) FILTER (arm='sync'),0)<50 AS low_sample FROM cmp"""))
_q("e19_cascade_by_day", lambda s, sf: A.cascade_compare(A.with_day(D.event_log(s, sf)), by=("day",)),
   _sql(*_cascade("day"), select=f"SELECT {_CMP} FROM cmp"))
_ACROSS = [S.log_parts(), *[x.replace("pa AS (SELECT day, query_id", "pa AS (SELECT query_id").replace("inj_b LEFT JOIN use_b USING (day, query_id, item_id)", "inj_b LEFT JOIN use_b USING (query_id, item_id)")
                           .replace("LEFT JOIN pa USING (day, query_id) LEFT JOIN outc USING (day, query_id)", "LEFT JOIN pa USING (query_id) LEFT JOIN outc USING (query_id)") for x in _cascade("day")[1:]]]
_q("e19_cascade_across_days", lambda s, sf: A.cascade_compare(A.with_day(D.event_log(s, sf)), by=("day",), cross_day=True),
   _sql(*_ACROSS, select=f"SELECT {_CMP} FROM cmp"))

_ids = lambda e, c, n: f"coalesce(string_agg(DISTINCT {c}, ',' ORDER BY {c}) FILTER (event='{e}'),'') AS {n}"
_q("e20_explain_query", _log(A.explain_query), _sql(S.log_parts(), f"""rt AS (SELECT query_id, policy_id, len(candidates) AS selected, shadow FROM log WHERE event='retrieval'
   QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ts DESC, event_id DESC)=1),
it AS (SELECT query_id, {_ids('injection', 'block_id', 'injected_blocks')}, {_ids('fact_injection', 'fact_id', 'injected_facts')},
  {_ids('agent_used', 'block_id', 'used_blocks')}, {_ids('fact_agent_used', 'fact_id', 'used_facts')} FROM log
  WHERE event IN ('injection','fact_injection','agent_used','fact_agent_used') GROUP BY 1),
ids AS (SELECT query_id FROM rt UNION SELECT query_id FROM it UNION SELECT query_id FROM outc)""", select="""
SELECT query_id, CASE WHEN selected IS NULL THEN NULL WHEN coalesce(policy_id,'')<>'' THEN 'cascade' ELSE 'sync' END AS arm, selected, rt.shadow AS shadow,
  coalesce(injected_blocks,'') AS injected_blocks, coalesce(injected_facts,'') AS injected_facts, coalesce(used_blocks,'') AS used_blocks,
  coalesce(used_facts,'') AS used_facts, resolved, duration_ms FROM ids LEFT JOIN rt USING (query_id) LEFT JOIN it USING (query_id) LEFT JOIN outc USING (query_id)"""))

_q("e21_use_strength", _log(A.use_strength, item="block"), _sql(S.log_parts(), select="SELECT * FROM use_b"))

_q("e24_tool_obs_stats", lambda s, sf: A.tool_obs_stats(D.tool_obs(s, sf), 1_704_300_000_000, 1_705_900_000_000), S.with_(S.OBS, select="""
SELECT session_id, arg_key, tool_name, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM obs
WHERE ts>=1704300000000 AND ts<1705900000000 GROUP BY ALL"""))

_PAIRS = """pr AS (SELECT f.task, f.agent, f.duration_ms-o.duration_ms AS time_ms, f.tool_calls-o.tool_calls AS tool_calls, f.tokens-o.tokens AS tokens_raw,
  f.tokens-o.tokens-o.injected_tokens AS tokens_net, o.injected_tokens, o.blocked_calls, f.passed AS off_passed, o.passed AS on_passed,
  CASE WHEN f.passed AND o.passed THEN 'both-pass' WHEN NOT f.passed AND NOT o.passed THEN 'both-fail' WHEN f.passed THEN 'off-pass-on-fail' ELSE 'off-fail-on-pass' END AS agreement
  FROM runs f JOIN runs o USING (task) WHERE f.arm='off' AND o.arm='on')"""
_q("e25_paired_runs", lambda s, sf: A.paired_runs(D.runs(s, sf)), S.with_(S.RUNS, _PAIRS, select="SELECT * FROM pr"))
_q("e26_run_metrics", lambda s, sf: A.run_metrics(D.runs(s, sf)), S.with_(S.RUNS, select="""
SELECT arm, count(*) AS n, round(avg(passed::INT),6) AS success_rate, round(avg(tokens),6) AS avg_tokens, sum(tokens)::BIGINT AS total_tokens,
  round(avg(duration_ms),6) AS avg_duration_ms, round(avg((injected_tokens>0)::INT),6) AS recall_hit_rate, round(median(tokens)::DOUBLE,6) AS median_tokens,
  (list_sort(list(tokens)))[(count(*)//2+1)::INT]::DOUBLE AS median_tokens_upper FROM runs GROUP BY 1"""))
_q("e26_run_delta", lambda s, sf: A.run_delta(D.runs(s, sf)), S.with_(S.RUNS, """m AS (SELECT avg(passed::INT) FILTER (arm='off') AS fo, avg(passed::INT) FILTER (arm='on') AS oo,
  avg(tokens) FILTER (arm='off') AS ft, avg(tokens) FILTER (arm='on') AS ot, avg(duration_ms) FILTER (arm='off') AS fd, avg(duration_ms) FILTER (arm='on') AS od FROM runs),
p AS (SELECT task, max(tokens) FILTER (arm='off' AND passed) AS b, max(tokens) FILTER (arm='on' AND passed) AS a FROM runs GROUP BY 1)""", select="""
SELECT round((oo-fo)*100,6) AS success_delta_pp, round((ft-ot)*100/ft,6) AS token_savings_pct, round((fd-od)*100/fd,6) AS time_reduction_pct,
  (SELECT round(avg((b-a)/b)*100,6) FROM p WHERE b>0) AS avg_token_save, (SELECT round(max((b-a)/b)*100,6) FROM p WHERE b>0) AS peak_token_save FROM m"""))

_REPORT = """rep AS (SELECT condition, count(*) AS n, count(*) FILTER (passed) AS resolved, avg(passed::INT) AS resolved_rate, avg(duration_ms) AS avg_duration_ms,
  avg(tokens) AS avg_tokens, avg(steps) AS avg_steps, avg(regressed::INT) AS regressed_rate, avg(had_injection::INT) AS injection_rate,
  coalesce(count(*) FILTER (had_injection AND used_ids>0)::DOUBLE/nullif(count(*) FILTER (had_injection),0),0.0) AS used_after_injection_rate,
  median(duration_ms)::DOUBLE AS median_duration_ms FROM runs GROUP BY 1)"""
_q("e30_condition_report", lambda s, sf: A.condition_report(D.runs(s, sf)), S.with_(S.RUNS, _REPORT, select=f"""
SELECT condition, n, resolved, {_r('resolved_rate', 'avg_duration_ms', 'avg_tokens', 'avg_steps', 'regressed_rate', 'injection_rate', 'used_after_injection_rate', 'median_duration_ms')} FROM rep"""))
_q("e30_condition_lift", lambda s, sf: A.condition_lift(A.condition_report(D.runs(s, sf)), "1-URGENT"), S.with_(S.RUNS, _REPORT, select="""
SELECT c.condition AS vs, round(r.resolved_rate-c.resolved_rate,6) AS resolved_lift, round(r.avg_duration_ms-c.avg_duration_ms,6) AS duration_delta_ms,
  r.n AS n_reference, c.n AS n_comparator FROM rep c, rep r WHERE r.condition='1-URGENT' AND c.condition<>'1-URGENT'"""))
_q("e31_agent_summary", lambda s, sf: A.agent_summary(A.paired_runs(D.runs(s, sf))), S.with_(S.RUNS, _PAIRS, select="""
SELECT agent, count(*) AS tasks, count(*) FILTER (off_passed) AS off_solved, count(*) FILTER (on_passed) AS on_solved, sum(tokens_net)::BIGINT AS net_tokens,
  sum(injected_tokens)::BIGINT AS injected_tokens, sum(blocked_calls)::BIGINT AS blocked_calls FROM pr GROUP BY 1"""))
_AGENTS = ["a0", "a1", "a2", "a3"]
_CELL = "CASE WHEN off_passed=on_passed THEN CASE WHEN on_passed THEN 'PASS' ELSE 'FAIL' END WHEN off_passed THEN 'PASS->FAIL' ELSE 'FAIL->PASS' END"
_q("e31_status_matrix", lambda s, sf: A.status_matrix(A.paired_runs(D.runs(s, sf)), _AGENTS), S.with_(S.RUNS, _PAIRS, select=f"""
SELECT task, {", ".join(f"coalesce(max({_CELL}) FILTER (agent='{a}'),'-') AS {a}" for a in _AGENTS)} FROM pr GROUP BY 1"""))

_q("e27_contributors", lambda s, sf: A.contributors(D.table(s, sf, "orders").select(
    F.col("o_custkey").alias("installation_id"), (F.col("o_custkey") % 60).alias("project_id"))), """
SELECT count(DISTINCT o_custkey) AS installations, count(DISTINCT o_custkey%60) AS projects, count(*) AS samples FROM orders""")


def _feedback(spark, sf):
    """Purchases are feedback on the item they name; every third names its query."""
    e = D.raw_events(spark, sf).withColumn("query_id", F.concat(F.lit("q"), F.col("event_id").cast("string")))
    item = F.concat(F.lit("b"), (F.col("k") % 5).cast("string"))
    fb = e.where("event_type='purchase'").select(
        F.col("event_id").alias("feedback_id"), item.alias("trace_id"), "ts",
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("q"), (F.col("event_id") - F.col("event_id") % 9).cast("string"))).alias("query_id"))
    got = e.where("event_type='view'").select("query_id", F.explode(F.array(item, F.concat(F.lit("b"), ((F.col("k") + 1) % 5).cast("string")))).alias("trace_id"), "ts")
    return A.resolve_feedback(fb, got)


_q("e28_resolve_feedback", _feedback, S.with_(S.RAW, """fb AS (SELECT event_id AS feedback_id, 'b'||(k%5) AS trace_id, ts,
   CASE WHEN event_id%3=0 THEN 'q'||(event_id-event_id%9) END AS query_id FROM raw WHERE event_type='purchase'),
got AS (SELECT 'q'||event_id AS query_id, unnest(['b'||(k%5),'b'||((k+1)%5)]) AS trace_id, ts FROM raw WHERE event_type='view'),
cr AS (SELECT query_id, trace_id, min((ts, feedback_id)) AS f FROM fb WHERE query_id IS NOT NULL GROUP BY ALL),
ex AS (SELECT fb.feedback_id, fb.trace_id, CASE WHEN EXISTS (SELECT 1 FROM got g WHERE g.query_id=fb.query_id AND g.trace_id=fb.trace_id) THEN fb.query_id END AS resolved_query,
   false AS ambiguous, cr.f[2]<>fb.feedback_id AS already_credited FROM fb JOIN cr USING (query_id, trace_id)),
cand AS (SELECT fb.feedback_id, g.query_id, g.ts FROM fb JOIN got g ON g.trace_id=fb.trace_id AND g.ts<=fb.ts AND g.ts>fb.ts-3600000
   LEFT JOIN cr ON cr.query_id=g.query_id AND cr.trace_id=g.trace_id WHERE fb.query_id IS NULL AND NOT coalesce(cr.f[1]<fb.ts,false)),
b AS (SELECT feedback_id, count(*) AS n FROM cand GROUP BY 1),
bq AS (SELECT feedback_id, query_id FROM cand QUALIFY row_number() OVER (PARTITION BY feedback_id ORDER BY ts DESC, query_id DESC)=1)""", select="""
SELECT * FROM ex UNION ALL SELECT fb.feedback_id, fb.trace_id, bq.query_id, coalesce(b.n,0)>1, false FROM fb LEFT JOIN b USING (feedback_id) LEFT JOIN bq USING (feedback_id) WHERE fb.query_id IS NULL"""))


def _claims(spark, sf):
    log = D.event_log(spark, sf)
    claims = log.where("event='outcome'").select(
        "query_id", (F.col("event_id") % 2 == 0).alias("used_pattern"),
        F.when(F.col("event_id") % 3 == 0, F.array(F.lit("b0"), F.lit("b3"))).alias("used_blocks"))
    return A.injected_and_used(log, claims)


_q("e29_injected_and_used", _claims, _sql(S.log_parts(), """cl AS (SELECT query_id, event_id%2=0 AS used_pattern, CASE WHEN event_id%3=0 THEN ['b0','b3'] END AS used_blocks FROM log WHERE event='outcome')""", select="""
SELECT query_id, item_id AS block_id FROM inj_b WHERE (query_id, item_id) IN (SELECT query_id, unnest(used_blocks) FROM cl WHERE used_blocks IS NOT NULL)
UNION ALL SELECT query_id, item_id FROM inj_b WHERE query_id IN (SELECT query_id FROM cl WHERE used_blocks IS NULL AND used_pattern)"""))
