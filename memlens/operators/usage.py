"""Usage metrics from mergeable state (E16, E17, A8; the streaming form is G12).

One scan of the log makes one row of state per (query, item, prediction): last retrieval and last outcome as structs ordered by
(ts, event_id), strongest use as a maximum rank, the rest sums and flags.  Every column merges by maximum or sum, in any
order and any number of times over disjoint parts of the log, so states of hours, files or stream triggers are added up by
``merge_state``, and every metric is an aggregate of the state: per item, then per query, then per day or in all.
Nothing is joined to find a query's flags, and a query id with a large share of the log is combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlens import fixed_values as V
from memlens.common import clamp01, count_if, prefix_counts, ratio
from memlens.functions.scores import strength_rank
from memlens.session import cut

By = tuple[str, ...]
KEYS = ["query_id", "kind", "item_id", "prediction"]
RETRIEVAL = ["ts", "event_id", "shadow", "control_reason"]
OUTCOME = ["ts", "event_id", "resolved", "tokens", "duration_ms", "control", "attribution"]
MAXIMA = ["last_retrieval", "last_outcome", "eligible", "recalled", "treated", "shadowed", "injected", "used", "rank", "last_refit_ts"]
SUMS = ["points", "injected_tokens", "candidates_seen", "candidates_shown", "refits", "drift_injections"]


def _is(*events: str) -> Column:
    return F.col("event").isin(*events)


def usage_state(log: DataFrame, by: By = ()) -> DataFrame:
    """The state of a log: keys ``by``, query, kind and id of an item, prediction of an injection; then MAXIMA and SUMS.

    Rows of events without an item have null item keys.  Works on any part of a log, for example one trigger's rows.
    """
    block, fact = _is("injection", "agent_used"), _is("fact_injection", "fact_agent_used")
    size = lambda c: F.size(F.coalesce(c, F.array()))
    retrieval, injection = _is("retrieval"), _is("injection", "fact_injection")
    candidates = size("candidates") + size("fact_candidates")
    rows = log.select(
        *by, "query_id", F.when(block, "block").when(fact, "fact").alias("kind"), F.when(block, F.col("block_id")).when(fact, F.col("fact_id")).alias("item_id"),
        F.when(_is("injection"), clamp01(F.col("score"))).alias("prediction"),
        F.when(retrieval, F.struct(*RETRIEVAL)).alias("last_retrieval"), F.when(_is("outcome"), F.struct(*OUTCOME)).alias("last_outcome"),
        retrieval.alias("eligible"), (retrieval & (candidates > 0)).alias("recalled"), (retrieval & ~F.col("shadow")).alias("treated"), (retrieval & F.col("shadow")).alias("shadowed"),
        injection.alias("injected"), _is("agent_used", "fact_agent_used").alias("used"),
        F.when(_is("agent_used", "fact_agent_used"), strength_rank(F.col("match_signal"), F.col("match_score"), F.col("evidence_strength"))).alias("rank"),
        F.when(_is("calibrator_refit"), F.col("ts")).alias("last_refit_ts"),
        _is("injection").cast("long").alias("points"), F.when(retrieval, F.col("injected_tokens")).cast("long").alias("injected_tokens"),
        F.when(retrieval & ~F.col("shadow"), candidates).cast("long").alias("candidates_seen"), injection.cast("long").alias("candidates_shown"),
        _is("calibrator_refit").cast("long").alias("refits"), _is("drift_injection").cast("long").alias("drift_injections"))
    return merge_state(rows, by)


def merge_state(state: DataFrame, by: By = ()) -> DataFrame:
    """States of disjoint parts of a log, put together as rows, as the state of the whole."""
    return _merged(state, [*by, *KEYS])


def _merged(state: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    return state.groupBy(*keys).agg(*[F.max(c).alias(c) for c in MAXIMA], *[F.sum(c).alias(c) for c in SUMS], *more)


def query_state(state: DataFrame, by: By = ()) -> DataFrame:
    """One row per query: MAXIMA, SUMS and ``strong_use`` (an injected item used at helpful strength or more)."""
    items = _merged(state, [*by, "query_id", "kind", "item_id"])
    strong = F.col("item_id").isNotNull() & F.col("injected") & (F.coalesce("rank", F.lit(-1)) >= V.HELPFUL_RANK)
    return _merged(items.withColumn("strong_use", strong), [*by, "query_id"], F.max("strong_use").alias("strong_use"))


def calibration_from_state(state: DataFrame, by: By = ()) -> DataFrame:
    """Brier score and AUC (ties averaged) over block injections whose query has an outcome."""
    keys = [*by, "query_id"]
    points = state.where(F.col("points") > 0).select(*keys, "item_id", "prediction", "points")
    ranks = state.where("kind = 'block'").groupBy(*keys, "item_id").agg(F.max("rank").alias("rank"))
    outcomes = state.groupBy(*keys).agg(F.max("last_outcome").alias("o")).where("o IS NOT NULL").select(*keys, F.col("o.resolved").alias("resolved"))
    label = (F.coalesce(F.col("rank") >= V.HELPFUL_RANK, F.lit(False)) & F.col("resolved")).cast("int")
    scored = points.join(outcomes, keys).join(ranks, [*keys, "item_id"], "left").withColumn("label", label)
    distinct = scored.groupBy(*by, "prediction").agg(F.sum("points").alias("n"), F.sum(F.col("points") * F.col("label")).alias("pos"))
    placed = prefix_counts(distinct, by, "prediction", F.floor(F.col("prediction") * 1024), ["n"])
    rank, p = F.col("before_n") + (F.col("n") + 1) / 2, F.col("prediction")
    agg = placed.groupBy(*by).agg(
        F.sum("n").alias("scored"), F.sum("pos").alias("positives"), F.sum(F.col("pos") * rank).alias("rank_sum"),
        F.sum(F.col("pos") * (p - 1) * (p - 1) + (F.col("n") - F.col("pos")) * p * p).alias("sq"))
    pos, neg = F.col("positives"), F.col("scored") - F.col("positives")
    return agg.select(*by, F.col("scored").alias("scored_injections"), ratio(F.col("sq"), F.col("scored")).alias("brier_score"),
                      ratio(F.col("rank_sum") - pos * (pos + 1) / 2, pos * neg).alias("auc"))


def _totals(queries: DataFrame, by: By) -> DataFrame:
    """Everything but calibration in one aggregate over queries."""
    r, o = F.col("last_retrieval"), F.col("last_outcome")
    has, seen = o.isNotNull(), r.isNotNull()
    in_shadow = F.coalesce(r["shadow"], o["control"])
    treatment, shadow = has & ~in_shadow, has & in_shadow
    helpful = F.col("injected") & F.col("used") & F.coalesce(o["resolved"], F.lit(False)) & F.col("strong_use")
    arms = {"assisted": has & ~in_shadow & F.col("injected"), "holdout": has & in_shadow & (r["control_reason"] == "holdout")}
    cohorts = []
    for arm, inside in arms.items():
        cohorts += [count_if(inside).alias(f"{arm}_n"), count_if(inside & o["resolved"]).alias(f"{arm}_resolved")]
        for field, name, count in (("tokens", "mean_tokens", "n_tokens"), ("duration_ms", "mean_duration_ms", "n_durations")):
            cohorts += [F.avg(F.when(inside, o[field])).alias(f"{arm}_{name}"), F.count(F.when(inside, o[field])).alias(f"{arm}_{count}")]
    mean = lambda inside, field: F.avg(F.when(inside, o[field]))
    count = lambda inside, field: F.count(F.when(inside, o[field]))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    totals = queries.groupBy(*by).agg(
        *[count_if(F.col(f)).alias(f"{f}_runs") for f in ("eligible", "recalled", "injected", "used")],
        count_if(helpful).alias("helpful_runs"), count_if(helpful & (F.coalesce(o["attribution"], F.lit("")) != "inferred")).alias("verified_helpful_runs"),
        mean(treatment, "tokens").alias("mean_tokens_treatment"), mean(shadow, "tokens").alias("mean_tokens_shadow"),
        mean(treatment, "duration_ms").alias("mean_duration_treatment"), mean(shadow, "duration_ms").alias("mean_duration_shadow"),
        F.least(count(shadow, "tokens"), count(treatment, "tokens")).alias("tokens_saved_n"),
        F.least(count(shadow, "duration_ms"), count(treatment, "duration_ms")).alias("latency_saved_n"),
        F.coalesce(F.sum("injected_tokens"), F.lit(0)).alias("injected_tokens_estimate"),
        count_if(has & seen & (r["shadow"] != o["control"])).alias("shadow_control_mismatches"), count_if(has & ~seen).alias("outcomes_without_retrieval"),
        *cohorts, *[zero(c) for c in ("candidates_seen", "candidates_shown", "refits", "drift_injections")], F.max("last_refit_ts").alias("last_refit_ts"))
    return (totals.withColumn("candidates_filtered", F.greatest(F.lit(0), F.col("candidates_seen") - F.col("candidates_shown")))
            .withColumn("candidate_filter_rate", ratio(F.col("candidates_filtered"), F.col("candidates_seen"))))


def usage_from_state(state: DataFrame, by: By = (), price_per_million: float | None = None, min_cohort: int = V.MIN_CAUSAL_COHORT) -> DataFrame:
    """Observed funnel, shadow deltas, heuristic and causal estimates; one row per ``by`` that has an eligible run.

    ``state`` is read twice: write it first if it is costly.
    """
    totals, calibration = _totals(query_state(state, by), by), calibration_from_state(state, by)
    if by:
        out = totals.join(calibration, list(by), "left")
    else:
        packed = calibration.select(F.struct(*calibration.columns).alias("c")).scalar()
        out = totals.withColumn("_c", packed).select("*", *[F.col(f"_c.{c}").alias(c) for c in calibration.columns]).drop("_c")
    ready = lambda x: (F.col(f"assisted_{x}") >= min_cohort) & (F.col(f"holdout_{x}") >= min_cohort)
    causal_tokens = F.when(ready("n_tokens"), (F.col("holdout_mean_tokens") - F.col("assisted_mean_tokens")) * F.col("assisted_n"))
    out = (out.where(F.col("eligible_runs") > 0)
           .withColumn("scored_injections", F.coalesce("scored_injections", F.lit(0)))
           .withColumn("tokens_saved", (F.col("mean_tokens_shadow") - F.col("mean_tokens_treatment")) * F.col("injected_runs"))
           .withColumn("latency_saved_ms", (F.col("mean_duration_shadow") - F.col("mean_duration_treatment")) * F.col("injected_runs"))
           .withColumn("heuristic_tokens_saved", F.col("helpful_runs") * V.TOKENS_PER_HELPFUL)
           .withColumn("heuristic_latency_saved_ms", F.col("helpful_runs") * V.LATENCY_MS_PER_HELPFUL)
           .withColumn("resolved_rate_with_memory", ratio(F.col("helpful_runs"), F.col("injected_runs")))
           .withColumn("causal_resolved_lift", F.when(ready("n"), ratio(F.col("assisted_resolved"), F.col("assisted_n"))
                                                      - ratio(F.col("holdout_resolved"), F.col("holdout_n"))))
           .withColumn("causal_tokens_lift", causal_tokens)
           .withColumn("causal_latency_lift", F.when(ready("n_durations"), (F.col("holdout_mean_duration_ms")
                                                     - F.col("assisted_mean_duration_ms")) * F.col("assisted_n")))
           .withColumn("net_token_impact", F.when(F.col("holdout_n") > 0, F.col("causal_tokens_lift") - F.col("injected_tokens_estimate"))))
    if price_per_million is not None:
        out = out.withColumn("net_value", F.col("net_token_impact") * F.lit(price_per_million / 1e6))
    return out


def usage_metrics(log: DataFrame, by: By = (), price_per_million: float | None = None, min_cohort: int = V.MIN_CAUSAL_COHORT) -> DataFrame:
    """E16 over a log, per day with ``by=('day',)`` (A8): one scan, whose state is written and then read."""
    return usage_from_state(cut(usage_state(log, by)), by, price_per_million, min_cohort)


USAGE_COLS = ["eligible_runs", "recalled_runs", "injected_runs", "used_runs", "helpful_runs", "verified_helpful_runs",
              "resolved_rate_with_memory", "tokens_saved", "latency_saved_ms", "heuristic_tokens_saved",
              "heuristic_latency_saved_ms", "assisted_n", "holdout_n", "causal_resolved_lift", "causal_tokens_lift",
              "causal_latency_lift", "net_token_impact", "injected_tokens_estimate", "shadow_control_mismatches",
              "outcomes_without_retrieval", "brier_score", "auc", "scored_injections"]


def fold_days(days: DataFrame, by: By = (), min_cohort: int = V.MIN_CAUSAL_COHORT) -> DataFrame:
    """Pool daily usage rows.

    Brier and AUC are weighted by scored injections; cohorts are pooled.  Token and latency savings sum over days that have a
    sample; the causal token and latency lifts sum the days' own (each day is gated by its own cohorts) and, like the
    resolved lift, appear only if both pooled cohorts are large enough.
    """
    s = lambda c: F.sum(c).alias(c)
    w = lambda c: ratio(F.sum(F.when(F.col(c).isNotNull(), F.col(c) * F.col("scored_injections"))),
                        F.sum(F.when(F.col(c).isNotNull(), F.col("scored_injections")))).alias(c)
    saved = []
    for value, n in (("tokens_saved", "tokens_saved_n"), ("latency_saved_ms", "latency_saved_n")):
        saved += [F.sum(F.when(F.col(n) > 0, F.col(value))).alias(value), F.sum(F.when(F.col(value).isNotNull(), F.col(n))).alias(n)]
    out = days.groupBy(*by).agg(
        *[s(c) for c in ("eligible_runs", "recalled_runs", "injected_runs", "used_runs", "helpful_runs",
                         "shadow_control_mismatches", "outcomes_without_retrieval", "scored_injections",
                         "candidates_seen", "candidates_shown", "candidates_filtered", "assisted_n", "assisted_resolved",
                         "holdout_n", "holdout_resolved")],
        w("brier_score"), w("auc"), F.max("last_refit_ts").alias("last_refit_ts"), *saved,
        s("causal_tokens_lift"), F.sum(F.least("assisted_n_tokens", "holdout_n_tokens")).alias("causal_tokens_n"),
        s("causal_latency_lift"), F.sum(F.least("assisted_n_durations", "holdout_n_durations")).alias("causal_latency_n"), F.count("*").alias("days"))
    ready = (F.col("assisted_n") >= min_cohort) & (F.col("holdout_n") >= min_cohort)
    return (out.withColumn("resolved_rate_with_memory", ratio(F.col("helpful_runs"), F.col("injected_runs")))
            .withColumn("candidate_filter_rate", ratio(F.col("candidates_filtered"), F.col("candidates_seen")))
            .withColumn("resolved_lift", F.when(ready, ratio(F.col("assisted_resolved"), F.col("assisted_n"))
                                                - ratio(F.col("holdout_resolved"), F.col("holdout_n"))))
            .withColumns({c: F.when(ready, F.col(c)) for c in ("causal_tokens_lift", "causal_latency_lift")}))
