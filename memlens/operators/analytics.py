"""Event-log analytics: splits, funnel, per-memory counts, calibration, impact, usage.

``log`` is the typed event table (see ``sources.events.normalize``).  The last
``retrieval`` and ``outcome`` row of a query wins, ordered by (ts, event_id).
Per-query state is built with aggregates that combine on the map side, so a
query id holding a large share of the log never lands in one task unreduced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlens import fixed_values as V
from memlens.common import clamp01, count_if, exact_medians, last_by, point_nodes, prefix_counts, ratio, stabbing_nodes, sums_and_latest, top_k
from memlens.functions.scores import strength_rank

ORDER = ["ts", "event_id"]
RETRIEVAL_COLS = ["shadow", "control_reason"]
OUTCOME_COLS = ["resolved", "tokens", "duration_ms", "control", "attribution"]


def of(log: DataFrame, *events: str) -> DataFrame:
    return log.where(F.col("event").isin(*events))


def last_retrievals(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return last_by(of(log, "retrieval"), [*by, "query_id"], ORDER, RETRIEVAL_COLS)


def last_outcomes(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return last_by(of(log, "outcome"), [*by, "query_id"], ORDER, OUTCOME_COLS)


def rank_col() -> Column:
    return strength_rank(F.col("match_signal"), F.col("match_score"), F.col("evidence_strength"))


def use_strength(log: DataFrame, item: str = "block", by: tuple[str, ...] = ()) -> DataFrame:
    """Strongest recorded use per (query, item)."""
    event, col = ("agent_used", "block_id") if item == "block" else ("fact_agent_used", "fact_id")
    return (of(log, event).groupBy(*by, "query_id", F.col(col).alias("item_id"))
            .agg(F.max(rank_col()).alias("strength_rank")))


def injected_pairs(log: DataFrame, item: str = "block", by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct injected (query, item) with the strongest use, in one shuffle."""
    inj, used, col = (("injection", "agent_used", "block_id") if item == "block"
                      else ("fact_injection", "fact_agent_used", "fact_id"))
    return (of(log, inj, used).groupBy(*by, "query_id", F.col(col).alias("item_id"))
            .agg(F.max(F.col("event") == inj).alias("injected"),
                 F.max(F.when(F.col("event") == used, rank_col())).alias("strength_rank"))
            .where("injected").drop("injected"))


# --- E1..E3 ---------------------------------------------------------------------

def event_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("event").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def retrieval_split(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct treatment and shadow queries (a query may be in both) and injected tokens."""
    per_query = of(log, "retrieval").groupBy(*by, "query_id").agg(
        F.max(~F.col("shadow")).alias("t"), F.max("shadow").alias("s"), F.sum("injected_tokens").alias("tok"))
    return per_query.groupBy(*by).agg(
        count_if(F.col("t")).alias("treatment"), count_if(F.col("s")).alias("shadow"),
        (count_if(F.col("t")) + count_if(F.col("s"))).alias("total"),
        F.coalesce(F.sum("tok"), F.lit(0)).alias("injected_tokens"))


def outcomes_with_arm(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Last outcome per query with the retrieval's shadow flag (outcome.control when unseen)."""
    r = last_retrievals(log, by).withColumn("seen", F.lit(True))
    return (last_outcomes(log, by).join(r, [*by, "query_id"], "left")
            .withColumn("in_shadow", F.coalesce("shadow", "control")))


def outcome_split(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    o = outcomes_with_arm(log, by)
    s, t = F.col("in_shadow"), ~F.col("in_shadow")
    agg = o.groupBy(*by).agg(
        count_if(t).alias("total_treatment"), count_if(s).alias("total_shadow"),
        count_if(t & F.col("resolved")).alias("resolved_treatment"),
        count_if(s & F.col("resolved")).alias("resolved_shadow"),
        F.avg(F.when(t, F.col("tokens"))).alias("mean_tokens_treatment"),
        F.avg(F.when(s, F.col("tokens"))).alias("mean_tokens_shadow"),
        F.avg(F.when(t, F.col("duration_ms"))).alias("mean_duration_treatment"),
        F.avg(F.when(s, F.col("duration_ms"))).alias("mean_duration_shadow"),
        F.count(F.when(t, F.col("tokens"))).alias("n_tokens_treatment"),
        F.count(F.when(s, F.col("tokens"))).alias("n_tokens_shadow"),
        F.count(F.when(t, F.col("duration_ms"))).alias("n_duration_treatment"),
        F.count(F.when(s, F.col("duration_ms"))).alias("n_duration_shadow"))
    return (agg.withColumn("resolved_lift", ratio(F.col("resolved_treatment"), F.col("total_treatment"))
                           - ratio(F.col("resolved_shadow"), F.col("total_shadow")))
            .withColumn("token_lift", F.col("mean_tokens_treatment") - F.col("mean_tokens_shadow")))


# --- E4 -------------------------------------------------------------------------------

def query_flags(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per query with every funnel flag."""
    keys = [*by, "query_id"]
    any_candidate = (F.size(F.coalesce("candidates", F.array())) > 0) | (F.size(F.coalesce("fact_candidates", F.array())) > 0)
    is_ = lambda *e: F.col("event").isin(*e)
    seen = (of(log, "retrieval", "injection", "fact_injection", "agent_used", "fact_agent_used").groupBy(*keys).agg(
        F.max(is_("retrieval")).alias("eligible"),
        F.max(is_("retrieval") & any_candidate).alias("recalled"),
        F.max(is_("retrieval") & ~F.col("shadow")).alias("treated"),
        F.max(is_("injection", "fact_injection")).alias("injected"),
        F.max(is_("agent_used", "fact_agent_used")).alias("used")))
    strong = (injected_pairs(log, "block", by).unionByName(injected_pairs(log, "fact", by))
              .groupBy(*keys).agg(F.max(F.coalesce(F.col("strength_rank"), F.lit(-1)) >= V.HELPFUL_RANK).alias("strong_use")))
    out = (seen.join(strong, keys, "left").join(last_outcomes(log, by), keys, "left")
           .withColumn("strong_use", F.coalesce("strong_use", F.lit(False))))
    helpful = F.col("injected") & F.col("used") & F.coalesce("resolved", F.lit(False)) & F.col("strong_use")
    return (out.withColumn("helpful", helpful)
            .withColumn("verified_helpful", helpful & (F.coalesce("attribution", F.lit("")) != "inferred")))


def funnel(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    flags = ["eligible", "recalled", "injected", "used", "helpful", "verified_helpful"]
    return query_flags(log, by).groupBy(*by).agg(*[count_if(F.col(f)).alias(f"{f}_runs") for f in flags])


# --- E5..E7 -----------------------------------------------------------------------------

COUNTERS = ["retrieved", "injected", "agent_used", "helpful", "verified_helpful", "counterproductive", "neutral"]


def per_item_stats(log: DataFrame, item: str = "block", by: tuple[str, ...] = ()) -> DataFrame:
    """Counters per block or fact; helpful/counterproductive/neutral only once an outcome exists."""
    cand = "candidates" if item == "block" else "fact_candidates"
    id_col = f"{item}_id"
    zero = F.lit(0).cast("bigint")
    retrieved = (of(log, "retrieval").select(*by, F.explode(cand).alias(id_col)).groupBy(*by, id_col)
                 .agg(F.count("*").alias("retrieved")))
    pairs = (injected_pairs(log, item, by).withColumnRenamed("item_id", id_col)
             .join(last_outcomes(log, by), [*by, "query_id"], "left"))
    has_outcome = F.col("resolved").isNotNull()
    strong = F.coalesce(F.col("strength_rank") >= V.HELPFUL_RANK, F.lit(False))
    helpful = has_outcome & strong & F.col("resolved")
    used = pairs.groupBy(*by, id_col).agg(
        F.count("*").alias("injected"), F.count("strength_rank").alias("agent_used"),
        count_if(helpful).alias("helpful"),
        count_if(helpful & (F.coalesce("attribution", F.lit("")) != "inferred")).alias("verified_helpful"),
        count_if(has_outcome & strong & ~F.col("resolved")).alias("counterproductive"),
        count_if(has_outcome & ~strong).alias("neutral"))
    return (retrieved.join(used, [*by, id_col], "full")
            .select(*by, id_col, *[F.coalesce(c, zero).alias(c) for c in COUNTERS]))


def rates(log: DataFrame) -> DataFrame:
    """Coverage plus hit, helpful and counterproductive rates of blocks and facts in one row."""
    parts = []
    for item, prefix in (("block", ""), ("fact", "fact_")):
        s = per_item_stats(log, item).agg(*[F.sum(c).alias(c) for c in ("injected", "agent_used", "helpful", "counterproductive")])
        parts.append(s.select(
            ratio(F.col("agent_used"), F.col("injected")).alias(f"{prefix}hit_rate"),
            ratio(F.col("helpful"), F.col("injected")).alias(f"{prefix}helpful_rate"),
            ratio(F.col("counterproductive"), F.col("injected")).alias(f"{prefix}counterproductive_rate")))
    q = query_flags(log).agg(count_if(F.col("treated")).alias("t"), count_if(F.col("treated") & F.col("injected")).alias("ti"))
    cov = q.select(F.coalesce(ratio(F.col("ti"), F.col("t")), F.lit(0.0)).alias("coverage"))
    return with_scalars(cov, *parts)


def with_scalars(base: DataFrame, *one_row: DataFrame) -> DataFrame:
    """Attach the columns of one-row frames as scalar subqueries (no join, no driver trip)."""
    for part in one_row:
        names = part.columns
        packed = part.select(F.struct(*names).alias("_s")).scalar()
        base = base.withColumn("_s", packed).select("*", *[F.col(f"_s.{n}").alias(n) for n in names]).drop("_s")
    return base


# --- E8..E9 --------------------------------------------------------------------------------

def causal_outcomes(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    injected = (of(log, "injection", "fact_injection").select(*by, "query_id").distinct()
                .withColumn("was_injected", F.lit(True)))
    o = outcomes_with_arm(log, by).join(injected, [*by, "query_id"], "left")
    arm = (F.when(F.col("in_shadow") & (F.col("control_reason") == "holdout"), "holdout")
           .when(~F.col("in_shadow") & F.col("was_injected"), "assisted"))
    return o.withColumn("arm", arm).where(F.col("arm").isNotNull())


def causal_cohorts(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return causal_outcomes(log, by).groupBy(*by, "arm").agg(
        F.count("*").alias("n"), count_if(F.col("resolved")).alias("resolved"),
        F.avg("tokens").alias("mean_tokens"), F.avg("duration_ms").alias("mean_duration_ms"),
        F.count("tokens").alias("n_tokens"), F.count("duration_ms").alias("n_durations"))


def integrity(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return outcomes_with_arm(log, by).groupBy(*by).agg(
        count_if(F.col("seen") & (F.col("shadow") != F.col("control"))).alias("shadow_control_mismatches"),
        count_if(F.col("seen").isNull()).alias("outcomes_without_retrieval"))


# --- E10..E11 --------------------------------------------------------------------------------

def calibration_points(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Every injection with an outcome as (prediction, label)."""
    keys = [*by, "query_id"]
    used = use_strength(log, "block", by).withColumnRenamed("item_id", "block_id")
    return (of(log, "injection").select(*keys, "block_id", "ts", "event_id", clamp01(F.col("score")).alias("prediction"))
            .join(last_outcomes(log, by), keys).join(used, [*keys, "block_id"], "left")
            .withColumn("label", (F.coalesce(F.col("strength_rank") >= V.HELPFUL_RANK, F.lit(False)) & F.col("resolved")).cast("int"))
            .select(*keys, "block_id", "ts", "event_id", "prediction", "label"))


def calibration(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Brier score and AUC with averaged ranks for ties.

    Points are counted per distinct prediction first; ranks come from two-level
    running sums of those counts.
    """
    distinct = calibration_points(log, by).groupBy(*by, "prediction").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    placed = prefix_counts(distinct, by, "prediction", F.floor(F.col("prediction") * 1024), ["n"])
    rank = F.col("before_n") + (F.col("n") + 1) / 2
    p = F.col("prediction")
    agg = placed.groupBy(*by).agg(
        F.sum("n").alias("scored"), F.sum("pos").alias("positives"),
        F.sum(F.col("pos") * rank).alias("rank_sum"),
        F.sum(F.col("pos") * (p - 1) * (p - 1) + (F.col("n") - F.col("pos")) * p * p).alias("sq"))
    pos, neg = F.col("positives"), F.col("scored") - F.col("positives")
    return agg.select(*by, F.col("scored").alias("scored_injections"), ratio(F.col("sq"), F.col("scored")).alias("brier_score"),
                      ratio(F.col("rank_sum") - pos * (pos + 1) / 2, pos * neg).alias("auc"))


def candidate_filtering(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    size = lambda c: F.size(F.coalesce(c, F.array()))
    is_ = lambda *e: F.col("event").isin(*e)
    agg = log.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(is_("retrieval") & ~F.col("shadow"), size("candidates") + size("fact_candidates"))), F.lit(0)).alias("candidates_seen"),
        count_if(is_("injection", "fact_injection")).alias("candidates_shown"),
        count_if(is_("calibrator_refit")).alias("refits"),
        F.max(F.when(is_("calibrator_refit"), F.col("ts"))).alias("last_refit_ts"),
        count_if(is_("drift_injection")).alias("drift_injections"))
    return (agg.withColumn("candidates_filtered", F.greatest(F.lit(0), F.col("candidates_seen") - F.col("candidates_shown")))
            .withColumn("candidate_filter_rate", ratio(F.col("candidates_filtered"), F.col("candidates_seen"))))


# --- E12..E14 ---------------------------------------------------------------------------------

def mechanism_totals(mech: DataFrame) -> DataFrame:
    """One row of totals over mechanism events; ``pending`` is the last reported value."""
    is_ = lambda *e: F.col("event").isin(*e)
    total = lambda name, cond, col: F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0)).alias(name)
    fam = lambda f: count_if(is_("tool_supervision.warned", "tool_supervision.suppressed") & (F.col("family") == f)).alias(f"supervised_{f}")
    order = F.when(is_("file_index.completed"), F.struct(*ORDER))
    return mech.agg(
        count_if(is_("file_index.completed")).alias("index_completed"),
        total("bytes_summarized", is_("file_index.completed"), "bytes"),
        F.max_by("pending", order).alias("index_pending"),
        count_if(is_("file_index.skipped")).alias("index_skipped"),
        count_if(is_("file_memory.recalled")).alias("file_recalls"),
        total("file_tokens_injected", is_("file_memory.recalled"), "tokens_after"),
        total("file_bytes_avoided", is_("file_memory.recalled"), "bytes"),
        count_if(is_("tool_supervision.warned")).alias("warned"),
        count_if(is_("tool_supervision.suppressed")).alias("suppressed"),
        *[fam(f) for f in V.FAMILY_TOKEN_ESTIMATE],
        count_if(is_("loop.redirected")).alias("redirects"), count_if(is_("loop.fallback")).alias("redirect_fallbacks"),
        count_if(is_("context.folded")).alias("folded"),
        total("fold_tokens_before", is_("context.folded"), "tokens_before"),
        total("fold_tokens_after", is_("context.folded"), "tokens_after"),
        count_if(is_("context.fold_skipped")).alias("fold_skipped"),
        count_if(is_("store.injection_rejected")).alias("injection_rejected"),
        count_if(is_("cache.prompt_hit")).alias("cache_hits"),
        total("cache_tokens_saved", is_("cache.prompt_hit"), "tokens_before"))


def arbitration_matrix(dec: DataFrame) -> DataFrame:
    """Capability x action counts with token sums."""
    return dec.groupBy("capability").agg(
        *[count_if(F.col("action") == a).alias(a) for a in ("inject", "suppress", "shadow")],
        F.sum(F.when(F.col("action") == "inject", F.greatest(F.lit(0), F.col("injection_tokens"))).otherwise(0)).alias("injected_tokens"),
        F.sum(F.when(F.col("action") == "suppress", F.greatest(F.lit(0), F.col("injection_tokens"))).otherwise(0)).alias("suppressed_tokens"),
        F.sum(F.when(F.col("action") == "inject", F.col("expected_net")).otherwise(0.0)).alias("injected_net"))


def arbitration_reasons(dec: DataFrame) -> DataFrame:
    """Decisions per reason and action."""
    return dec.groupBy("reason").agg(*[count_if(F.col("action") == a).alias(a) for a in ("inject", "suppress", "shadow")], F.count("*").alias("decisions"))


def arbitration_totals(dec: DataFrame, log: DataFrame) -> DataFrame:
    """Decisions against what was really put in the prompt for reuse queries."""
    reuse = dec.where("capability = 'reasoning_reuse'").groupBy("query_id").agg(
        count_if(F.col("action") == "inject").alias("inject_decisions"))
    visible = (injected_pairs(log, "block").select("query_id", "item_id").unionByName(
        injected_pairs(log, "fact").select("query_id", "item_id")).groupBy("query_id").agg(F.count("*").alias("visible")))
    truth = reuse.join(visible, "query_id", "left").agg(
        F.coalesce(F.sum("inject_decisions"), F.lit(0)).alias("inject_decisions"),
        F.coalesce(F.sum("visible"), F.lit(0)).alias("prompt_visible_items"))
    base = dec.agg(F.count("*").alias("decisions"), F.countDistinct("query_id").alias("queries_with_decisions"))
    return with_scalars(base, truth).withColumn("divergence", F.col("inject_decisions") - F.col("prompt_visible_items"))


def mechanism_savings(mech: DataFrame) -> DataFrame:
    positive = lambda c: F.coalesce(F.sum(F.greatest(F.lit(0), c)), F.lit(0))
    is_ = lambda e: F.col("event") == e
    estimate = F.lit(0)
    for fam, tok in V.FAMILY_TOKEN_ESTIMATE.items():
        estimate = F.when(F.col("family") == fam, tok).otherwise(estimate)
    avoided = ((is_("tool_supervision.warned") & (F.col("mode") == "block"))
               | (is_("tool_supervision.suppressed") & (F.col("mode") == "block")))
    out = mech.agg(
        positive(F.when(is_("context.folded"), F.col("tokens_before") - F.col("tokens_after"))).alias("context_saved"),
        positive(F.when(is_("file_memory.recalled"), F.ceil(F.col("bytes") / 4) - F.col("tokens_after"))).alias("file_saved"),
        F.coalesce(F.sum(F.when(avoided, estimate)), F.lit(0)).alias("supervision_saved"),
        positive(F.when(is_("cache.prompt_hit"), F.col("tokens_before"))).alias("cache_saved"))
    return out.withColumn("total_saved", F.col("context_saved") + F.col("file_saved") + F.col("supervision_saved") + F.col("cache_saved"))


# --- E15 -----------------------------------------------------------------------------------

def impact(log: DataFrame) -> DataFrame:
    blocks = per_item_stats(log, "block").agg(
        F.coalesce(F.sum("helpful"), F.lit(0)).alias("helped_tasks"),
        F.coalesce(F.sum("verified_helpful"), F.lit(0)).alias("verified_helped_tasks"),
        count_if(F.col("agent_used") > 0).alias("memories_used"))
    o = outcome_split(log).select("token_lift", "resolved_lift", "total_treatment")
    q = query_flags(log).agg(count_if(F.col("treated") & F.col("injected")).alias("assisted_tasks"))
    measured = F.col("token_lift").isNotNull() & F.col("resolved_lift").isNotNull()
    tokens = (F.when(measured & (F.col("token_lift") < 0), F.round(-F.col("token_lift") * F.col("total_treatment")).cast("bigint"))
              .when(measured, F.lit(0).cast("bigint")).otherwise(F.col("helped_tasks") * V.IMPACT_TOKENS_PER_HELP))
    return (with_scalars(q, blocks, o)
            .withColumn("confidence", F.when(measured, F.lit("measured")).otherwise(F.lit("estimated")))
            .withColumn("minutes_saved", F.col("helped_tasks") * V.IMPACT_MINUTES_PER_HELP)
            .withColumn("tokens_saved", tokens)
            .select("assisted_tasks", "helped_tasks", "verified_helped_tasks", "memories_used", "confidence",
                    "minutes_saved", "tokens_saved"))


def impact_lists(log: DataFrame, n: int = V.IMPACT_TOP_N) -> DataFrame:
    """Top memories and those needing attention, best ``n`` of each (ties by id)."""
    s = per_item_stats(log, "block")
    parts = []
    for name, col in (("top", "helpful"), ("attention", "counterproductive")):
        best = s.where(F.col(col) > 0).select(F.lit(name).alias("list"), "block_id", F.col(col).alias("score"), "injected")
        parts.append(top_k(best, ["list"], [F.desc("score"), F.asc("block_id")], n))
    return parts[0].unionByName(parts[1])


# --- E18..E20 --------------------------------------------------------------------------------------

def cascade_compare(log: DataFrame, by: tuple[str, ...] = (), cross_day: bool = False) -> DataFrame:
    """Two arms by whether a query ever retrieved with a policy id; one row per arm.

    With ``by=('day',)`` every join stays inside a day: an outcome on the next
    UTC day is lost, as defined.  With ``cross_day`` a query's injections and its last
    outcome count for every day it retrieved on, whenever they came.
    """
    keys = [*by, "query_id"]
    within = () if cross_day else by
    own = [*within, "query_id"]
    has_policy = F.coalesce(F.col("policy_id"), F.lit("")) != ""
    ret = of(log, "retrieval").withColumn("arm", F.when(has_policy, "cascade").otherwise("sync"))
    arms = (ret.groupBy(*keys).agg(F.max(has_policy).alias("c"))
            .select(*keys, F.when(F.col("c"), "cascade").otherwise("sync").alias("arm")))
    retrievals = ret.groupBy(*by, "arm").agg(
        F.count("*").alias("retrievals"),
        count_if((F.col("arm") == "cascade") & ~F.col("fell_back") & F.col("reranker_name").isNotNull()).alias("reranker_ran"),
        *[count_if((F.col("arm") == "cascade") & F.col("fell_back") & (F.col("fallback_reason") == x)).alias(f"fallback_{x}")
          for x in ("timeout", "error", "null", "empty", "validation")])
    pairs = (injected_pairs(log, "block", within).groupBy(*own)
             .agg(F.max(F.coalesce(F.col("strength_rank") >= V.HELPFUL_RANK, F.lit(False))).alias("strong")))
    per_query = (arms.join(pairs, own, "left").join(last_outcomes(log, within), own, "left"))
    stats = per_query.groupBy(*by, "arm").agg(
        count_if(F.col("strong").isNotNull()).alias("injections"),
        count_if(F.col("resolved").isNotNull()).alias("total_runs"),
        count_if(F.col("resolved") & F.coalesce("strong", F.lit(False))).alias("helpful_runs"))
    return (retrievals.join(stats, [*by, "arm"], "left")
            .withColumn("helpful_rate", ratio(F.col("helpful_runs"), F.col("total_runs"))))


def cascade_lift(compared: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    pick = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    runs = lambda arm: F.coalesce(pick(arm, "total_runs"), F.lit(0))
    return compared.groupBy(*by).agg(
        (pick("cascade", "helpful_rate") - pick("sync", "helpful_rate")).alias("lift"),
        ((runs("cascade") < V.MIN_CASCADE_SAMPLE) | (runs("sync") < V.MIN_CASCADE_SAMPLE)).alias("low_sample"))


def with_day(log: DataFrame) -> DataFrame:
    """UTC day of the row, from the epoch value so that the session zone plays no part."""
    return log.withColumn("day", F.date_from_unix_date(F.floor(F.col("ts") / V.DAY_MS).cast("int")).cast("string"))


def explain_query(log: DataFrame) -> DataFrame:
    """Arm, slate size, distinct injected and used items and the outcome of every query."""
    ret = last_by(of(log, "retrieval").withColumn("selected", F.size("candidates")), ["query_id"], ORDER,
                  ["policy_id", "selected", "shadow"])
    items = of(log, "injection", "fact_injection", "agent_used", "fact_agent_used").groupBy("query_id").agg(
        *[F.array_join(F.array_sort(F.collect_set(F.when(F.col("event") == e, F.col(c)))), ",").alias(n)
          for e, c, n in (("injection", "block_id", "injected_blocks"), ("fact_injection", "fact_id", "injected_facts"),
                          ("agent_used", "block_id", "used_blocks"), ("fact_agent_used", "fact_id", "used_facts"))])
    out = last_outcomes(log).select("query_id", "resolved", "duration_ms")
    joined = ret.join(items, "query_id", "full").join(out, "query_id", "full")
    return joined.select(
        "query_id", F.when(F.col("selected").isNull(), F.lit(None)).when(F.coalesce("policy_id", F.lit("")) != "", "cascade").otherwise("sync").alias("arm"),
        "selected", "shadow", *[F.coalesce(c, F.lit("")).alias(c) for c in ("injected_blocks", "injected_facts", "used_blocks", "used_facts")],
        "resolved", "duration_ms")


# --- E25, E26, E30, E31 ------------------------------------------------------------------------------

def paired_runs(runs: DataFrame) -> DataFrame:
    """Off/on runs of one task side by side: one conditional aggregate instead of a self-join."""
    off, on = F.col("arm") == "off", F.col("arm") == "on"
    v = lambda arm, c: F.max(F.when(arm, F.col(c)))
    p = runs.groupBy("task", "agent").agg(
        *[v(off, c).alias(f"off_{c}") for c in ("duration_ms", "tool_calls", "tokens", "passed")],
        *[v(on, c).alias(f"on_{c}") for c in ("duration_ms", "tool_calls", "tokens", "passed", "injected_tokens", "blocked_calls")])
    p = p.where(F.col("off_passed").isNotNull() & F.col("on_passed").isNotNull())
    raw = F.col("off_tokens") - F.col("on_tokens")
    agree = (F.when(F.col("off_passed") & F.col("on_passed"), "both-pass")
             .when(~F.col("off_passed") & ~F.col("on_passed"), "both-fail")
             .when(F.col("off_passed"), "off-pass-on-fail").otherwise("off-fail-on-pass"))
    return p.select("task", "agent", (F.col("off_duration_ms") - F.col("on_duration_ms")).alias("time_ms"),
                    (F.col("off_tool_calls") - F.col("on_tool_calls")).alias("tool_calls"), raw.alias("tokens_raw"),
                    (raw - F.coalesce("on_injected_tokens", F.lit(0))).alias("tokens_net"),
                    F.coalesce("on_injected_tokens", F.lit(0)).alias("injected_tokens"),
                    F.coalesce("on_blocked_calls", F.lit(0)).alias("blocked_calls"),
                    F.col("off_passed"), F.col("on_passed"), agree.alias("agreement"))


def run_metrics(runs: DataFrame) -> DataFrame:
    """Per arm: success rate, means, both medians, totals, recall hit rate."""
    base = runs.groupBy("arm").agg(
        F.count("*").alias("n"), ratio(count_if(F.col("passed")), F.count("*")).alias("success_rate"),
        F.avg("tokens").alias("avg_tokens"), F.sum("tokens").alias("total_tokens"), F.avg("duration_ms").alias("avg_duration_ms"),
        ratio(count_if(F.col("injected_tokens") > 0), F.count("*")).alias("recall_hit_rate"))
    med = exact_medians(runs, ["arm"], "tokens", 1000.0)
    return base.join(med, "arm").withColumnRenamed("median_avg", "median_tokens").withColumnRenamed("median_upper", "median_tokens_upper")


def run_delta(runs: DataFrame) -> DataFrame:
    """Baseline against augmented; savings per task only where both passed."""
    pick = lambda arm, c: F.avg(F.when(F.col("arm") == arm, F.col(c)))
    means = runs.withColumn("ok", F.col("passed").cast("double")).agg(
        *[pick(a, c).alias(f"{a}_{c}") for a in ("off", "on") for c in ("ok", "tokens", "duration_ms")])
    pairs = runs.groupBy("task").agg(
        F.max(F.when((F.col("arm") == "off") & F.col("passed"), F.col("tokens"))).alias("b"),
        F.max(F.when((F.col("arm") == "on") & F.col("passed"), F.col("tokens"))).alias("a"))
    save = F.when(F.col("b") > 0, (F.col("b") - F.col("a")) / F.col("b"))
    peak = pairs.agg((F.avg(save) * 100).alias("avg_token_save"), (F.max(save) * 100).alias("peak_token_save"))
    pct = lambda c: ratio((F.col(f"off_{c}") - F.col(f"on_{c}")) * 100, F.col(f"off_{c}"))
    return with_scalars(means, peak).select(
        ((F.col("on_ok") - F.col("off_ok")) * 100).alias("success_delta_pp"), pct("tokens").alias("token_savings_pct"),
        pct("duration_ms").alias("time_reduction_pct"), "avg_token_save", "peak_token_save")


def condition_report(runs: DataFrame) -> DataFrame:
    base = runs.groupBy("condition").agg(
        F.count("*").alias("n"), count_if(F.col("passed")).alias("resolved"),
        ratio(count_if(F.col("passed")), F.count("*")).alias("resolved_rate"),
        F.avg("duration_ms").alias("avg_duration_ms"), F.avg("tokens").alias("avg_tokens"), F.avg("steps").alias("avg_steps"),
        ratio(count_if(F.col("regressed")), F.count("*")).alias("regressed_rate"),
        ratio(count_if(F.col("had_injection")), F.count("*")).alias("injection_rate"),
        F.coalesce(ratio(count_if(F.col("had_injection") & (F.col("used_ids") > 0)), count_if(F.col("had_injection"))), F.lit(0.0)).alias("used_after_injection_rate"))
    med = exact_medians(runs, ["condition"], "duration_ms", 10_000.0).select("condition", F.col("median_avg").alias("median_duration_ms"))
    return base.join(med, "condition")


def condition_lift(report: DataFrame, reference: str) -> DataFrame:
    """The reference condition against every other one; the report has one row per condition."""
    ref = report.where(F.col("condition") == reference).select(F.struct("resolved_rate", "avg_duration_ms", "n").alias("r")).scalar()
    return (report.where(F.col("condition") != reference).withColumn("_r", ref).select(
        F.col("condition").alias("vs"), (F.col("_r.resolved_rate") - F.col("resolved_rate")).alias("resolved_lift"),
        (F.col("_r.avg_duration_ms") - F.col("avg_duration_ms")).alias("duration_delta_ms"),
        F.col("_r.n").alias("n_reference"), F.col("n").alias("n_comparator")))


def agent_summary(paired: DataFrame) -> DataFrame:
    return paired.groupBy("agent").agg(
        F.count("*").alias("tasks"), count_if(F.col("off_passed")).alias("off_solved"), count_if(F.col("on_passed")).alias("on_solved"),
        F.sum("tokens_net").alias("net_tokens"), F.sum("injected_tokens").alias("injected_tokens"), F.sum("blocked_calls").alias("blocked_calls"))


def status_matrix(paired: DataFrame, agents: list[str]) -> DataFrame:
    """Task x agent cells: PASS, FAIL or the change between them."""
    word = lambda c: F.when(F.col(c), "PASS").otherwise("FAIL")
    cell = F.when(F.col("off_passed") == F.col("on_passed"), word("on_passed")).otherwise(F.concat(word("off_passed"), F.lit("->"), word("on_passed")))
    out = paired.withColumn("cell", cell).groupBy("task").pivot("agent", agents).agg(F.max("cell"))
    return out.fillna("-", subset=agents)


# --- E24, E27..E29, E32 ---------------------------------------------------------------------------------

def tool_obs_stats(obs: DataFrame, after_ms: int | None = None, before_ms: int | None = None) -> DataFrame:
    """Calls per (session, arg_key, tool) in [after, before)."""
    if after_ms is not None:
        obs = obs.where(F.col("ts") >= after_ms)
    if before_ms is not None:
        obs = obs.where(F.col("ts") < before_ms)
    return obs.groupBy("session_id", "arg_key", "tool_name").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def contributors(samples: DataFrame) -> DataFrame:
    return samples.agg(F.countDistinct("installation_id").alias("installations"), F.countDistinct("project_id").alias("projects"),
                       F.count("*").alias("samples"))


def resolve_feedback(feedback: DataFrame, retrieved: DataFrame, lookback_ms: int = 3_600_000) -> DataFrame:
    """Which retrieval a piece of feedback answers.

    ``feedback(feedback_id, trace_id, ts, query_id?)``; ``retrieved(query_id, trace_id, ts)`` holds one row per returned item.
    Explicit query ids are matched directly.  The others get the latest retrieval of their trace that is open: a retrieval is
    open from its own time for ``lookback_ms``, and no longer than until explicit feedback credits it.

    No pair of feedback and retrieval is formed.  How many retrievals are open is a running sum of openings and closings; the
    latest of those that nothing credits is an as-of join; of the credited ones, whose ends follow no order, each
    lies on the dyadic nodes of its time span, and feedback looks its own nodes up.  A trace with a third of all rows is spread
    over its time buckets.
    """
    pair, first = ["query_id", "trace_id"], F.min(F.struct("ts", "feedback_id")).alias("first")
    explicit = feedback.where(F.col("query_id").isNotNull())
    hits = retrieved.groupBy(*pair).agg(F.min("ts").alias("r_ts"))
    credited = explicit.groupBy(*pair).agg(first)
    exp = (explicit.join(hits, pair, "left").join(credited, pair)
           .select("feedback_id", "trace_id", F.when(F.col("r_ts").isNotNull(), F.col("query_id")).alias("resolved_query"),
                   F.lit(False).alias("ambiguous"), (F.col("first.feedback_id") != F.col("feedback_id")).alias("already_credited")))

    open_ = feedback.where(F.col("query_id").isNull()).select("feedback_id", "trace_id", F.col("ts").alias("f_ts"))
    spans = retrieved.join(credited.select(*pair, F.col("first.ts").alias("c_ts")), pair, "left").select(
        "trace_id", "c_ts", F.col("ts").alias("low"), F.least(F.col("ts") + (lookback_ms - 1), "c_ts").alias("high"), F.struct(F.col("ts").alias("r_ts"), "query_id").alias("hit")).where("low <= high")
    # places on the time line: openings, then feedback, then closings of one millisecond
    at = lambda ts, place: F.col(ts) * 4 + place
    none = F.lit(None).cast(spans.schema["hit"].dataType)
    mark = lambda place, delta, hit: F.struct(place.alias("at"), F.lit(delta).alias("delta"), hit.alias("hit"))
    both = F.array(mark(at("low", 0), 1, F.when(F.col("c_ts").isNull(), F.col("hit"))), mark(at("high", 2), -1, none))
    marks = spans.select("trace_id", F.explode(both).alias("m")).select("trace_id", "m.*").unionAll(open_.select("trace_id", at("f_ts", 1).alias("at"), F.lit(0), none))
    line = marks.groupBy("trace_id", "at").agg(F.sum("delta").alias("delta"), F.max("hit").alias("hit"))
    walked = sums_and_latest(line, ["trace_id"], "at", F.floor(F.col("at") / (4 * lookback_ms)), "delta", "hit").select("trace_id", "at", F.col("before").alias("n"), "latest")

    bits = max(lookback_ms - 1, 1).bit_length()
    tiles = (spans.where(F.col("c_ts").isNotNull()).select("trace_id", "hit", F.explode(stabbing_nodes(F.col("low"), F.col("high"), bits)).alias("node"))
             .groupBy("trace_id", "node").agg(F.max("hit").alias("hit")))
    held = (open_.select("feedback_id", "trace_id", F.explode(point_nodes(F.col("f_ts"), bits)).alias("node")).join(tiles, ["trace_id", "node"])
            .groupBy("feedback_id").agg(F.max("hit").alias("held")))

    placed = open_.withColumn("at", at("f_ts", 1)).join(walked, ["trace_id", "at"], "left").join(held, "feedback_id", "left")
    alive = F.when(F.col("latest.r_ts") > F.col("f_ts") - lookback_ms, F.col("latest"))
    imp = placed.select("feedback_id", "trace_id", F.greatest(alive, F.col("held"))["query_id"].alias("resolved_query"),
                        (F.coalesce("n", F.lit(0)) > 1).alias("ambiguous"), F.lit(False).alias("already_credited"))
    return exp.unionByName(imp)


def injected_and_used(log: DataFrame, claims: DataFrame) -> DataFrame:
    """Per claim (query_id, used_pattern, used_blocks?) the credited blocks.

    Named ids count only when injected; a blanket yes credits every injected block.
    """
    injected = of(log, "injection").select("query_id", "block_id").distinct()
    named = claims.where(F.col("used_blocks").isNotNull()).select("query_id", F.explode("used_blocks").alias("block_id")).distinct()
    blanket = claims.where(F.col("used_blocks").isNull() & F.col("used_pattern")).select("query_id").distinct()
    return injected.join(named, ["query_id", "block_id"], "left_semi").unionByName(injected.join(blanket, "query_id", "left_semi"))


def index_coverage(scanned: DataFrame) -> DataFrame:
    """Files per state, and per reason for the skipped ones."""
    return scanned.groupBy("state", F.coalesce("reason", F.lit("-")).alias("reason")).agg(
        F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
