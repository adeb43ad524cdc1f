"""Upkeep of memory tables: dedupe, merge, upsert, expire, demote, health (D operators).

Every operator returns new tables; nothing is changed in place.  A store update
is one aggregate plus equi-joins, so it can run over any number of workspaces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlens import fixed_values as V
from memlens.common import count_if, ratio, top_k, with_position
from memlens.functions import text as T
from memlens.functions.scores import wilson_lower
from memlens.operators.retrieval import keyed_sets, set_copies, set_members
from memlens.operators.sketches import similar

COUNTERS = ["times_retrieved", "times_injected", "times_agent_used", "times_helpful", "times_counterproductive", "tokens_saved", "steps_saved"]

# --- D1, D2 -----------------------------------------------------------------------------


def dedupe_traces(new: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Earliest trace per fingerprint that the store does not hold yet."""
    if stored is not None:
        new = new.join(stored.select("fingerprint").distinct(), "fingerprint", "left_anti")
    keep = new.groupBy("fingerprint").agg(F.min(F.struct("created_at", "trace_id")).alias("m")).select(F.col("m.trace_id").alias("trace_id"))
    return new.join(keep, "trace_id", "left_semi")


def merge_blocks(blocks: DataFrame) -> DataFrame:
    """Per (fingerprint, kind) the oldest block wins: counters summed, last use = max, losers ``merged``."""
    order = F.struct("created_at", "block_id")
    groups = blocks.groupBy("fingerprint", "kind").agg(
        F.min_by("block_id", order).alias("winner_id"), *[F.sum(c).alias(f"_{c}") for c in COUNTERS], F.max("last_used_at").alias("_last"), F.count("*").alias("group_size"))
    j = blocks.join(groups, ["fingerprint", "kind"])
    won = F.col("block_id") == F.col("winner_id")
    return j.select("block_id", "kind", "winner_id", F.when(won, F.col("status")).otherwise("merged").alias("status"),
                    *[F.when(won, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in COUNTERS],
                    F.when(won, F.col("_last")).otherwise(F.col("last_used_at")).alias("last_used_at"), "group_size")


def repoint_refs(refs: DataFrame, merged: DataFrame, arrivals_support: bool = False) -> DataFrame:
    """Case refs moved to the winner, each (block, trace, role) once.

    ``arrivals_support`` turns a loser's origin into a supporting ref, as for a
    block arriving with a known fingerprint.
    """
    j = refs.join(merged.select("block_id", "winner_id"), "block_id")
    role = F.when((F.col("block_id") != F.col("winner_id")) & (F.col("role") == "origin"), "supporting").otherwise(F.col("role")) if arrivals_support else F.col("role")
    return j.select(F.col("winner_id").alias("block_id"), "trace_id", role.alias("role")).distinct()


# --- D3, D4 -------------------------------------------------------------------------------


def fact_key(scope: Column, fact_type: Column, statement: Column) -> Column:
    norm = F.regexp_replace(F.lower(T.trim_ws(statement)), r"\s+", " ")
    return F.sha2(F.concat_ws("|", scope, fact_type, norm), 256)


def upsert_facts(stored: DataFrame, incoming: DataFrame, now_ms: int) -> DataFrame:
    """``incoming(scope, fact_type, statement, confidence, ttl_days, seq)`` applied to ``stored(dedupe_key, ...)``.

    A repeat adds 0.05 confidence (at most 1) and reactivates unless retired; the
    first statement of a new key is kept.  Leaking or injecting statements are dropped.
    """
    ok = T.leakage(F.col("statement")).isNull() & T.prompt_injection(F.col("statement")).isNull()
    # the verdict is a column and no filter: a filter would sink below a repartitioning of the input, where few tasks scan all texts
    fresh = incoming.withColumn("_ok", ok).withColumn("dedupe_key", fact_key(F.col("scope"), F.col("fact_type"), F.col("statement")))
    first = F.struct("scope", "fact_type", "statement", "confidence", "ttl_days")
    taken = lambda c: F.when(F.col("_ok"), c)
    per = fresh.groupBy("dedupe_key").agg(F.min_by(taken(first), taken(F.col("seq"))).alias("n"), count_if(F.col("_ok")).alias("arrivals")).where("arrivals > 0")
    j = stored.withColumn("_stored", F.lit(True)).join(per, "dedupe_key", "full")
    old, hit = F.col("_stored").isNotNull(), F.col("arrivals").isNotNull()
    repeats = F.when(old, F.coalesce("arrivals", F.lit(0))).otherwise(F.col("arrivals") - 1)
    start = F.when(old, F.col("confidence")).otherwise(F.coalesce("n.confidence", F.lit(0.5)))
    ttl = F.when(F.col("n.ttl_days") > 0, F.lit(now_ms) + F.floor(F.col("n.ttl_days") * V.DAY_MS))
    return j.select(
        "dedupe_key", *[F.when(old, F.col(c)).otherwise(F.col(f"n.{c}")).alias(c) for c in ("scope", "fact_type", "statement")],
        F.when(repeats > 0, F.least(F.lit(1.0), start + 0.05 * repeats)).otherwise(start).alias("confidence"),
        F.when(~old, "active").when(hit & (F.col("status") != "retired"), "active").otherwise(F.col("status")).alias("status"),
        F.when(hit, F.lit(now_ms)).otherwise(F.col("verified_at")).alias("verified_at"),
        F.when(old, F.col("ttl_until")).otherwise(ttl).alias("ttl_until"),
        F.when(~old, "inserted").when(hit, "confirmed").otherwise("kept").alias("action"))


def expire(facts: DataFrame, now_ms: int) -> DataFrame:
    past = F.col("ttl_until").isNotNull() & (F.col("ttl_until") <= now_ms) & (F.col("status") != "retired")
    marked = facts.withColumn("expired", F.coalesce(past, F.lit(False)))
    return marked.withColumn("status", F.when(F.col("expired"), "retired").otherwise(F.col("status")))


# --- D5..D9 ----------------------------------------------------------------------------------


def prune_traces(traces: DataFrame, threshold: float, max_count: int) -> DataFrame:
    """Recalled traces under the threshold go, then the oldest beyond ``max_count``.

    The cut is found from dense positions (newest first) built from counts per
    hour and second, not from one global sort.
    """
    kept = traces.where(~((F.col("q_score") < threshold) & (F.col("recall_count") > 0)))
    placed = with_position(kept.withColumn("_all", F.lit(0)).withColumn("_age", -F.col("created_at")), "_all", "_age", "trace_id", "_pos")
    return placed.where(F.col("_pos") < max_count).drop("_all", "_age", "_pos")


def orphan_refs(refs: DataFrame, traces: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(refs with role ``orphan`` where the trace is gone, blocks that lost their last origin -> candidate)."""
    alive = traces.select("trace_id").distinct().withColumn("_alive", F.lit(True))
    r = refs.join(alive, "trace_id", "left").withColumn("old_role", F.col("role")).withColumn(
        "role", F.when(F.col("_alive"), F.col("role")).otherwise("orphan")).drop("_alive")
    origins = r.groupBy("block_id").agg(F.max(F.col("old_role") == "origin").alias("had"), F.max(F.col("role") == "origin").alias("has"))
    lost = origins.where(F.col("had") & ~F.col("has")).select("block_id", F.lit(True).alias("_lost"))
    b = blocks.join(lost, "block_id", "left").withColumn(
        "status", F.when(F.col("_lost") & (F.col("status") == "active"), "candidate").otherwise(F.col("status"))).drop("_lost")
    return r.drop("old_role"), b


def status_integrity(blocks: DataFrame, refs: DataFrame) -> DataFrame:
    """Violations of active blocks and the status each should have."""
    r = refs.groupBy("block_id").agg(F.max(F.col("role") == "origin").alias("origin"), F.max(F.col("role") == "counter").alias("counter"))
    j = blocks.where("status = 'active'").join(r, "block_id", "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    issue = F.when(has("counter"), "active-with-counter").when(~has("origin"), "active-without-origin")
    return j.withColumn("violation", issue).where(F.col("violation").isNotNull()).select(
        "block_id", "violation", F.when(F.col("violation") == "active-with-counter", "demoted").otherwise("candidate").alias("new_status"))


def erase(table: DataFrame, ids: DataFrame, id_col: str, reason: str, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(rows left, audit rows without any body)."""
    gone = ids.select(id_col).distinct()
    audit = table.join(gone, id_col, "left_semi").select(id_col, F.lit(now_ms).alias("deleted_at"), F.lit(reason).alias("reason"))
    return table.join(gone, id_col, "left_anti"), audit


def list_blocks(blocks: DataFrame, status: str | None, order_by: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    rows = blocks if status is None else blocks.where(F.col("status") == status)
    return rows.orderBy(*order_by).offset(offset).limit(limit)


def count_by_status(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("status").agg(F.count("*").alias("n"))


# --- D10..D13 -----------------------------------------------------------------------------------


def sync_block_stats(blocks: DataFrame, log: DataFrame) -> DataFrame:
    """Counters overwritten from the log, Wilson bound refreshed, last use = latest injection or use."""
    from memlens.operators.analytics import of, per_item_stats
    stats = per_item_stats(log, "block")
    last = of(log, "injection", "agent_used").groupBy("block_id").agg(F.max("ts").alias("used_at"))
    j = blocks.join(stats, "block_id", "left").join(last, "block_id", "left")
    seen = F.col("retrieved").isNotNull()
    pick = lambda new, old: F.when(seen, F.col(new)).otherwise(F.col(old)).alias(old)
    out = j.select("block_id", "kind", "status", "created_at", "verification_status",
                   pick("retrieved", "times_retrieved"), pick("injected", "times_injected"), pick("agent_used", "times_agent_used"),
                   pick("helpful", "times_helpful"), pick("counterproductive", "times_counterproductive"),
                   F.coalesce("used_at", "last_used_at").alias("last_used_at"), seen.alias("synced"))
    return out.withColumn("wilson", wilson_lower(F.col("times_helpful"), F.col("times_injected")))


def orphan_event_blocks(blocks: DataFrame, log: DataFrame) -> DataFrame:
    from memlens.operators.analytics import per_item_stats
    return per_item_stats(log, "block").join(blocks.select("block_id"), "block_id", "left_anti").select("block_id")


def demote_rules(blocks: DataFrame) -> DataFrame:
    """Reason to demote each active block, or null."""
    enough = F.col("times_injected") >= V.DEMOTE_MIN_INJECTIONS
    counter = F.col("times_counterproductive") / F.greatest(F.lit(1), F.col("times_helpful"))
    reason = (F.when(F.col("verification_status") == "disproved", "verification:disproved")
              .when(~enough, F.lit(None))
              .when(F.col("wilson") < V.DEMOTE_WILSON, F.concat(F.lit("wilson-lb:"), F.format_string("%.3f", F.round("wilson", 3))))
              .when(counter >= V.DEMOTE_COUNTER_RATIO, F.concat(F.lit("counter-ratio:"), F.format_string("%.2f", F.round(counter, 2)))))
    return blocks.where("status = 'active'").select("block_id", reason.alias("reason")).withColumn(
        "new_status", F.when(F.col("reason").isNotNull(), "demoted").otherwise("active"))


def near_duplicate_blocks(blocks: DataFrame, threshold: float = V.HEALTH["dup_jaccard"]) -> DataFrame:
    """(block_id, duplicate_hits): siblings whose keywords are similar enough.

    Equal keyword sets are one set with a count, so a group of copies of any size
    costs one set; near sets meet by their rarest words.  Hits add up counts.
    """
    keyed = keyed_sets(blocks, "block_id", F.array_distinct("keywords"))
    members = set_members(keyed, "block_id")
    copies = set_copies(members)
    near = similar(keyed, keyed, threshold, same=True, hits=True).groupBy("set_id").agg(F.sum("near").alias("near"))
    hits = copies.join(near, "set_id", "left").select("set_id", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("duplicate_hits"))
    return members.join(hits, "set_id", "left").select("block_id", F.coalesce("duplicate_hits", F.lit(0)).alias("duplicate_hits"))


def memory_health(blocks: DataFrame, log: DataFrame, now_ms: int, config: dict | None = None) -> DataFrame:
    """Health of every active block with its parts, reasons and whether it would be demoted."""
    from memlens.operators.analytics import per_item_stats
    c = {**V.HEALTH, **(config or {})}
    active = blocks.where("status = 'active'")
    # the join carries how many keywords a block has, not the keywords
    rows = active.select("block_id", "created_at", "last_used_at", F.size("keywords").alias("n_keywords"))
    j = rows.join(per_item_stats(log, "block"), "block_id", "left").join(near_duplicate_blocks(active, c["dup_jaccard"]), "block_id")
    z = lambda x: F.coalesce(F.col(x), F.lit(0))
    trials = z("helpful") + z("counterproductive") + z("neutral")
    pen = lambda share, most: F.least(F.lit(most), F.greatest(F.lit(0.0), share * most))
    days = F.greatest(F.lit(0.0), (F.lit(now_ms) - F.coalesce("last_used_at", "created_at")) / V.DAY_MS)
    n_kw, rate = F.col("n_keywords"), z("helpful") / F.col("labeled_trials")
    roi = F.when((F.col("labeled_trials") < c["roi_min_injections"]) | (rate >= c["roi_helpful_floor"]), 0.0).otherwise(
        pen((c["roi_helpful_floor"] - rate) / c["roi_helpful_floor"], c["roi_max"]))
    h = (j.withColumn("labeled_trials", trials).withColumn("pending_injected", F.greatest(F.lit(0), z("injected") - F.col("labeled_trials")))
         .withColumn("wilson", wilson_lower(z("helpful"), F.col("labeled_trials")))
         .withColumn("counter_rate", F.coalesce(ratio(z("counterproductive"), F.col("labeled_trials")), F.lit(0.0)))
         .withColumn("stale", pen(days / (2 * c["stale_half_life_days"]), c["stale_max"]))
         .withColumn("duplication", F.least(F.lit(c["dup_max"]), F.col("duplicate_hits") * c["dup_per_hit"]))
         .withColumn("generic", F.when(n_kw >= c["generic_min_keywords"], 0.0).otherwise(pen((c["generic_min_keywords"] - n_kw) / c["generic_min_keywords"], c["generic_max"])))
         .withColumn("negative_roi", roi))
    h = h.withColumn("health", F.col("wilson") - F.col("counter_rate") - F.col("stale") - F.col("duplication") - F.col("generic") - F.col("negative_roi"))
    enough = F.col("labeled_trials") >= c["demote_min_trials"]
    rules = [("low_wilson_lb", enough & (F.col("wilson") < 0.1)), ("high_counterproductive", enough & (F.col("counter_rate") >= 0.2)),
             ("stale", F.lit(c["stale_max"] > 0) & (F.col("stale") >= c["stale_max"] * 0.5)), ("duplicate", F.col("duplication") > 0),
             ("generic", F.col("generic") > 0), ("negative_roi", enough & (F.col("negative_roi") > 0))]
    reasons = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]), lambda r: r.isNotNull())
    h = h.withColumn("reasons", F.when(F.col("health") > c["demote_threshold"], F.lit("")).otherwise(F.array_join(reasons, ",")))
    return h.select("block_id", "health", "wilson", "counter_rate", "stale", "duplication", "generic", "negative_roi", "labeled_trials", "pending_injected",
                    "reasons", (F.col("reasons") != "").alias("would_demote"))


# --- D14 ------------------------------------------------------------------------------------------


def domain_top(blocks: DataFrame, domain: Sequence[str], k: int = 7, min_patterns: int = 3) -> DataFrame:
    """Best ``k`` proven active blocks per domain; domains with fewer than ``min_patterns`` are left out."""
    some = F.coalesce(*[F.col(d) for d in domain]).isNotNull()
    good = blocks.where("status = 'active'").where(some & ((F.col("times_agent_used") > 0) | (F.col("wilson") > 0)))
    best = top_k(good, list(domain), [F.desc("wilson"), F.desc("times_helpful"), F.asc("block_id")], k)
    n = best.groupBy(*domain).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_patterns)
    # Null-safe: a domain may leave some of its columns open.
    cond = [best[d].eqNullSafe(n[d]) for d in domain]
    out = best
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    return out.join(n, on, "left_semi")


def first_sentence(text: Column) -> Column:
    """The trimmed text up to its first full stop, exclamation or question mark, or line end; the whole text if it starts with one."""
    t = T.trim_ws(F.coalesce(text, F.lit("")))
    return F.when(t.rlike(r"^[.!?\n]"), t).otherwise(T.trim_ws(F.regexp_extract(t, r"^([^.!?\n]*[.!?]?)", 1)))


def distinct_lines(lines: Column, repeat: float = 0.6, most: int | None = None) -> Column:
    """Lines that share less than ``repeat`` of their words (of three letters or more) with every line kept before; lines without words go."""
    words = lambda line: F.array_distinct(F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda w: F.length(w) >= 3))
    bags = F.transform(lines, lambda line: F.struct(line.alias("line"), words(line).alias("words")))

    def keep(kept: Column, x: Column) -> Column:
        again = F.exists(kept, lambda y: T.jaccard(y["words"], x["words"]) >= repeat)
        full = F.size(kept) >= most if most else F.lit(False)
        return F.when(full | (F.size(x["words"]) == 0) | again, kept).otherwise(F.concat(kept, F.array(x)))

    return T.let(bags, lambda b: F.aggregate(b, F.slice(b, 1, 0), keep, lambda kept: F.transform(kept, lambda x: x["line"])))


def most_common(values: Column) -> Column:
    """The most frequent value, the one that comes first among equals; null for none."""
    counted = F.transform(values, lambda v, i: F.struct(F.size(F.filter(values, lambda w: w == v)).alias("n"), (-i).alias("first"), v.alias("value")))
    return F.array_max(counted)["value"]


def fitted(text: Column, tokens: int) -> Column:
    """The text within ``tokens``; a longer one ends at a blank with a mark."""
    return F.when(T.estimate_tokens(text) <= tokens, text).otherwise(
        F.concat(F.regexp_replace(F.substring(text, 1, max(0, tokens * 4 - 1)), r"\s+\S*\z", ""), F.lit("…" if tokens else "")))


def domain_primer(blocks: DataFrame, domain: Sequence[str], k: int = 7, min_patterns: int = 3, token_budget: int = 600) -> DataFrame:
    """One extractive primer per domain from its at most ``k`` best blocks, by column expressions over these rows.

    Each part keeps distinct sentences in block order and its share of the tokens; dead ends get what the others leave.
    """
    top = domain_top(blocks, domain, k, min_patterns)
    flat = lambda c: T.trim_ws(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    row = F.struct("rank", "block_id", first_sentence(F.col("mechanism")).alias("mechanism"), flat(F.col("unlock")).alias("unlock"),
                   first_sentence(F.col("verification")).alias("verification"), F.transform(F.coalesce("dead_ends", F.array().cast("array<string>")), flat).alias("dead_ends"))
    g = top.groupBy(*domain).agg(F.count("*").alias("patterns"), F.array_sort(F.collect_list(row)).alias("rows"))
    filled = lambda lines: F.filter(lines, lambda x: x != "")
    lines = lambda field: filled(F.col(f"rows.{field}"))
    limit = {part: int(token_budget * share) for part, share in V.PRIMER_SHARES.items()}
    cited = F.concat(F.lit(V.PRIMER_SOURCES), F.array_join(F.transform("rows.block_id", lambda b: F.substring(b, 1, 8)), ", "), F.lit("."))
    g = g.select(*domain, "patterns", cited.alias("cited"), distinct_lines(lines("mechanism")).alias("m"), distinct_lines(lines("unlock")).alias("u"),
                 most_common(lines("verification")).alias("v"), distinct_lines(filled(F.flatten("rows.dead_ends")), most=6).alias("d"))
    numbered = F.transform("u", lambda line, i: F.concat((i + 1).cast("string"), F.lit(". "), line))
    g = g.select(*domain, "patterns", fitted(F.concat_ws(" ", F.array("cited"), "m"), limit["mechanism"]).alias("mechanism"),
                 fitted(F.array_join(numbered, "\n"), limit["unlock"]).alias("unlock"), fitted(F.coalesce("v", F.lit(V.PRIMER_CHECK)), limit["verification"]).alias("verification"), "d")
    cost = T.estimate_tokens
    left = F.greatest(F.lit(0), token_budget - cost(F.col("mechanism")) - cost(F.col("unlock")) - cost(F.col("verification")))
    g = g.withColumn("left", left).withColumn("d", F.filter("d", lambda x: cost(x) <= F.col("left")))
    upto = lambda i: F.aggregate(F.slice("d", F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda n, x: n + cost(x))
    chosen = F.filter("d", lambda x, i: upto(i) <= F.col("left"))
    return g.where("unlock <> ''").select(*domain, "patterns", "mechanism", "unlock", "verification", F.array_join(chosen, " | ").alias("dead_ends"))


# --- D15..D18 ----------------------------------------------------------------------------------------


def redirect_once(redirects: DataFrame, seen: DataFrame) -> DataFrame:
    """``redirects(session_id, anchor_id, arg_key, ts, event_id)``: shown only the first time and only when not seen before."""
    key = ["session_id", "anchor_id", "arg_key"]
    first = redirects.groupBy(*key).agg(F.min(F.struct("ts", "event_id")).alias("f"))
    old = seen.select(*key).distinct().withColumn("_old", F.lit(True))
    j = redirects.join(first, key).join(old, key, "left")
    shown = F.col("_old").isNull() & (F.col("f.event_id") == F.col("event_id"))
    return j.select("event_id", *key, shown.alias("shown"), F.when(~shown, "anti-self-loop").alias("fallback_reason"))


def store_stats(traces: DataFrame) -> DataFrame:
    return traces.agg(
        F.count("*").alias("total"), *[count_if(F.col("outcome") == o).alias(o) for o in ("success", "failure", "partial")],
        F.avg("q_score").alias("avg_quality"), F.sum("recall_count").alias("recalls"), F.sum("helpful_count").alias("helpful"),
        F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def store_top(traces: DataFrame, k: int = 10) -> DataFrame:
    """Top values of language, framework and error type from one pass over the store."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("language", "framework", "error_type")])
    counts = (traces.select(F.explode(pairs).alias("p")).select("p.field", "p.value").where("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("n")))
    return top_k(counts, ["field"], [F.desc("n"), F.asc("value")], k)


def embedding_backlog(traces: DataFrame, vectors: DataFrame, attempts: DataFrame, batch: int = 32, max_attempts: int = 5) -> DataFrame:
    """Traces without a vector, oldest first, in numbered batches; rows tried too often are left out."""
    tried = attempts.groupBy("trace_id").agg(F.count("*").alias("attempts"))
    rest = (traces.select("trace_id", "created_at").join(vectors.select("trace_id").distinct(), "trace_id", "left_anti")
            .join(tried, "trace_id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0))).where(F.col("attempts") < max_attempts))
    placed = with_position(rest.withColumn("_all", F.lit(0)), "_all", "created_at", "trace_id", "_pos")
    return placed.select("trace_id", "created_at", "attempts", F.floor(F.col("_pos") / batch).alias("batch_no"))


def memory_status(ledger: DataFrame) -> DataFrame:
    """``ledger(memory_id, seq, ts, action, preview)`` -> current status and preview per memory.

    The state is four bounded aggregates: last action, the two latest actions other
    than rollback, last creation and last deletion.
    """
    order = F.struct("ts", "seq")
    real = F.col("action") != "rollback"
    last2 = top_k(ledger.where(real).select("memory_id", "ts", "seq", "action"), ["memory_id"], [F.desc("ts"), F.desc("seq")], 2)
    two = last2.groupBy("memory_id").agg(F.max(F.when(F.col("rank") == 1, F.col("action"))).alias("a1"), F.max(F.when(F.col("rank") == 2, F.col("action"))).alias("a2"))
    made, gone = F.col("action") == "created", F.col("action") == "deleted"
    per = ledger.groupBy("memory_id").agg(
        F.max_by("action", order).alias("last_action"), F.max_by("preview", F.when(made, order)).alias("preview"),
        F.max(F.when(made, order)).alias("made"), F.max(F.when(gone, order)).alias("gone"), F.count("*").alias("actions"))
    status = lambda c: F.when(F.col(c).isin("retired", "deleted", "superseded"), F.col(c)).otherwise(F.lit("active"))
    j = per.join(two, "memory_id", "left")
    return j.select("memory_id", "actions", "last_action",
                    F.when(F.col("last_action") == "rollback", status("a2")).otherwise(status("a1")).alias("status"),
                    F.when(F.col("gone").isNull() | (F.col("made") > F.col("gone")), F.col("preview")).alias("preview"))
