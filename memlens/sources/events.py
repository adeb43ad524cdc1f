"""Event log in and out: filtered reads, JSON lines with validation, typed columns (A1, A2, A4)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlens import fixed_values as V


def read_events(events: DataFrame, after: int | None = None, before: int | None = None, types: Sequence[str] = (), query_id: str | None = None,
                block_id: str | None = None, fact_id: str | None = None, run_id: str | None = None, limit: int | None = 1000) -> DataFrame:
    """Events in (ts, event_id) order; both time bounds are exclusive.  ``limit=None`` reads all."""
    conds = [F.col("ts") > after if after is not None else None, F.col("ts") < before if before is not None else None,
             F.col("event").isin(*types) if types else None]
    conds += [F.col(c) == v for c, v in (("query_id", query_id), ("block_id", block_id), ("fact_id", fact_id), ("run_id", run_id)) if v is not None]
    for c in conds:
        if c is not None:
            events = events.where(c)
    rows = events.orderBy("ts", "event_id")
    return rows if limit is None else rows.limit(limit)


_NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


class _Json:
    """JSON type tests on a parsed line; a missing field is null, an explicit null is VOID."""

    def __init__(self, v: Column):
        self.v = v

    def kind(self, field: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(self.v, f"$.{field}", "variant"))

    def text(self, field: str) -> Column:
        return F.when(self.kind(field) == "STRING", F.try_variant_get(self.v, f"$.{field}", "string"))

    def is_text(self, field: str) -> Column:
        return F.coalesce(self.text(field) != "", F.lit(False))

    def is_number(self, field: str) -> Column:
        return F.coalesce(self.kind(field).rlike(_NUMBER), F.lit(False))

    def is_bool(self, field: str) -> Column:
        return F.coalesce(self.kind(field) == "BOOLEAN", F.lit(False))

    def optional(self, field: str, test: Column) -> Column:
        return self.kind(field).isNull() | test

    def one_of(self, field: str, *values: str) -> Column:
        return F.coalesce(self.text(field).isin(*values), F.lit(False))

    def at(self, field: str) -> _Json:
        return _Json(F.try_variant_get(self.v, f"$.{field}", "variant"))

    def numbers(self, names: Sequence[str]) -> Column:
        return reduce(lambda a, b: a & b, [self.is_number(n) for n in names])

    def list_of(self, field: str, test: Callable[[_Json], Column]) -> Column:
        arr = F.try_variant_get(self.v, f"$.{field}", "array<variant>")
        return F.coalesce(self.kind(field).startswith("ARRAY") & F.forall(arr, lambda c: test(_Json(c))), F.lit(False))

    def itself(self) -> Column:
        return F.try_variant_get(self.v, "$", "string")

    def items(self, field: str, id_field: str) -> Column:
        """An array whose every element has a non-empty id and a numeric score."""
        arr = F.try_variant_get(self.v, f"$.{field}", "array<variant>")
        ok = F.forall(arr, lambda c: _Json(c).is_text(id_field) & _Json(c).is_number("score"))
        return F.coalesce(self.kind(field).startswith("ARRAY") & ok, F.lit(False))


def valid_event(v: Column) -> Column:
    """Per-type validity of one parsed event."""
    j = _Json(v)
    scored = lambda i: j.is_text(i) & j.is_number("score") & j.optional("calibratedProb", j.is_number("calibratedProb"))
    used = lambda i: j.is_text(i) & j.one_of("matchSignal", "jaccard", "embedding", "explicit") & j.is_number("matchScore")
    rules = {
        "retrieval": j.is_bool("shadow") & j.items("candidates", "blockId") & j.optional("factCandidates", j.items("factCandidates", "factId"))
        & j.optional("cascadePolicyId", j.kind("cascadePolicyId") == "STRING") & j.optional("rerankerFellBack", j.is_bool("rerankerFellBack"))
        & j.optional("rerankerFallbackReason", j.one_of("rerankerFallbackReason", "timeout", "error", "null", "empty", "validation"))
        & j.optional("mmrLambda", j.is_number("mmrLambda")) & j.optional("injectionProfile", j.one_of("injectionProfile", *V.CONFIDENCE_FLOOR)),
        "injection": scored("blockId"), "fact_injection": scored("factId"),
        "agent_used": used("blockId") & j.optional("evidenceStrength", j.one_of("evidenceStrength", *V.STRENGTHS)),
        "fact_agent_used": used("factId"), "trace_agent_used": used("traceId"),
        "outcome": j.is_bool("resolved") & j.is_bool("control") & j.optional("tokens", j.is_number("tokens")) & j.optional("durationMs", j.is_number("durationMs"))
        & j.optional("steps", j.is_number("steps")) & j.optional("regressed", j.is_bool("regressed")) & j.optional("attribution", j.one_of("attribution", "explicit", "inferred")),
        "trace_feedback": j.is_text("traceId") & j.is_bool("helpful") & j.optional("attribution", j.one_of("attribution", "explicit", "inferred")),
        "calibrator_refit": j.is_number("freshOutcomes") & j.is_number("fittedAt"),
        "drift_injection": j.one_of("signalKind", "straight", "pingpong", "duplicate") & j.is_number("patternsInjected") & j.is_number("gateThreshold"),
        "trace_retrieval": j.list_of("candidates", lambda c: c.is_text("traceId") & c.is_number("score") & c.at("signals").numbers(V.TRACE_SIGNALS))
        & j.at("sampledWeights").numbers(V.TRACE_SIGNALS[1:]) & j.is_text("rankerVersion")
        & j.list_of("selectedTraceIds", lambda c: F.coalesce((F.schema_of_variant(c.v) == "STRING") & (c.itself() != ""), F.lit(False))) & j.optional("seed", j.is_number("seed")),
        "block_demoted": j.is_text("blockId") & j.numbers(["health", "demotionThreshold", "labeledTrials"])
        & j.list_of("reasons", lambda c: F.coalesce(c.itself().isin(*V.DEMOTION_REASONS), F.lit(False))) & (F.size(F.try_variant_get(j.v, "$.reasons", "array<variant>")) > 0)
        & j.at("components").numbers(V.DEMOTION_COMPONENTS),
        "capture.error": j.one_of("phase", *V.CAPTURE_PHASES) & j.one_of("reason", "validation", "unknown")
        & F.coalesce(F.length(j.text("message")) <= 200, F.lit(False)),
        "arbitration_decision": j.one_of("capability", "reasoning_reuse", "file_memory", "loop_redirect", "tool_supervision", "context_fold", "context_pruning")
        & j.one_of("action", "inject", "suppress", "shadow")
        & j.one_of("reason", "positive_roi", "budget", "low_confidence", "stale", "duplicate", "profile_cap", "holdout"),
    }
    by_type = F.lit(False)
    for name, rule in rules.items():
        by_type = F.when(j.text("event") == name, rule).otherwise(by_type)
    return j.is_number("ts") & j.is_text("queryId") & j.optional("runId", F.coalesce(j.kind("runId") == "STRING", F.lit(False))) & by_type


def parse_event_lines(lines: DataFrame) -> DataFrame:
    """``lines(line_id, line)`` -> payload with status good, bad-json or invalid (the last two are the quarantine)."""
    p = lines.where(F.trim("line") != "").withColumn("payload", F.try_parse_json("line"))
    status = F.when(F.col("payload").isNull(), "bad-json").when(valid_event(F.col("payload")), "good").otherwise("invalid")
    return p.withColumn("status", status)


def import_events_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(typed good events, quarantined lines) of JSON-line files."""
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("line"))
    parsed = parse_event_lines(raw)
    return normalize_events(parsed.where("status = 'good'").select(F.col("line_id").alias("event_id"), F.col("line").alias("payload"))), parsed.where("status <> 'good'").select("line_id", "line", "status")


def export_events_jsonl(events: DataFrame, path: str) -> None:
    """Typed columns as JSON lines, nulls left out; files are in (ts, event_id) order."""
    names = {"query_id": "queryId", "run_id": "runId", "block_id": "blockId", "fact_id": "factId"}
    cols = [F.col(c).alias(names.get(c, c)) for c in events.columns]
    events.orderBy("ts", "event_id").select(F.to_json(F.struct(*cols)).alias("value")).write.mode("errorifexists").text(path)


def normalize_events(raw: DataFrame) -> DataFrame:
    """``raw(event_id, payload, run_id?)`` JSON -> typed columns.

    Item ids only for injection and use events; shadow from ``shadow`` of a
    retrieval or ``control`` of an outcome; the run id falls back to the column.
    """
    get = lambda f: F.get_json_object("payload", f"$.{f}")
    event = get("event")
    run = F.coalesce(get("runId"), F.col("run_id")) if "run_id" in raw.columns else get("runId")
    return raw.select(
        "event_id", get("ts").cast("bigint").alias("ts"), event.alias("event"), get("queryId").alias("query_id"), run.alias("run_id"),
        F.when(event.isin("injection", "agent_used"), get("blockId")).alias("block_id"),
        F.when(event.isin("fact_injection", "fact_agent_used"), get("factId")).alias("fact_id"),
        F.when(event == "retrieval", get("shadow").cast("boolean")).when(event == "outcome", get("control").cast("boolean")).alias("shadow"),
        get("score").cast("double").alias("score"), get("resolved").cast("boolean").alias("resolved"), get("tokens").cast("double").alias("tokens"))


def event_log(raw: DataFrame) -> DataFrame:
    """``raw(event_id, payload, run_id?)`` JSON -> the log that the reports read, one parse per line.

    Candidates are lists of ids.  Fields of other event types are null; the run id falls back to the column.
    """
    v = raw.withColumn("_v", F.try_parse_json("payload"))
    get = lambda f, kind="string": F.try_variant_get("_v", f"$.{f}", kind)
    event = get("event")
    on = lambda types, value: F.when(event.isin(*types), value)
    ids = lambda field, name: F.transform(get(field, "array<variant>"), lambda c: F.try_variant_get(c, f"$.{name}", "string"))
    run = F.coalesce(get("runId"), F.col("run_id")) if "run_id" in raw.columns else get("runId")
    ret, out, use = ("retrieval",), ("outcome",), ("agent_used", "fact_agent_used", "trace_agent_used")
    return v.select(
        "event_id", get("ts", "bigint").alias("ts"), event.alias("event"), get("queryId").alias("query_id"), run.alias("run_id"),
        on(("injection", "agent_used", "block_demoted"), get("blockId")).alias("block_id"), on(("fact_injection", "fact_agent_used"), get("factId")).alias("fact_id"),
        on(("injection",), get("score", "double")).alias("score"), on(ret, get("shadow", "boolean")).alias("shadow"),
        on(ret, get("controlReason")).alias("control_reason"), on(ret, ids("candidates", "blockId")).alias("candidates"), on(ret, ids("factCandidates", "factId")).alias("fact_candidates"),
        on(ret, get("injectedTokensEstimate", "bigint")).alias("injected_tokens"), on(out, get("resolved", "boolean")).alias("resolved"),
        on(out, get("tokens", "bigint")).alias("tokens"), on(out, get("durationMs", "bigint")).alias("duration_ms"), on(out, get("control", "boolean")).alias("control"),
        on(("outcome", "trace_feedback"), get("attribution")).alias("attribution"), on(use, get("matchSignal")).alias("match_signal"), on(use, get("matchScore", "double")).alias("match_score"),
        on(use, get("evidenceStrength")).alias("evidence_strength"), on(ret, get("cascadePolicyId")).alias("policy_id"),
        on(ret, get("rerankerName")).alias("reranker_name"), on(ret, get("rerankerFellBack", "boolean")).alias("fell_back"), on(ret, get("rerankerFallbackReason")).alias("fallback_reason"))
