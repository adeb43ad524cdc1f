"""Mergeable usage state, its stream, and feedback resolved without pairs."""

import random

import pytest
from pyspark.sql import functions as F

from memlens.common import point_nodes, stabbing_nodes
from memlens.operators import analytics as A
from memlens.operators import usage as U
from memlens.plans import adapters as D
from memlens.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def log(spark):
    return A.with_day(D.event_log(spark, SF)).cache()


def test_states_of_parts_merge_to_the_state_of_the_whole(log):
    whole = U.usage_state(log, ("day",))
    parts = [U.usage_state(log.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i), ("day",)) for i in range(3)]
    merged = U.merge_state(parts[2].unionByName(parts[0]).unionByName(parts[1]), ("day",))
    assert rows(merged) == rows(whole.select(merged.columns)) and whole.count() > 100
    again = U.merge_state(U.merge_state(parts[0].unionByName(parts[1]), ("day",)).unionByName(parts[2]), ("day",))
    assert rows(again) == rows(merged)


def test_the_log_is_scanned_once(spark):
    plan = U.usage_state(D.event_log(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    rest = U.usage_from_state(U.cut(U.usage_state(D.event_log(spark, SF))))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in rest


def test_usage_of_an_empty_log_and_of_one_query(log):
    assert U.usage_metrics(log.where("false")).count() == 0 and U.usage_metrics(log.where("false"), ("day",)).count() == 0
    query = log.where("event = 'retrieval'").first().query_id
    one = U.usage_metrics(log.where(F.col("query_id") == query)).collect()
    assert len(one) == 1 and one[0].eligible_runs == 1


def days(n):
    """Daily rows as the fold reads them; odd days lack a measured saving."""
    return [dict(day=f"d{i}", eligible_runs=10, recalled_runs=8, injected_runs=5, used_runs=3, helpful_runs=2, shadow_control_mismatches=0, outcomes_without_retrieval=0,
                 scored_injections=i, candidates_seen=10, candidates_shown=4, candidates_filtered=6, assisted_n=20, assisted_resolved=12, holdout_n=16, holdout_resolved=8,
                 brier_score=0.1 * i if i else None, auc=None, last_refit_ts=i, tokens_saved=100.0 if i % 2 == 0 else None, tokens_saved_n=7,
                 latency_saved_ms=50.0 * i, latency_saved_n=0 if i == 1 else 3, causal_tokens_lift=30.0 if i == 2 else None, causal_latency_lift=-4.0,
                 assisted_n_tokens=9, holdout_n_tokens=6, assisted_n_durations=2, holdout_n_durations=5) for i in range(n)]


def test_folded_days(spark):
    schema = ", ".join(f"{c} {'string' if c == 'day' else 'double' if c in ('brier_score', 'auc', 'tokens_saved', 'latency_saved_ms', 'causal_tokens_lift', 'causal_latency_lift') else 'long'}" for c in days(1)[0])
    frame = lambda n: spark.createDataFrame([tuple(d.values()) for d in days(n)], schema)
    three = U.fold_days(frame(3)).first()
    assert (three.tokens_saved, three.tokens_saved_n, three.latency_saved_ms, three.latency_saved_n) == (200.0, 14, 100.0, 6)
    assert (three.causal_tokens_lift, three.causal_tokens_n, three.causal_latency_lift, three.causal_latency_n) == (30.0, 18, -12.0, 6)
    assert three.resolved_lift == pytest.approx(36 / 60 - 24 / 48) and three.brier_score == pytest.approx((0.1 * 1 + 0.2 * 2) / 3) and three.auc is None
    one = U.fold_days(frame(1)).first()  # 20 and 16 outcomes are too few for any causal figure
    assert one.resolved_lift is None and one.causal_tokens_lift is None and one.causal_latency_lift is None and one.tokens_saved == 100.0


def test_stream_adds_states_trigger_by_trigger(spark, tmp_path):
    log = D.event_log(spark, SF)
    for i in range(4):  # parts that share days and queries
        log.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = J.parquet_stream(spark, f"{tmp_path}/in", files_per_trigger=1)
    start = lambda checkpoint: J.run_available(J.usage_by_day(source, f"{tmp_path}/store", f"{tmp_path}/out", f"{tmp_path}/{checkpoint}", delay="60 days"))
    start("one")
    want = rows(U.usage_metrics(A.with_day(log), ("day",)).select("day", *U.USAGE_COLS))
    got = lambda: rows(spark.read.parquet(f"{tmp_path}/out").withColumn("day", F.col("day").cast("string")).select("day", *U.USAGE_COLS))
    assert got() == want
    start("two")  # all triggers run again over the same store
    assert got() == want


def brute_feedback(feedback, retrieved, lookback):
    first = {}
    for f, trace, ts, q in sorted(feedback, key=lambda r: (r[2], r[0])):
        if q is not None:
            first.setdefault((q, trace), (ts, f))
    out = []
    for f, trace, ts, q in feedback:
        if q is not None:
            out.append((f, trace, q if any((x, t) == (q, trace) for x, t, _ in retrieved) else None, False, first[q, trace][1] != f))
            continue
        hits = [(r, x) for x, t, r in retrieved if t == trace and ts - lookback < r <= ts and not ((x, t) in first and first[x, t][0] < ts)]
        out.append((f, trace, max(hits)[1] if hits else None, len(hits) > 1, False))
    return sorted(out, key=repr)


@pytest.mark.parametrize("lookback, spread", [(50, 400), (1, 30), (1000, 600), (7, 5000)])
def test_feedback_equals_brute_force(spark, lookback, spread):
    """Few traces, one with most rows; repeated retrievals, ties in time, credits before, at and after feedback."""
    rng = random.Random(lookback)
    trace = lambda: rng.choice(["hot"] * 6 + ["a", "b"])
    retrieved = [(f"q{rng.randrange(60)}", trace(), rng.randrange(spread)) for _ in range(260)]
    feedback = [(i, trace(), rng.randrange(spread + 20), rng.choice([None, None, f"q{rng.randrange(70)}"])) for i in range(260)]
    got = A.resolve_feedback(spark.createDataFrame(feedback, "feedback_id long, trace_id string, ts long, query_id string"),
                             spark.createDataFrame(retrieved, "query_id string, trace_id string, ts long"), lookback)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_feedback(feedback, retrieved, lookback)


def test_a_point_is_in_one_tile_of_every_interval_that_holds_it(spark):
    rng = random.Random(2)
    spans = [(i, a, a + rng.randrange(40)) for i, a in enumerate(rng.randrange(-50, 100) for _ in range(120))]
    tiles = spark.createDataFrame(spans, "i int, low long, high long").select("i", F.explode(stabbing_nodes(F.col("low"), F.col("high"), 6)).alias("node"))
    points = spark.range(-60, 150).select(F.col("id").alias("p"), F.explode(point_nodes(F.col("id"), 6)).alias("node"))
    got = sorted((r.p, r.i) for r in points.join(tiles, "node").collect())
    assert got == sorted((p, i) for i, a, b in spans for p in range(a, b + 1))
    assert max(r["count"] for r in tiles.groupBy("i").count().collect()) <= 12
