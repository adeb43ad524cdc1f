"""Uses and outcomes inferred from transcripts, against plain Python and with one crowded run."""

import random
import re

import pytest

from memlens.operators import evidence as E

INJECTIONS, SHADOW = "query_id string, block_id string, run_id string, ts long", "query_id string, shadow boolean"
TRANSCRIPTS, BLOCKS = "transcript_id long, run_id string, ts long, text string", "block_id string, unlock string, verification string"
SAID = "tests passed and it is fixed, as far as anyone can see"


@pytest.mark.parametrize("seed", [1, 2])
def test_uses_and_outcomes_are_those_of_all_pairs(spark, seed):
    rnd = random.Random(seed)
    words = [f"word{i}" for i in range(14)]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    blocks = [(f"b{i}", text(7), rnd.choice([None, text(2)])) for i in range(8)] + [("b8", None, None)]
    inj = [(f"q{rnd.randrange(60)}", f"b{rnd.randrange(10)}", f"r{rnd.randrange(3)}", rnd.randrange(-500, 2000)) for _ in range(150)] + [(None, "b1", "r1", 5)]
    shadow = [(f"q{i}", i % 5 == 0) for i in range(55)]
    said = [rnd.choice([None, "", text(6), f"{text(12)}\n{SAID}"]) for _ in range(12)]
    tr = [(i, f"r{rnd.randrange(3)}", rnd.randrange(-500, 2000), rnd.choice(said)) for i in range(80)]
    tokens = lambda t: {w for w in re.split("[^a-z0-9_-]+", t.lower()) if len(w) >= 3}
    body = {b: tokens("\n".join(x for x in (u, v) if x is not None)) for b, u, v in blocks}
    open_ = {q for q, s in shadow if not s}
    want = {}
    for t, run, at, x in tr:
        for q, b, r, ts in inj:
            if q in open_ and b in body and x is not None and r == run and ts <= at < ts + 100:
                union = body[b] | tokens(x)
                if union and len(body[b] & tokens(x)) / len(union) >= 0.2:
                    want[t, q, b] = min(ts, want.get((t, q, b), ts))
    tables = [spark.createDataFrame(rows, schema) for rows, schema in ((inj, INJECTIONS), (shadow, SHADOW), (tr, TRANSCRIPTS), (blocks, BLOCKS))]
    uses = E.infer_use(*tables, lookback_ms=100, threshold=0.2)
    assert {(r.transcript_id, r.query_id, r.block_id): r.injection_ts for r in uses.collect()} == want and want
    outcomes = spark.createDataFrame([("q1",), ("q7",)], "query_id string")
    got = sorted(map(tuple, E.infer_outcomes(*tables, outcomes, lookback_ms=100, threshold=0.2).collect()))
    assert got == sorted(map(tuple, E.inferred_outcomes(uses, outcomes, tables[2]).collect())) and got


def test_a_crowded_run_forms_no_pairs(spark):
    """In one bucket, 30,000 injections and transcripts: 900 million pairs in time, of which one transcript's text is similar."""
    n = 30_000
    ids = spark.range(n)
    inj = ids.selectExpr("concat('q', id) query_id", "concat('b', id % 5) block_id", "'r' run_id", "id % 1000 ts")
    shadow = ids.selectExpr("concat('q', id) query_id", "false shadow")
    tr = ids.selectExpr("id transcript_id", "'r' run_id", "1000 + id % 1000 ts", f"if(id = 7, 'turn the lever2 round, {SAID}', '{SAID}') text")
    blocks = spark.range(5).selectExpr("concat('b', id) block_id", "concat('turn the lever', id) unlock", "'round' verification")
    uses = E.infer_use(inj, shadow, tr, blocks, lookback_ms=5000, threshold=0.3)
    assert uses.groupBy("transcript_id", "block_id").count().collect() == [(7, "b2", n // 5)]
    nothing = spark.createDataFrame([], "query_id string")
    assert E.infer_outcomes(inj, shadow, tr, blocks, nothing, lookback_ms=5000, threshold=0.3).count() == n // 5
