"""Greedy choices inside a slate, against plain Python."""

import random

import pytest

from memlens.operators import maintenance as M
from memlens.operators import retrieval as R

CANDIDATE = "query_id long, candidate_id long, capability string, injection_tokens long, avoided_tokens double, prob double, noise double, freshness double, recent boolean"


def diverse(items, k, lam):
    """items: (relevance, words) in rank order."""
    chosen = []
    while len(chosen) < min(k, len(items)):
        def gain(i):
            near = max((len(items[i][1] & items[c][1]) / len(items[i][1] | items[c][1]) if items[i][1] | items[c][1] else 0.0 for c in chosen), default=0.0)
            return items[i][0] * lam - (1 - lam) * near
        chosen.append(max((i for i in range(len(items)) if i not in chosen), key=lambda i: (gain(i), -i)))
    return chosen


def test_a_slate_of_a_thousand(spark):
    rng = random.Random(1)
    items = [(rng.randrange(20) / 20, frozenset(rng.sample("aa bb cc dd ee ff gg hh ii jj kk".split(), rng.randrange(5)))) for _ in range(1000)]
    rows = [(7, f"i{i:04d}", i, r, " ".join(sorted(w))) for i, (r, w) in enumerate(items)] + [(8, "only", 3, 0.5, "aa bb")]
    slate = spark.createDataFrame(rows, "query_id long, item_id string, rank int, relevance double, text string")
    for k, lam in ((6, 0.7), (3, 0.0)):
        got = {(r.query_id, r.position): r.item_id for r in R.mmr(slate, k, lam).collect()}
        want = {(7, n): f"i{i:04d}" for n, i in enumerate(diverse(items, k, lam), 1)} | {(8, 1): "only"}
        assert got == want
    assert R.mmr(slate, 0).count() == 0 and R.mmr(slate.where("false"), 3).count() == 0


def test_vectors_come_before_words(spark):
    rows = [(1, "a", 1, 0.9, "xx", [1.0, 0.0]), (1, "b", 2, 0.89, "yy", [2.0, 0.0]), (1, "c", 3, 0.5, "xx", [0.0, 1.0]), (1, "d", 4, 0.1, "xx", None), (1, "e", 5, 0.1, "qq", [])]
    slate = spark.createDataFrame(rows, "query_id long, item_id string, rank int, relevance double, text string, embedding array<double>")
    assert [r.item_id for r in R.mmr(slate, 5, 0.5).orderBy("position").collect()] == ["a", "c", "e", "b", "d"]


def decided(rows, plan):
    """Eligible candidates (net, id, capability, tokens), most net first."""
    caps = {"reasoning_reuse": plan["blocks"], "file_memory": plan["files"], "context_fold": plan["chunks"], "loop_redirect": 1, "tool_supervision": 1, "context_pruning": 10**9}
    waiting, order = sorted(rows, key=lambda r: (-r[0], r[1])), []
    while waiting:
        nxt = 0
        if order and waiting[0][2] == order[-1][2]:
            nxt = next((j for j, r in enumerate(waiting) if r[2] != order[-1][2] and r[0] >= waiting[0][0] - 1), 0)
            first_other = next((j for j, r in enumerate(waiting) if r[2] != order[-1][2]), None)
            nxt = nxt if nxt == first_other else 0
        if nxt:
            waiting[0], waiting[nxt] = waiting[nxt], waiting[0]
        order.append(waiting.pop(0))
    left, used, out = plan["budget"], {}, {}
    for _, i, cap, tokens in order:
        if used.get(cap, 0) >= caps.get(cap, 0):
            out[i] = ("suppress", "profile_cap")
        elif tokens > left:
            out[i] = ("suppress", "budget")
        else:
            out[i], left = ("inject", "positive_roi"), left - tokens
            used[cap] = used.get(cap, 0) + 1
    return out


@pytest.mark.parametrize("n, seed", [(1, 1), (2, 2), (12, 3), (40, 4), (300, 5)])
def test_arbitration_equals_a_walk(spark, n, seed):
    rng = random.Random(seed)
    kinds = ["reasoning_reuse", "file_memory", "context_fold", "loop_redirect", "tool_supervision", "context_pruning", "unknown"]
    rows = [(q, i, rng.choice(kinds[:3] if q else kinds), rng.randrange(90), 900.0 + rng.randrange(4), 0.9, 0.0, 0.0, rng.random() < 0.1) for q in range(3) for i in range(n)]
    plan = R.serving_plan("balanced", recovering=True)
    got = {(r.query_id, r.candidate_id): (r.action, r.reason) for r in R.arbitrate(spark.createDataFrame(rows, CANDIDATE), "balanced", plan=plan).collect()}
    want = {(r[0], r[1]): ("suppress", "duplicate") for r in rows if r[8]}
    for q in range(3):
        want |= {(q, i): v for i, v in decided([(0.9 * r[4] - r[3], r[1], r[2], r[3]) for r in rows if r[0] == q and not r[8]], plan).items()}
    assert got == want


def test_plans():
    plan = R.serving_plan
    assert plan("cost-saver")["budget"] == 350 and plan("cost-saver", recovering=True)["budget"] == 500 and plan("cost-saver", recovering=True)["blocks"] == 2
    assert plan("balanced", token_budget=5000)["budget"] == 700 and plan("balanced", token_budget=200)["budget"] == 200 and plan("balanced", token_budget=0)["budget"] == 700
    assert plan("recall-heavy", token_budget=5000)["budget"] == 5000 and plan("recall-heavy", session=False)["chunks"] == 0
    assert plan("balanced", recovering=True)["blocks"] == 3 and plan("balanced")["min_chunk_net"] == 80


def test_shadow_queries_inject_nothing(spark):
    rows = [(1, i, "file_memory", 10, 900.0, 0.9, 0.0, 0.0, False) for i in range(3)]
    got = R.arbitrate(spark.createDataFrame(rows, CANDIDATE), "balanced", shadow=True).collect()
    assert {(r.action, r.reason) for r in got} == {("shadow", "holdout")}


def test_parts_of_a_primer(spark):
    from pyspark.sql import functions as F
    one = lambda c, *v: spark.createDataFrame([v], "t string").select(c(F.col("t")).alias("x")).first().x
    assert [one(M.first_sentence, t) for t in (" Use it. Then", "a\nb", ".x y", "", None, "no end", "why? so")] == ["Use it.", "a", ".x y", "", "", "no end", "why?"]
    lines = spark.createDataFrame([(["the red cat", "red the cat", "a b", "blue dog runs", "blue dog runs fast", "one two six"],)], "l array<string>")
    assert lines.select(M.distinct_lines(F.col("l")).alias("x")).first().x == ["the red cat", "blue dog runs", "one two six"]
    assert lines.select(M.distinct_lines(F.col("l"), most=2).alias("x")).first().x == ["the red cat", "blue dog runs"]
    common = spark.createDataFrame([(["b", "a", "c", "a", "b"], []), (["x"], [])], "l array<string>, e array<string>")
    assert [tuple(r) for r in common.select(M.most_common(F.col("l")), M.most_common(F.col("e"))).collect()] == [("b", None), ("x", None)]
    assert one(lambda c: M.fitted(c, 3), "aaa bbb ccc ddd") == "aaa bbb…" and one(lambda c: M.fitted(c, 3), "aaa bbb") == "aaa bbb" and one(lambda c: M.fitted(c, 2), "abcdefghijkl") == "abcdefg…"
