"""Fingerprint matches, naive best matches and fact upserts against plain Python, with hot keys, ties, nulls and empty tables."""

import random

import pytest

from memlens.operators import maintenance as M
from memlens.operators import retrieval as R

QUERIES, DOCS = "query_id long, text string", "doc_id long, text string"


def test_a_hot_fingerprint_meets_k_rows(spark):
    rnd = random.Random(2)
    traces = [(i, rnd.choice(["hot", "hot", "cold", None]), rnd.randrange(4) / 4) for i in range(200)]
    queries = [(1, "hot"), (2, "cold"), (3, None), (4, "absent"), (5, "hot")]
    t = spark.createDataFrame(traces, "trace_id long, fingerprint string, q_score double")
    got = sorted((r.query_id, r["rank"], r.trace_id) for r in R.fingerprint_match(spark.createDataFrame(queries, "query_id long, fingerprint string"), t, 3).collect())
    best = lambda fp: [i for i, f, q in sorted(traces, key=lambda x: (-x[2], x[0])) if f == fp][:3]
    assert got == [(q, rank, trace) for q, fp in queries if fp in ("hot", "cold") for rank, trace in enumerate(best(fp), 1)]
    assert R.fingerprint_match(spark.createDataFrame(queries, "query_id long, fingerprint string"), t.where("false"), 3).count() == 0


@pytest.mark.parametrize("opening", [1, 2, 50])
def test_naive_best_match_is_exact(spark, opening):
    """Word frequencies fall steeply, so most lists a floor spares are long; repeated texts, equal scores, unknown and common words only."""
    rnd = random.Random(opening)
    vocabulary = [f"word{i}" for i in range(60)]
    text = lambda n: " ".join(rnd.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=n))
    docs = [(i, text(rnd.randrange(1, 14))) for i in range(120)] + [(200, "word0"), (199, "word0"), (201, ""), (202, None)]
    docs += [(300 + i, t) for i, t in docs[:20]]
    queries = [(i, text(rnd.randrange(1, 12))) for i in range(60)] + [(100, "word0 word1"), (101, "never heard here word59"), (102, "never heard"), (103, ""), (104, None), (105, "WORD0, word0! an")]

    def words(t):
        return {w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split() if len(w) >= 3}

    want = {}
    for q, t in queries:
        a = words(t)
        scored = [(round(len(a & words(d)) / len(a | words(d)), 6), -i) for i, d in docs if a & words(d)]
        if scored:
            score, i = max(scored)
            want[q] = (-i, score)
    got = {r.query_id: (r.doc_id, r.score) for r in R.naive_top1(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(docs, DOCS), opening).collect()}
    assert got == want
    assert R.naive_top1(spark.createDataFrame(queries, QUERIES), spark.createDataFrame([], DOCS), opening).count() == 0


def test_facts_that_leak_neither_count_nor_come_first(spark):
    """The first harmless statement of a key is kept; leaking ones of the same or another key leave no trace."""
    rows = [("p", "rule", "Use  tabs", 0.6, None, 2), ("p", "rule", "use tabs", 0.9, 5.0, 1), ("p", "rule", "DB_KEY=first-one", 0.6, None, 0), ("p", "rule", "db_key=first-one", 0.6, None, 5), ("p", "rule", "OTHER_KEY=second-one", 0.6, None, 6), ("p", "rule", None, 0.6, None, 3)]
    incoming = spark.createDataFrame(rows, "scope string, fact_type string, statement string, confidence double, ttl_days double, seq long")
    stored = spark.createDataFrame([], "dedupe_key string, scope string, fact_type string, statement string, confidence double, status string, verified_at long, ttl_until long")
    got = sorted((r.statement or "", round(r.confidence, 6), r.action) for r in M.upsert_facts(stored, incoming, 1000).collect())
    named = {(statement, confidence) for statement, confidence, _ in got}
    assert {("use tabs", 0.95), ("db_key=first-one", 0.6)} <= named  # upper and lower case share a key; only the lower one is harmless
    assert not any(statement.startswith(("DB_", "OTHER_")) for statement, _ in named)
