"""Pruned top-k against full scoring."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from memlens import fixed_values as V
from memlens.operators import postings as P
from memlens.operators import retrieval as R

WEIGHTS = {"a": 2.0, "b": 1.0}


def corpus(n, seed=1):
    """Words of very different frequency; ``the`` in every document, ``often`` in four of ten."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    out = []
    for d in range(n):
        a = rng.choices(words, weights, k=rng.randrange(0, 30)) + ["the"] * rng.randrange(1, 4)
        b = rng.choices(words, weights, k=rng.randrange(0, 12)) + ["often"] * (rng.random() < 0.4) * rng.randrange(1, 5)
        out.append((d, " ".join(a), " ".join(b) or None))
    return out


def full(docs, queries, k, keep=lambda q, d: True):
    tf, length = {}, {}
    for d, a, b in docs:
        tf[d] = Counter()
        for text, w in ((a, 2.0), (b, 1.0)):
            for t in (text or "").split():
                tf[d][t] += w
        length[d] = len((a or "").split()) + len((b or "").split())
    n, avg = len(docs), sum(length.values()) / len(docs)
    df = Counter(t for c in tf.values() for t in c)
    idf = {t: max(math.log((n - f + 0.5) / (f + 0.5)), 0) or V.BM25_IDF_FLOOR for t, f in df.items()}
    out = []
    for q, text in queries:
        terms = list(dict.fromkeys(text.split()))
        hits = []
        for d, c in tf.items():
            own = [t for t in terms if t in c]
            if not own or len(terms) <= 3 and len(own) < len(terms) or not keep(q, d):
                continue
            s = sum(idf[t] * c[t] * (V.BM25_K1 + 1) / (c[t] + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * length[d] / avg)) for t in own)
            hits.append((-round(s, 6), d))
        out += [(q, d, -s, i) for i, (s, d) in enumerate(sorted(hits)[:k], 1)]
    return out


@pytest.fixture(scope="module")
def docs():
    return corpus(600)


@pytest.fixture(scope="module")
def queries():
    rng = random.Random(2)
    pool = [f"w{i}" for i in range(400)]
    asked = [" ".join(rng.sample(pool, rng.choice([1, 2, 3, 5, 9, 20])) + rng.choice([[], ["the"], ["often"], ["the", "often"]])) for _ in range(60)]
    return list(enumerate(asked + ["the", "often the", "the often w0 w1", "nothing here at all", "w399 w398 w397 w396"]))


def found(spark, docs, queries, k, **kw):
    rows = R.bm25_scores(R.query_terms(spark.createDataFrame(queries, "query_id long, text string")), spark.createDataFrame(docs, "doc_id long, a string, b string"), WEIGHTS, k, **kw)
    return sorted(tuple(r) for r in rows.select("query_id", "doc_id", "bm25", "rank").collect())


def same(got, want):
    assert [(q, d, r) for q, d, _, r in got] == [(q, d, r) for q, d, _, r in sorted(want)]
    assert all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(got, sorted(want), strict=True))


@pytest.mark.parametrize("k, block_rows", [(5, 50_000), (3, 7), (40, 100)])
def test_pruned_search_equals_full_scoring(spark, docs, queries, k, block_rows, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_ROWS", block_rows)
    same(found(spark, docs, queries, k), full(docs, queries, k))


def test_filters_and_stored_postings(spark, docs, queries, tmp_path):
    P.save(P.build(spark.createDataFrame(docs, "doc_id long, a string, b string"), WEIGHTS), str(tmp_path))
    keep = lambda hits: hits.where((F.col("doc_id") + F.col("query_id")) % 5 < 2)
    got = found(spark, docs, queries, 6, keep=keep, index=P.load(spark, str(tmp_path)))
    same(got, full(docs, queries, 6, lambda q, d: (d + q) % 5 < 2))


def test_common_words_propose_nothing_and_no_task_holds_a_term(spark, docs, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_ROWS", 40)
    index = P.build(spark.createDataFrame(docs, "doc_id long, a string, b string"), WEIGHTS)
    largest = {r.term: r.n for r in index.blocks.groupBy("term").agg(F.max("n").alias("n")).collect()}
    assert max(largest.values()) <= 80  # a hash is not perfectly even
    seen = []
    monkeypatch.setattr(P, "_proposed", lambda opened, i, own=P._proposed: seen.append(own(opened, i)) or seen[-1])
    terms = R.query_terms(spark.createDataFrame([(1, "w50 w60 w70 w80 the often")], "query_id long, text string"))
    assert P.search(terms, index, 3).count() == 3
    assert seen[-1].count() < 0.25 * len(docs)


def test_empty_tables(spark, docs):
    assert found(spark, docs, [], 3) == []
    assert found(spark, docs, [(1, ""), (2, "?")], 3) == []
    assert found(spark, [], [(1, "a b")], 3) == []


def test_equal_queries_are_asked_once(spark):
    """Nulls are equal among themselves and differ from empty values; every query gets the rows of its first one."""
    rows = [(i, ["x", "", None][i % 3], [["a"], [], None][i % 9 // 3]) for i in range(300)]
    seen = []

    def recall(q):
        seen.extend(q.collect())
        return q.select("query_id", F.concat_ws("|", F.coalesce("text", F.lit("none")), F.size("apis").cast("string")).alias("found"))

    got = R.asked_once(spark.createDataFrame(rows, "query_id long, text string, apis array<string>"), ["text", "apis"], recall).collect()
    assert sorted(r.query_id for r in seen) == list(range(9))
    assert len(got) == 300 and {r.query_id: r.found.split("|")[0] for r in got} == {i: "none" if t is None else t for i, t, _ in rows}
