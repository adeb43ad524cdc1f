"""Recall keeps and compares little: counts instead of all words' postings, few documents scored, phrases as keys."""

import random

from pyspark.sql import functions as F
from test_postings import WEIGHTS, corpus, found, full, same

from memlens.operators import postings as P
from memlens.operators import retrieval as R


def test_stored_counts_answer_later_questions(spark, tmp_path):
    docs = [*corpus(300), (300, None, None), (301, "", "w1")]
    queries = [(1, "w1 w7 the often"), (2, "w3 w9"), (3, "w0 w5 w11 w40 w90 absent")]
    df = spark.createDataFrame(docs, "doc_id long, a string, b string")
    P.counts(df, WEIGHTS).write.parquet(str(tmp_path / "counts"))
    stored = spark.read.parquet(str(tmp_path / "counts"))
    assert stored.count() == len(docs)
    terms = R.query_terms(spark.createDataFrame(queries, "query_id long, text string"))
    index = P.build_counted(stored, terms)
    assert index.blocks.select("term").distinct().count() <= terms.select("term").distinct().count()
    same(found(spark, docs, queries, 5, index=index), full(docs, queries, 5))


def test_rows_of_one_id_are_one_document(spark):
    index = P.build(spark.createDataFrame([(1, "x y"), (1, "x z"), (2, "y z")], "doc_id long, a string"), {"a": 1.0})
    assert sorted(r.n for r in index.blocks.groupBy("term").agg(F.sum("n").alias("n")).collect()) == [1, 2, 2]


def test_few_documents_are_scored_in_full(spark, monkeypatch):
    """Of many documents with some word of the query only those near the best ones are scored; a filter counts before that."""
    docs = corpus(1500, seed=5)
    sizes = []
    monkeypatch.setattr(P, "few", lambda table, own=P.few: (sizes.append(table.count()) if table.columns == ["query_id", "doc_id"] else None) or own(table))
    queries = [(1, "w5 w9 w14 w20 w31 w45 the often")]
    same(found(spark, docs, queries, 4), full(docs, queries, 4))
    reached = sum(any(w in f"{a} {b}".split() for w in queries[0][1].split()) for _, a, b in docs)
    assert len(sizes) == 2 and sizes[0] <= 4 * P.FIRST_DOCS and sizes[1] < 0.25 * reached
    sizes.clear()
    keep = lambda hits: hits.where("doc_id % 50 = 7")
    same(found(spark, docs, queries, 4, keep=keep), full(docs, queries, 4, lambda q, d: d % 50 == 7))
    assert sizes[1] <= 30


def test_phrases_propose_texts(spark, monkeypatch):
    """All texts hold all words; only those that hold two in a row are compared."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    texts = [(i, " ".join(rng.sample(words, 40)), 0.0) for i in range(200)]
    texts += [(200, "head " + " ".join(words[3:9]) + ", tail", 0.0), (201, "W3  w4 w5 w6 w7 w8", 0.0)]
    sizes = []
    monkeypatch.setattr(P, "few", lambda table, own=P.few: (sizes.append(table.count()) if set(table.columns) == {"query_id", "trace_id"} else None) or own(table))
    asked = [(1, "w3 w4 w5 w6 w7 w8"), (2, "3 W4 w5 w"), (3, "4 w5 w6"), (4, "w6"), (5, "w3  w4 w5")]
    got = R.like_search(spark.createDataFrame(asked[:2], "query_id long, text string"), spark.createDataFrame(texts, "trace_id long, description string, q_score double"), None)
    plain = lambda qs: {(q, i) for q, n in qs for i, h, _ in texts if n.lower() in h.lower()}
    assert {tuple(r) for r in got.collect()} == plain(asked[:2])
    assert sizes and sizes[-1] < 60
    got = R.like_search(spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(texts, "trace_id long, description string, q_score double"), None)
    assert {tuple(r) for r in got.collect()} == plain(asked)


def test_only_documents_that_reach_the_floor_leave_a_task(spark, monkeypatch):
    """Texts are counted for asked words only, and of the documents with such words a few more than k are proposed."""
    docs = corpus(1500, seed=5)
    queries = [(1, "w5 w9 w14 w20 w31 w45 the often"), (2, "w1 w8 w9 w77 absent")]
    made, seen = [], []
    monkeypatch.setattr(P, "_built", lambda counted, *more, own=P._built: made.append(counted) or own(counted, *more))
    monkeypatch.setattr(P, "_proposed", lambda opened, i, own=P._proposed: seen.append(own(opened, i)) or seen[-1])
    same(found(spark, docs, queries, 4), full(docs, queries, 4))
    assert made[0].count() == len(docs) and made[0].agg(F.max(F.size("terms")).alias("n")).first()["n"] <= 12
    assert seen[-1].count() <= 2 * 3 * 4


def test_words_too_many_for_a_task_are_joined(spark, monkeypatch):
    docs = [*corpus(400), (400, None, None)]
    queries = [(i, f"w{i} w{i * 3} w{i * 7 + 1} w{i + 9} the often") for i in range(12)] + [(90, "the w0"), (91, "w2")]
    monkeypatch.setattr(P, "TASK_ROWS", 0)
    monkeypatch.setattr(P, "FEW_ROWS", 0)
    same(found(spark, docs, queries, 5), full(docs, queries, 5))
