"""op11, op12, op13 against brute force."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from memlens.llm import repair, runs, simhash
from memlens.llm.catalog import op11_runs, op12_simhash, op13_repair

SF = "/root/testdata/sf0.001"
CONVERSATION = "conv_id long, turn long, role string, text string"


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(800):
        n = rng.randrange(60)
        words = [rng.randrange(rng.choice([1, 2, 3, 4])) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + rng.randrange((n - a) // 4 + 1)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        start, length, period = runs.runs_of(np.array(words, np.uint64), np.full(n, n))
        assert list(zip(start.tolist(), period.tolist(), length.tolist(), strict=True)) == brute.runs(words)


def test_runs_stay_inside_their_text():
    words = np.array([1] * 6 + [2] * 5, np.uint64)
    assert [x.tolist() for x in runs.runs_of(words, np.array([6] * 6 + [11] * 5))] == [[0], [6], [1]]


def test_run_query_of_given_documents(spark, documents):
    got = {r.doc_id: tuple(r)[1:] for r in op11_runs(spark, SF).collect()}
    want = {r.doc_id: brute.run_row(brute.repeats(r.doc_id, r.text)) for r in documents.collect()}
    assert got == want and sum(v[0] > 0 for v in want.values()) > 10


def test_runs_of_odd_rows(odd, empty):
    rows = runs.digest(runs.find_runs(odd))
    assert rows.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted((tuple(r)[:1] + tuple(r)[1:] for r in rows.collect()), key=repr)
    short = {r.doc_id: r.text for r in odd.collect() if r.doc_id not in (4, 5, 12)}
    assert len(got) == odd.count()
    assert all(r[1:] == brute.run_row(brute.WORD.findall(short[r[0]] or "")) for r in got if r[0] in short and r[0] is not None)
    assert [r[1:6] for r in got if r[0] == 12] == [(1, 0, 30_000, 1, 30_000_000)]
    assert runs.digest(runs.find_runs(empty)).count() == 0


def test_runs_output_is_the_collapsed_text(spark):
    df = spark.createDataFrame([(1, "a b " * 5 + "c"), (2, "x y z")], "doc_id long, text string")
    got = {r.doc_id: r for r in runs.find_runs(df).collect()}
    assert got[1].collapsed == "a b c" and got[1].best.asDict() == {"start": 0, "length": 10, "period": 2} and got[2].runs == [] and got[2].best is None


def test_simhash_query_of_given_documents(spark, documents):
    prints = {r.doc_id: brute.simhash(r.text) for r in documents.collect()}
    classes = brute.near_classes(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op12_simhash(spark, SF).collect()} == {d: (f"{p:016x}", classes[d]) for d, p in prints.items()}


@pytest.mark.parametrize("seed, crowd", [(1, 4096), (2, 8), (3, 60)])
def test_classes_of_crowded_fingerprints(spark, seed, crowd):
    """Balls of fingerprints around few centres, chains at distance 4 and 5, the zero fingerprint and negative longs."""
    rng = random.Random(seed)
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    prints = {0, 2**64 - 1, 2**63}
    for _ in range(4):
        centre = rng.getrandbits(64)
        prints |= {flip(centre, rng.randrange(8)) for _ in range(100)}
    chain = rng.getrandbits(64)
    for _ in range(60):
        prints.add(chain)
        chain = flip(chain, rng.choice([4, 4, 4, 5]))
    signed = lambda p: p - 2**64 if p >> 63 else p
    want = brute.near_classes({signed(p): p for p in prints})
    rows = spark.createDataFrame([(signed(p),) for p in prints], "print long")
    assert {r["print"]: r["class"] for r in simhash.link_classes(rows, crowd=crowd).collect()} == want


def test_a_variant_is_shared_by_all_close_fingerprints():
    rng = random.Random(4)
    masks = simhash.variant_masks()
    assert len(masks) == 64
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(5)))
        assert any((a ^ b) & m & (2**64 - 1) == 0 for m in masks)


def test_simhash_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert len(got) == odd.count() and all(r.component_id is None for r in got if r.doc_id is None)
    assert all(r.fingerprint == f"{brute.simhash(texts[r.doc_id]):016x}" for r in got if r.doc_id is not None)
    classes = brute.near_classes({d: brute.simhash(t) for d, t in texts.items() if d is not None})
    assert all(r.component_id == classes[r.doc_id] for r in got if r.doc_id is not None)
    assert simhash.near_duplicates(empty).count() == 0


def compared(df):
    got = {r.conv_id: tuple(r)[1:] for r in repair.repaired_conversations(df).collect()}
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    by = {r[0]: [] for r in rows}
    for r in brute.damage(rows):
        by[r[0]].append(r)
    assert got == {c: brute.repaired(own) for c, own in by.items()}
    return got


def test_repair_query_of_given_conversations(spark):
    got = compared(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    assert {r.conv_id: tuple(r)[1:] for r in op13_repair(spark, "/root/testdata/sf0.01").collect()} == got


def odd_conversations(rng, n):
    texts = [None, "", " ", "a.", "a", "b!", "c", "d?", " x. ", "y.z"]
    roles = [None, "system", "user", "assistant", "tool", "user", "assistant"]
    return [(rng.choice([None, *range(40)]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_repair_of_odd_rows(spark):
    rng = random.Random(5)
    df = spark.createDataFrame(odd_conversations(rng, 500), CONVERSATION)
    for name in ("conv", "chunk", "at", "code", "digest", "copies", "n", "sub"):
        df = df.withColumn(name, F.lit("clash"))
    compared(df)
    assert repair.repaired_conversations(df.where("false")).count() == 0


def test_repair_of_conversations_in_many_pieces(spark, monkeypatch):
    """A long conversation in pieces of four rows, and one row a hundred times over."""
    monkeypatch.setattr(repair, "PIECE_BITS", 2)
    rng = random.Random(6)
    long = [(99, i, rng.choice(["system", "user", "assistant", "user"]), rng.choice(["q.", "r", "s!"]) + str(i) + rng.choice([".", ""])) for i in range(300)]
    compared(spark.createDataFrame(long + [(7, 3, "user", "again.")] * 100 + odd_conversations(rng, 100), CONVERSATION))


def test_a_rerun_stops_where_vectors_agree():
    rng = random.Random(7)
    for _ in range(300):
        codes = bytes(rng.choice([1, 2, 3, 6, 7, 2 + 8]) for _ in range(rng.randrange(40)))
        old, new = repair.END, repair.backward(bytes(rng.choice([1, 2, 3]) for _ in range(5)), repair.END)
        assert repair.rerun(codes, old, repair.backward(codes, old), new) == repair.backward(codes, new)


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "hello.", 1), (1, 1, "user", "why?", 1), (1, 2, "user", "cut", 1)]
    made = repair.Repair(spark.createDataFrame(rows, CONVERSATION + ", copies long"))
    lines = [(r.role, r.text, r.edit) for r in made.lines().orderBy("at", "sub").collect()]
    assert [r.audit for r in made.pieces.collect()] == ["IKKR"]
    assert lines == [("user", "", "I"), ("assistant", "hello.", "K"), ("user", "why?", "K"), ("assistant", "cut", "R")]
