"""Vector search with cluster bounds against brute force."""

import numpy as np
import pytest

from memlens.operators import vectors as VC

SCHEMA = "vec_id long, embedding array<double>, label string"


def clustered(n, centres=12, dims=16, seed=1, spread=0.08):
    rng = np.random.default_rng(seed)
    means = rng.normal(size=(centres, dims))
    means /= np.linalg.norm(means, axis=1, keepdims=True)
    return [(i, (means[i % centres] + spread * rng.normal(size=dims)).tolist()) for i in range(n)]


def brute(queries, vectors, k, least, block=None):
    unit = lambda v: np.array(v) / np.linalg.norm(v) if v and any(v) else np.zeros(len(v or []))
    units = {i: unit(v) for i, v, *_ in vectors}
    blocks = {i: b for i, _, b in vectors}
    out = {}
    for q, v, b in queries:
        if v is None:
            continue
        u, hits = unit(v), []
        for i, w in units.items():
            if i != q and (block is None or blocks[i] == b):
                c = round(float(u @ w), 6) if len(u) == len(w) else 0.0
                if c >= least:
                    hits.append((-c, i))
        out |= {(q, r): (i, -c) for r, (c, i) in enumerate(sorted(hits)[:k], 1)}
    return out


def found(spark, queries, vectors, k, least=0.3, block=None):
    q = spark.createDataFrame([(i, v, b) for i, v, b in queries], SCHEMA.replace("vec_id", "query_id"))
    rows = VC.cosine_topk(q, spark.createDataFrame(vectors, SCHEMA), k, least, block).collect()
    return {(r.query_id, r["rank"]): (r.vec_id, r.cosine) for r in rows}


def same(got, want):
    assert got.keys() == want.keys()
    assert all(abs(got[x][1] - want[x][1]) < 2e-6 for x in want)
    assert sum(got[x][0] != want[x][0] for x in want) <= 0.01 * len(want)  # neighbours whose sixth place is rounded apart


@pytest.fixture
def small_clusters(monkeypatch):
    monkeypatch.setattr(VC, "CLUSTER_ROWS", 40)
    monkeypatch.setattr(VC, "PART_ROWS", 25)


def test_equals_brute_force_with_and_without_blocks(spark, small_clusters):
    vectors = [(i, v, "hot" if i % 3 else f"b{i % 7}") for i, v in clustered(500)]
    queries = vectors[::7] + [(9_000 + i, v, "hot") for i, v in clustered(6, seed=5)]
    for block in ("label", None):
        same(found(spark, queries, vectors, 5, 0.3, block), brute(queries, vectors, 5, 0.3, block))


def test_odd_vectors(spark, small_clusters):
    vectors = [(i, v, None) for i, v in clustered(200)] + [(1000, [0.0] * 16, None), (1001, [1.0, 2.0], None), (1002, [], None), (1004, [3.0, 1.0], None)]
    queries = vectors[-4:] + vectors[:5] + [(2000, None, None)]
    for least in (0.3, -1.0):
        same(found(spark, queries, vectors + [(1003, None, None)], 4, least), brute(queries, vectors, 4, least))
    assert found(spark, [], vectors, 4) == {} and found(spark, queries, [], 4) == {}


def test_bounds_leave_most_pairs_out(spark, small_clusters, monkeypatch):
    """On clustered vectors under half of the pairs are compared, both steps together."""
    vectors = [(i, v, None) for i, v in clustered(900, centres=15)]
    offers = []
    monkeypatch.setattr(VC, "cut", lambda df, own=VC.cut: offers.append(own(df)) or offers[-1])
    got = found(spark, vectors, vectors, 5)
    assert len(got) == 4500
    dealt, asked, floors = offers[-3:]
    size = {r.cluster: r["count"] for r in dealt.groupBy("cluster").count().collect()}
    floor = {r.query_id: r.floor for r in floors.collect()}
    rows = asked.collect()
    pairs = sum(size[r.cluster] for r in rows if r["first"]) + sum(size[r.cluster] for r in rows if r.bound + VC.SLACK >= floor[r.query_id])
    assert len(floor) == 900 and len(size) > 10 and pairs < 0.5 * 900 * 900


def test_queries_of_one_cluster_in_several_portions(spark, monkeypatch):
    """Ties, several portions and stripes, zero vectors and another length, as by brute force."""
    for name, value in (("PART_ROWS", 20), ("PORTION_ROWS", 16), ("STRIPE_ROWS", 3)):
        monkeypatch.setattr(VC, name, value)
    rows = [(i, v, "a") for i, v in clustered(60, centres=3, dims=4)]
    rows += [(60 + i, rows[i][1], "a") for i in range(10)] + [(80, [0.0] * 4, "a"), (81, [1.0, 2.0], "a")]
    assert found(spark, rows, rows, 3, 0.3, "label") == brute(rows, rows, 3, 0.3, "label")


def test_queries_are_not_sent_to_every_cluster(spark, small_clusters, monkeypatch):
    """Where bounds save nothing a query travels once per part of its block, not once per cluster, and all is found."""
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=16).tolist(), None) for i in range(600)] + [(600, [0.0] * 16, None), (601, [1.0, 2.0], None)]
    tables = []
    monkeypatch.setattr(VC, "cut", lambda df, own=VC.cut: tables.append(own(df)) or tables[-1])
    same(found(spark, vectors, vectors, 5), brute(vectors, vectors, 5, 0.3))
    asked = [t for t in tables if {"query_id", "cluster"} <= set(t.columns)]
    assert asked and max(t.count() for t in asked) == len(vectors)
