"""Similar sets by sketches against brute force."""

import random

from pyspark.sql import functions as F

from memlens.operators import maintenance as M
from memlens.operators import retrieval as R
from memlens.operators import sketches as SK


def jaccard(a, b):
    return len(a & b) / len(a | b)


def sets(rng, n, words, longest):
    out = []
    for _ in range(n):
        base = set(rng.choice(out)) if out and rng.random() < 0.6 else set(rng.sample(words, rng.randint(1, longest)))
        out.append((base ^ set(rng.sample(words, rng.randint(0, 1 + len(base) // 4)))) or {"w0"})
    return out


def test_pairs_by_sketches_are_all_pairs(spark, monkeypatch):
    """All pairs of one table and of two, over several parts and bands, at thresholds met exactly."""
    monkeypatch.setattr(SK, "TILE_ROWS", 20)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    for threshold in (0.6, 0.75, 1.0):
        a = [*sets(rng, 110, words, 60), set(words[:6]), set(words[:10]), set(words[:3]), set(words[:4])]
        b = sets(rng, 40, words, 30) + a[:10]
        d = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(a)], "id long, tokens array<string>")
        got = {(r.a_id, r.b_id): r.similarity for r in R.jaccard_within(d, threshold).collect()}
        want = {(i, j): round(jaccard(a[i], a[j]), 6) for i in range(len(a)) for j in range(i + 1, len(a)) if jaccard(a[i], a[j]) >= threshold - 1e-12}
        assert got == want and want
        e = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(b)], "b_id long, tokens array<string>")
        rows = R.jaccard_pairs(d.withColumnRenamed("id", "a_id"), e, threshold).collect()
        got = {(r.a_id, r.b_id): r.similarity for r in rows}
        assert len(got) == len(rows) and got == {(i, j): round(jaccard(x, y), 6) for i, x in enumerate(a) for j, y in enumerate(b) if jaccard(x, y) >= threshold - 1e-12}


def test_a_common_word_sends_no_pair_through_an_exchange(spark):
    """Sets that share a few words and no more are dropped in their tile; joined by word, each pair of them was a row of a shuffle."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    d = spark.createDataFrame([(str(i), rng.sample(words, 60)) for i in range(300)], "set_id string, tokens array<string>").withColumn("tokens", F.array_sort("tokens"))
    assert SK.allowed_pairs(d, d, 0.6, True).count() < 10


def test_sets_that_share_no_rare_word_do_not_meet(spark):
    """Sets of 20 words that share a few common ones: sketches alone let hundreds of pairs through to the check of whole sets."""
    rng = random.Random(11)
    common, rare = [f"c{i}" for i in range(60)], [f"r{i}" for i in range(100_000)]
    d = spark.createDataFrame([(str(i), sorted(rng.sample(common, 8) + rng.sample(rare, 12))) for i in range(800)], "set_id string, tokens array<string>")
    assert SK.allowed_pairs(d, d, 0.6, True).count() == 0


def test_pairs_of_near_copies_stay_in_their_cluster(spark):
    """A group of n near copies links with about n rows; as pairs they were n * n / 2 rows of a shuffle, each with both sets."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    base = rng.sample(words, 60)
    d = spark.createDataFrame([(str(i), sorted(rng.sample(base, 57) + rng.sample(words, 3))) for i in range(200)], "set_id string, tokens array<string>")
    assert SK.allowed_pairs(d, d, 0.6, True).count() < 200 * spark.sparkContext.defaultParallelism


def test_hits_and_pairs_over_parts_of_clusters(spark, monkeypatch):
    """Clusters and crowded words in several parts, more clusters than are sent to tasks, copies: counts and pairs as by brute force."""
    for module, name, value in ((SK, "TILE_ROWS", 20), (SK, "CLUSTER_ROWS", 6), (SK.P, "FEW_ROWS", 3), (SK, "CHUNK", 50)):
        monkeypatch.setattr(module, name, value)
    rng = random.Random(7)
    a = sets(rng, 120, [f"w{i}" for i in range(90)], 40)
    a += a[:15]
    d = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(a)], "id long, tokens array<string>")
    near = {(i, j) for i in range(len(a)) for j in range(len(a)) if i != j and jaccard(a[i], a[j]) >= 0.6 - 1e-12}
    assert {(r.a_id, r.b_id) for r in R.jaccard_within(d, 0.6).collect()} == {(i, j) for i, j in near if i < j}
    rows = M.near_duplicate_blocks(d.select(F.col("id").alias("block_id"), F.col("tokens").alias("keywords")), 0.6).collect()
    assert {r.block_id: r.duplicate_hits for r in rows} == {i: sum(x == i for x, _ in near) for i in range(len(a))}


def test_health_sends_no_keywords_through_its_joins(spark):
    """Only how many keywords a block has is needed behind the joins."""
    from memlens.plans.catalog import registry
    plan = registry()["d12_memory_health"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = lambda word: [i for i, line in enumerate(plan) if word in line]
    assert at("Join")[0] < at("size(")[0]
