"""op1: against brute force, and its tree alone."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from memlens.llm import jaccard
from memlens.llm.components import components


def rows_of(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect() if r.doc_id is not None)


def noisy_texts(seed, n):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 3, 4, 5, 6, 9, 20, 60, 200]))]
        for _ in range(rng.randrange(1, 7)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
            out.append(" ".join(words))
    return out[:n]


def test_tree_finds_the_classes_that_all_pairs_give():
    texts = noisy_texts(3, 300)
    sets = list(jaccard.shingle_sets(pa.array(texts)))
    classes = jaccard.tree_join(sets)
    want = brute.jaccard_components(enumerate(texts))
    assert [classes.root(i) for i in range(len(texts))] == [want[i][1] for i in range(len(texts))]
    assert [len(s) for s in sets] == [want[i][0] for i in range(len(texts))]


@pytest.mark.parametrize("a, b, linked", [("a b c d e f g h", "a b c d e f g h i", True), ("a b c d e f g", "a b c d e f g h", False)])
def test_threshold_is_inclusive(a, b, linked):  # 4 of 5 shingles link, 3 of 4 do not
    assert (jaccard.tree_join(list(jaccard.shingle_sets(pa.array([a, b])))).root(1) == 0) is linked


def test_pruning_never_drops_a_pair():
    rng = np.random.default_rng(5)
    for _ in range(60):
        base = np.unique(rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64))
        other = np.unique(np.concatenate([base[: int(len(base) * 0.95) or 1], rng.integers(0, 2**63, 3).astype(np.uint64)]))
        a, b = (jaccard.Node(jaccard._bitmap(s), len(s), len(s), len(s) - int(np.bitwise_count(jaccard._bitmap(s)).sum()), [0], True) for s in (base, other))
        if jaccard.similar(base, other, 80, 100):
            assert jaccard.may_link(a, b, 80, 100)


def test_given_documents(documents):
    want = brute.jaccard_components([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    assert rows_of(jaccard.near_copies(documents)) == sorted((d, *v) for d, v in want.items())


def test_large_groups_in_tiles(spark, monkeypatch):
    texts = noisy_texts(11, 160)
    monkeypatch.setattr(jaccard, "TILE_SHINGLES", 150)
    got = rows_of(jaccard.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert got == sorted((d, *v) for d, v in brute.jaccard_components(enumerate(texts)).items())


def test_odd_rows(odd, empty):
    got = jaccard.near_copies(odd).collect()
    assert len(got) == odd.count()
    by_id = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None}
    assert by_id[1] == (0, 1) and by_id[2] == (0, 2) and by_id[3] == (0, 3)
    assert by_id[5][1] == 4 and by_id[4][1] == 4 and by_id[6] == (1, 6) and by_id[7] == (1, 6)
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert jaccard.near_copies(empty).count() == 0


def test_components_of_a_chain_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(500, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 40)}, **{i: 200 for i in range(200, 209)}}
