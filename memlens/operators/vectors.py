"""Exact nearest vectors by cosine, with cluster bounds (C4).

Vectors of a crowded block are dealt to the nearest of some centroids; a cluster knows its radius, the largest angle between
its centroid and a member.  A query at angle t from a centroid is at least t - radius away from every member, so a cluster's
best possible cosine is cos(t - radius).

1. A query's clusters of best bound are searched until they hold a few times k vectors; the k-th cosine found is a floor.
2. Then all clusters whose bound reaches the floor (and ``min_score``) are searched; nothing else can hold a winner.

Centroids come from a bounded sample, at most MAX_CENTROIDS over all blocks, and go to every task with the clusters' radii and
sizes.  Blocks of up to CLUSTER_ROWS vectors are one cluster without a centroid.  Clusters are cut into parts by their measured
size and the queries that open one into portions, whose cosines are products of two matrices; so neither a block nor a cluster is one task, and without a blocking key clusters take its place.

A query travels once per part of each cluster it opens.  Where vectors lie so that the sample's rows would open many clusters, bounds
save little and copies of queries would be most of what travels: then every block is one cluster, whose large parts and portions
meet as a whole.  Either way finds the same.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlens import fixed_values as V
from memlens.common import top_k
from memlens.functions import scores
from memlens.operators.postings import few
from memlens.session import cut

CLUSTER_ROWS = 512
PART_ROWS = 16_384
PORTION_ROWS = 16_384
STRIPE_ROWS = 256
MAX_CENTROIDS = 4096
SAMPLE_PER_CENTROID = 4
ROUNDS = 6
FIRST_ROWS = 4
TRIAL_ROWS = 512
MOST_OPEN = 16
MOST_SHARE = 0.5
SLACK = 1e-5
APART = -1  # cluster of vectors that have no angle: zero ones, and those of another length than the centroids


def _centroids(sample: np.ndarray, n: int) -> np.ndarray:
    """Spherical means of a sample, from its first rows; a mean that attracts nothing stays where it is."""
    means = sample[:n].copy()
    for _ in range(ROUNDS):
        near = (sample @ means.T).argmax(axis=1)
        sums = np.zeros_like(means)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        means = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), means)
    return means


def fit(vectors: DataFrame) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Centroids of crowded blocks of ``vectors(vec_id, unit, blk)``, and the rows they come from: SAMPLE_PER_CENTROID per centroid with least hash."""
    sizes = vectors.groupBy("blk").agg(F.count("*").alias("n")).where(F.col("n") > CLUSTER_ROWS)
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    if not total:
        return {}, {}
    rows_each = max(CLUSTER_ROWS // 2, -(-total // MAX_CENTROIDS))
    wanted = sizes.select("blk", F.ceil(F.col("n") / rows_each).cast("int").alias("clusters"))
    least = top_k(vectors.select("vec_id", "unit", "blk").join(wanted, "blk"), ["blk"], [F.xxhash64("vec_id"), F.asc("vec_id")], MAX_CENTROIDS * SAMPLE_PER_CENTROID)
    found = defaultdict(list)
    for r in least.where(F.col("rank") <= F.col("clusters") * SAMPLE_PER_CENTROID).orderBy("blk", "rank").select("blk", "clusters", "unit").collect():
        found[r.blk, r.clusters].append(r.unit)
    out, samples = {}, {}
    for (blk, n), rows in found.items():
        length = max({len(r) for r in rows}, key=lambda m: sum(len(r) == m for r in rows))
        own = np.array([r for r in rows if len(r) == length and any(r)])
        if len(own):
            out[blk], samples[blk] = _centroids(own, n), own
    return out, samples


def _angles(unit: np.ndarray, means: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(means @ unit, -1.0, 1.0))


def _deal(model: dict[str, np.ndarray]):
    """Adds (cluster, angle) to vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clusters, angles = [], []
            for blk, unit in zip(batch.column("blk").to_pylist(), batch.column("unit"), strict=True):
                means = model.get(blk)
                row = unit.values.to_numpy() if unit.is_valid else np.zeros(0)
                if means is None:
                    clusters.append(0)
                    angles.append(np.pi)
                elif len(row) != means.shape[1] or not row.any():
                    clusters.append(APART)
                    angles.append(np.pi)
                else:
                    turn = _angles(row, means)
                    clusters.append(int(turn.argmin()))
                    angles.append(float(turn.min()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(clusters, pa.int32()), pa.array(angles, pa.float64())], [*batch.schema.names, "cluster", "angle"])

    return run


def _bounds(model: dict[str, np.ndarray], known: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, min_score: float):
    """(query_id, blk, cluster, bound, first) of the clusters whose bound reaches ``min_score``; ``known``: cluster, radius and size by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for i, (blk, unit) in enumerate(zip(batch.column("blk").to_pylist(), batch.column("unit"), strict=True)):
                means = model.get(blk)
                if means is None:  # a small block is joined without asking how large it is
                    found = [(0, 1.0, True)]
                else:
                    clusters, radius, size = known[blk]
                    row = unit.values.to_numpy() if unit.is_valid else np.zeros(0)
                    bound = np.ones(len(clusters))
                    if len(row) == means.shape[1] and row.any():
                        real = clusters != APART
                        bound[real] = np.cos(np.maximum(_angles(row, means)[clusters[real]] - radius[real], 0.0))
                    order = np.argsort(-bound, kind="stable")
                    before = np.cumsum(size[order]) - size[order]
                    found = [(int(clusters[c]), float(bound[c]), bool(b < FIRST_ROWS * k)) for c, b in zip(order, before, strict=True) if bound[c] + SLACK >= min_score]
                for cluster, bound_, first in found:
                    for column, value in zip(out, (i, blk, cluster, bound_, first), strict=True):
                        column.append(value)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(at), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.bool_())],
                                             ["query_id", "blk", "cluster", "bound", "first"])

    return run


def _saves(model: dict[str, np.ndarray], samples: dict[str, np.ndarray], known: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, min_score: float) -> bool:
    """Whether rows of the samples would open few clusters, and these hold few vectors; a floor is what the sample says of the k-th best."""
    opened, share, n = 0.0, 0.0, 0
    for blk, rows in samples.items():
        clusters, radius, size = known[blk]
        real, asked = clusters != APART, rows[:TRIAL_ROWS]
        angles = np.arccos(np.clip(asked @ model[blk].T, -1.0, 1.0))[:, clusters[real]]
        bound = np.cos(np.maximum(angles - radius[real], 0.0))
        near = asked @ rows.T
        near[np.arange(len(asked)), np.arange(len(asked))] = -1.0
        place = min(max(1, -(-k * len(rows) // int(size.sum()))), len(rows))
        floor = np.maximum(np.partition(near, -place, axis=1)[:, -place], min_score)
        open_ = bound + SLACK >= floor[:, None]
        opened, share, n = opened + open_.sum(), share + (open_ * size[real]).sum() / size.sum(), n + len(asked)
    return opened <= MOST_OPEN * n and share <= MOST_SHARE * n


def _nearest(k: int, min_score: float):
    """The best ``k`` vectors of one part for each query of one portion: products of matrices, STRIPE_ROWS queries at a time."""

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("vec_id")
        out = []
        lengths = held["dv"].map(len).to_numpy()
        for length, some in asked.groupby(asked["qv"].map(len)):
            fits = lengths == length
            matrix = np.array(held["dv"][fits].tolist(), dtype=float).reshape(fits.sum(), length)
            for at in range(0, len(some), STRIPE_ROWS):
                stripe = some.iloc[at:at + STRIPE_ROWS]
                cosine = np.zeros((len(stripe), len(held)))  # 0 for vectors of another length
                cosine[:, fits] = np.floor(np.array(stripe["qv"].tolist(), dtype=float).reshape(len(stripe), length) @ matrix.T * 1e6 + 0.5) / 1e6
                key = np.where(np.isnan(cosine), np.inf, cosine)  # Spark orders NaN last
                key[(key < min_score) | (stripe["query_id"].to_numpy()[:, None] == held["vec_id"].to_numpy()[None, :])] = -np.inf
                least = np.partition(key, -k, axis=1)[:, -k] if k < len(held) else np.full(len(stripe), -np.inf)
                row, col = np.nonzero((key >= least[:, None]) & (key > -np.inf))
                order = np.lexsort((col, -key[row, col], row))  # columns are in order of vec_id
                row, col = row[order], col[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, col = row[kept], col[kept]
                out.append(pd.DataFrame({"query_id": stripe["query_id"].to_numpy()[row], "vec_id": held["vec_id"].to_numpy()[col], "cosine": cosine[row, col]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "cosine": []})

    return run


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, min_score: float = V.COSINE_THRESHOLD, block: str | None = None) -> DataFrame:
    """(query_id, vec_id, cosine, rank): the best ``k`` of ``vectors(vec_id, embedding, block?)`` at ``min_score`` or more for every
    row of ``queries(query_id, embedding, block?)``, inside a blocking key if one is named.

    A vector is not its own neighbour (equal ids).  Vectors of different length and zero vectors have cosine 0.  Ids are the
    same type; null embeddings match nothing.
    """
    blk = F.coalesce(F.col(block).cast("string"), F.lit("\0")) if block else F.lit("")
    unit = scores.unit(F.col("embedding")).alias("unit")
    v = cut(vectors.where(F.col("embedding").isNotNull()).select("vec_id", unit, blk.alias("blk")))
    q = queries.where(F.col("embedding").isNotNull()).select("query_id", unit, blk.alias("blk"))
    model, samples = fit(v)
    dealt = cut(v.mapInArrow(_deal(model), f"{v.schema.simpleString()[7:-1]},cluster:int,angle:double"))
    sizes = dealt.groupBy("blk", "cluster").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    known: dict[str, tuple[list, list, list]] = defaultdict(lambda: ([], [], []))
    if model:  # clusters of crowded blocks: one row per centroid at most, and one apart
        for r in sizes.where(F.col("blk").isin(*model)).collect():
            for column, value in zip(known[r.blk], (r.cluster, r.radius, r.n), strict=True):
                column.append(value)
    known = {b: tuple(np.array(c) for c in columns) for b, columns in known.items()}
    if not _saves(model, samples, known, k, min_score):
        model, dealt = {}, dealt.withColumn("cluster", F.lit(0))
        sizes = dealt.groupBy("blk", "cluster").agg(F.count("*").alias("n"))
    offers = cut(q.mapInArrow(_bounds(model, known, k, min_score), f"query_id {dict(q.dtypes)['query_id']}, blk string, cluster int, bound double, first boolean"))
    parts = few(sizes.select("blk", "cluster", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts")))
    members = dealt.join(parts, ["blk", "cluster"]).select("blk", "cluster", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", F.col("unit").alias("dv"))

    here = ["blk", "cluster", "part", "portion"]
    kind = {c: dict(d.dtypes)[c] for d, c in ((q, "query_id"), (v, "vec_id"))}

    def searched(some: DataFrame) -> DataFrame:
        portions = few(some.groupBy("blk", "cluster").agg(F.ceil(F.count("*") / PORTION_ROWS).cast("int").alias("portions")).join(parts, ["blk", "cluster"]))
        spread = (some.join(portions, ["blk", "cluster"]).withColumn("portion", F.pmod(F.xxhash64("query_id"), F.col("portions")).cast("int"))
                  .select("query_id", "blk", "cluster", "portion", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
        asked = spread.join(q.select("query_id", F.col("unit").alias("qv")), "query_id")
        held = members.join(portions.drop("parts"), ["blk", "cluster"]).select("*", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion")).drop("portions")
        near = asked.groupBy(*here).cogroup(held.groupBy(*here)).applyInPandas(_nearest(k, min_score), f"query_id {kind['query_id']}, vec_id {kind['vec_id']}, cosine double")
        return top_k(near.withColumn("cosine", F.round("cosine", 6)), ["query_id"], [F.desc("cosine"), F.asc("vec_id")], k)

    if not model:
        return searched(offers)
    floors = cut(searched(offers.where("first")).where(F.col("rank") == k).select("query_id", F.col("cosine").alias("floor")))
    open_ = offers.join(floors, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") + SLACK >= F.col("floor")))
    return searched(open_)
