"""Learning from outcomes: quality, signal posteriors, weight draws, isotonic calibration (F operators)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlens import fixed_values as V
from memlens.common import count_if
from memlens.functions import text as T
from memlens.functions.scores import wilson_lower
from memlens.session import cut

# --- F2..F5 -----------------------------------------------------------------------


def trace_quality(traces: DataFrame, feedback: DataFrame) -> DataFrame:
    """Recall and helpful counts with the Wilson score; 0.5 without feedback."""
    f = feedback.groupBy("trace_id").agg(F.count("*").alias("recall_count"), count_if(F.col("helpful")).alias("helpful_count"), F.max("ts").alias("last_recalled_at"))
    z = lambda c: F.coalesce(c, F.lit(0))
    score = F.when(z("recall_count") == 0, F.lit(0.5)).otherwise(wilson_lower(z("helpful_count"), z("recall_count")))
    return traces.select("trace_id").join(f, "trace_id", "left").select(
        "trace_id", z("recall_count").alias("recall_count"), z("helpful_count").alias("helpful_count"), "last_recalled_at", score.alias("q_score"))


def _signal_rows(feedback: DataFrame, *cols: str) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("value")) for s in V.SIGNALS])
    return feedback.select(*cols, "helpful", F.explode(parts).alias("p")).select(*cols, "helpful", "p.signal", "p.value").where("value > 0")


def _prior(which: int) -> Column:
    return T.lookup(F.col("signal"), {s: str(p[which]) for s, p in V.SIGNAL_PRIORS.items()}).cast("double")


def _all_signals(spark) -> DataFrame:
    return spark.range(1).select(F.explode(T.literal_array(V.SIGNALS)).alias("signal"))


def global_posteriors(feedback: DataFrame) -> DataFrame:
    """alpha/beta per signal: each positive signal value adds to alpha when helpful, else to beta."""
    seen = _signal_rows(feedback).groupBy("signal").agg(
        F.sum(F.when(F.col("helpful"), F.col("value")).otherwise(0.0)).alias("a"), F.sum(F.when(~F.col("helpful"), F.col("value")).otherwise(0.0)).alias("b"))
    p = _all_signals(feedback.sparkSession).join(seen, "signal", "left").select(
        "signal", (_prior(0) + F.coalesce("a", F.lit(0.0))).alias("alpha"), (_prior(1) + F.coalesce("b", F.lit(0.0))).alias("beta"))
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    total = F.sum(mean).over(W.partitionBy(F.lit(0)))  # five rows
    return p.select("signal", "alpha", "beta", mean.alias("mean"), (mean / total).alias("weight"))


def bucket_key(language: Column, framework: Column, error_type: Column) -> Column:
    norm = lambda c: F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("_"))
    return F.concat_ws("|", norm(language), norm(framework), norm(error_type))


def bucket_posteriors(feedback: DataFrame, strength: float = V.BUCKET_STRENGTH) -> DataFrame:
    """Per language|framework|error bucket: observations shrunk to the global weights with ``strength``."""
    g = global_posteriors(feedback).select("signal", F.col("weight").alias("prior"))
    obs = _signal_rows(feedback, "bucket").groupBy("bucket", "signal").agg(
        F.sum(F.when(F.col("helpful"), F.col("value")).otherwise(0.0)).alias("a"), F.sum(F.when(~F.col("helpful"), F.col("value")).otherwise(0.0)).alias("b"))
    cells = feedback.select("bucket").distinct().select("bucket", F.explode(T.literal_array(V.SIGNALS)).alias("signal"))
    j = cells.join(obs, ["bucket", "signal"], "left").join(g, "signal")
    alpha = strength * F.col("prior") + F.coalesce("a", F.lit(0.0))
    beta = strength * (1 - F.col("prior")) + F.coalesce("b", F.lit(0.0))
    p = j.select("bucket", "signal", alpha.alias("alpha"), beta.alias("beta")).withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))
    return p.withColumn("weight", F.col("mean") / F.sum("mean").over(W.partitionBy("bucket")))  # five rows per bucket


def draw_weights(queries: DataFrame, buckets: DataFrame, fallback: DataFrame, seed: int = 0, embeddings: bool = False,
                 strength: float = V.BUCKET_STRENGTH) -> DataFrame:
    """One seeded Beta draw per query and signal, normalised; the seed is kept beside it.

    ``queries(query_id, bucket)``; an unseen bucket draws from the global weights
    of ``fallback``.  A query draws the same numbers in whatever partition it lands.
    """
    wide = lambda d, c: [F.max(F.when(F.col("signal") == s, F.col(c))).alias(f"{c}_{s}") for s in V.SIGNALS]
    b = buckets.groupBy("bucket").agg(*wide(buckets, "alpha"), *wide(buckets, "beta"))
    g = fallback.select("signal", (strength * F.col("weight")).alias("alpha"), (strength * (1 - F.col("weight"))).alias("beta"))
    g = g.agg(F.struct(*[F.max(F.when(F.col("signal") == s, F.col(c))).alias(f"{c}_{s}") for c in ("alpha", "beta") for s in V.SIGNALS]).alias("g")).select("g").scalar()
    params = [f"{c}_{s}" for s in V.SIGNALS for c in ("alpha", "beta")]
    j = queries.select("query_id", "bucket").join(b, "bucket", "left").withColumn("_g", g)
    j = j.select("query_id", F.xxhash64(F.col("query_id").cast("string"), F.lit(seed)).alias("seed"), *[F.coalesce(F.col(p), F.col(f"_g.{p}")).alias(p) for p in params])
    used = [s for s in V.SIGNALS if embeddings or s != "cosine"]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.zeros((len(pdf), len(V.SIGNALS)))
            for row, s in enumerate(pdf["seed"]):
                rng = np.random.default_rng(int(s) & (2**63 - 1))
                for col, name in enumerate(V.SIGNALS):
                    if name in used:
                        out[row, col] = rng.beta(pdf[f"alpha_{name}"].iloc[row], pdf[f"beta_{name}"].iloc[row])
            out /= np.maximum(out.sum(axis=1, keepdims=True), 1e-300)
            res = pd.DataFrame(out, columns=V.SIGNALS)
            res.insert(0, "query_id", pdf["query_id"].to_numpy())
            res["seed"] = pdf["seed"].to_numpy()
            yield res

    schema = f"query_id {dict(queries.dtypes)['query_id']}, " + ", ".join(f"{s} double" for s in V.SIGNALS) + ", seed long"
    return j.mapInPandas(draw, schema)


# --- F6, F7 isotonic ------------------------------------------------------------------

SLOPE_UNIT = 65_536  # slopes that cut the hull are whole multiples of 1/SLOPE_UNIT, so comparing sums of whole labels is exact
PAGE_ROWS = 1_024
DIRECTORY_BITS = 24
SCORES_PER_TASK = 1_000_000
BLOCKS = "run long, ord long, sx double, sy double, w double"


def _pool(sx: np.ndarray, sy: np.ndarray, w: np.ndarray) -> list[tuple[float, float, float]]:
    """Adjacent violators pooled: a block joins the one before it while that one's mean is higher."""
    stack: list[tuple[float, float, float]] = []
    for x, y, n in zip(sx, sy, w):
        while stack and stack[-1][1] / stack[-1][2] > y / n:
            px, py, pn = stack.pop()
            x, y, n = px + x, py + y, pn + n
        stack.append((x, y, n))
    return stack


def _blocks(stack: list[tuple[float, float, float]], **keys: int) -> pd.DataFrame:
    sx, sy, w = zip(*stack)
    return pd.DataFrame({**keys, "ord": np.arange(len(stack)), "sx": sx, "sy": sy, "w": w})


def _pool_run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One sorted range of points, batch by batch; only its blocks are held."""
    stack, run = [], None
    for pdf in batches:
        if len(pdf):
            run = int(pdf["run"].iloc[0])
            parts = [(pdf["x"].to_numpy(dtype=float), pdf["y"].to_numpy(dtype=float), np.ones(len(pdf)))]
            if stack:
                parts.insert(0, tuple(np.array(c) for c in zip(*stack)))
            stack = _pool(*[np.concatenate(c) for c in zip(*parts)])
    if stack:
        yield _blocks(stack, run=run)


def _merge_runs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["run", "ord"])
    return _blocks(_pool(pdf["sx"].to_numpy(), pdf["sy"].to_numpy(), pdf["w"].to_numpy()), segment=int(key[0]), run=int(key[1]))


def hull_segments(blocks: DataFrame, slopes: int) -> DataFrame:
    """``segment`` per block of locally pooled runs: no block of the whole fit reaches over a segment's border.

    The fit is the lower convex hull of running sums (w, y).  Where the hull turns to a slope t is the place of the least
    y - t * w, and a run's own least lies behind its last block of mean <= t, so runs give one sum per slope band and the hull's
    touching points follow by a minimum over runs.  Slopes are quantiles of block means.
    """
    mean = F.col("sy") / F.col("w")
    quantiles = F.percentile_approx(mean, [i / slopes for i in range(1, slopes)], 10_000)
    levels = F.array_sort(F.array_distinct(F.transform(quantiles, lambda q: F.round(q * SLOPE_UNIT).cast("long"))))
    empty = lambda kind: F.array().cast(kind)
    grid = cut(blocks.agg(F.coalesce(levels, empty("array<bigint>")).alias("a"))).select("a").scalar()  # one reading of the approximate quantiles
    steep = F.size(F.filter("_grid", lambda a: F.col("sy") * SLOPE_UNIT > a * F.col("w")))
    bands = blocks.withColumn("_grid", grid).groupBy("run", steep.alias("band")).agg(F.sum("sy").alias("y"), F.sum("w").alias("w"), F.count("*").alias("n"))
    per_run = bands.groupBy("run").agg(F.collect_list(F.struct("band", "y", "w", "n")).alias("b"), F.sum("y").alias("ry"), F.sum("w").alias("rw"))
    earlier = W.partitionBy(F.lit(0)).orderBy("run").rowsBetween(W.unboundedPreceding, -1)  # one row per range partition
    start = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0.0))
    runs = per_run.select("run", "b", start("ry").alias("y0"), start("rw").alias("w0")).withColumn("_grid", grid)
    places = runs.select("run", "b", "y0", "w0", F.posexplode("_grid").alias("level", "a"))
    upto = lambda field, zero: F.aggregate(F.filter("b", lambda x: x["band"] <= F.col("level")), zero, lambda s, x: s + x[field])
    gap = (F.col("y0") + upto("y", F.lit(0.0))) * SLOPE_UNIT - F.col("a") * (F.col("w0") + upto("w", F.lit(0.0)))
    touch = places.select("level", F.struct(gap.alias("gap"), "run", upto("n", F.lit(0).cast("long")).alias("ord")).alias("p")).groupBy("level").agg(F.min("p").alias("p"))
    cuts = touch.agg(F.collect_list(F.struct(F.col("p.run").alias("run"), F.col("p.ord").alias("ord"))).alias("c")).select("c").scalar()
    behind = F.filter("_cuts", lambda c: (c["run"] < F.col("run")) | (c["run"] == F.col("run")) & (c["ord"] <= F.col("ord")))
    return blocks.withColumn("_cuts", cuts).withColumn("segment", F.size(behind).cast("long")).drop("_cuts")


def fit_isotonic(points: DataFrame, fan_in: int = 64, slopes: int = 64) -> DataFrame:
    """``points(x, y, ts, event_id)`` -> breakpoints (position, x, y, weight), exactly as one sequential pass over whole-number labels.

    Range partitions in (x, ts, event_id) order are pooled where they lie and only block sums travel.  ``hull_segments`` cuts them
    where the whole fit has borders, so up to ``slopes`` segments are finished apart; inside a segment runs of ``fan_in`` neighbours are
    pooled level by level.  No task sees all blocks.
    """
    spark = points.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["x", "ts", "event_id"]
    ranged = points.select(*order, "y").repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("run", F.spark_partition_id().cast("long"))
    blocks = hull_segments(cut(ranged.mapInPandas(_pool_run, BLOCKS)), slopes)
    left = parts
    while True:
        blocks = blocks.groupBy("segment", F.floor(F.col("run") / fan_in).alias("_to")).applyInPandas(_merge_runs, f"segment long, {BLOCKS}")
        left = -(-left // fan_in)
        if left <= 1:
            break
    blocks = cut(blocks)
    sizes = blocks.groupBy("segment").agg(F.count("*").alias("n"))  # at most ``slopes`` rows
    before = F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("segment").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.join(sizes.select("segment", before.alias("before")), "segment")
    return placed.select((F.col("before") + F.col("ord")).alias("position"), (F.col("sx") / F.col("w")).alias("x"), (F.col("sy") / F.col("w")).alias("y"), F.col("w").cast("long").alias("weight"))


def fit_calibrator(points: DataFrame, min_points: int = V.MIN_CALIBRATION_POINTS) -> DataFrame:
    """Breakpoints, or no rows when there are too few points to learn from."""
    model = fit_isotonic(points)
    total = model.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("n")).select("n").scalar()
    return model.where(total >= min_points)


def _last_below(entries: Column, value: Column, bits: int) -> Column:
    """0-based place of the last entry with ``x`` below ``value`` in an array ordered by ``x``, by halving; 0 when there is none."""
    def step(at: Column, width: Column) -> Column:
        ahead = at + width
        return F.when((ahead < F.size(entries)) & (F.get(entries, ahead)["x"] < value), ahead).otherwise(at)

    return F.aggregate(F.array(*[F.lit(1 << b) for b in reversed(range(bits))]), F.lit(0), step)


def predict_isotonic(scores: DataFrame, model: DataFrame, score_col: str = "score", page_rows: int = PAGE_ROWS, scores_per_task: int = SCORES_PER_TASK) -> DataFrame:
    """Linear interpolation between breakpoints, flat outside them, identity for an empty model; a null score gives null.

    Breakpoints lie in pages of at most ``page_rows`` positions, each an ordered array, and a directory of first breakpoints is one
    array in every row's reach (a page per thousand breakpoints).  A score finds its page and then its segment by halving.  A page that
    more than ``scores_per_task`` scores ask for, as when many scores are equal, is dealt out in copies.
    """
    lines = model.select(F.floor(F.col("position") / page_rows).alias("page"), "position", "x", "y")
    pages = lines.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("position", "x", "y"))).alias("points"))
    heads = pages.select("page", F.col("points")[0]["x"].alias("x"), F.col("points")[0]["y"].alias("y"))
    ends = model.agg(F.struct(F.min(F.struct("position", "x", "y")).alias("lo"), F.max(F.struct("position", "x", "y")).alias("hi")).alias("e")).select("e").scalar()
    directory = heads.agg(F.array_sort(F.collect_list(F.struct("page", "x", "y"))).alias("d")).select("d").scalar()
    x, lo, hi = F.col(score_col), F.col("_e.lo"), F.col("_e.hi")
    inner = (x > lo["x"]) & (x < hi["x"])
    s = scores.withColumn("_e", ends).withColumn("_d", directory).withColumn("_at", F.when(inner, _last_below(F.col("_d"), x, DIRECTORY_BITS)))
    s = s.withColumns({"_page": F.get("_d", F.col("_at"))["page"], "_next": F.get("_d", F.col("_at") + 1)}).drop("_d", "_at")
    asked = s.where("_page IS NOT NULL").groupBy(F.col("_page").alias("page")).agg(F.count("*").alias("n"))
    dealt = asked.select("page", F.ceil(F.col("n") / scores_per_task).cast("int").alias("copies"))
    shares = dealt.agg(F.map_from_entries(F.collect_list(F.when(F.col("copies") > 1, F.struct("page", "copies")))).alias("m")).select("m").scalar()
    salt = F.when(F.col("_page").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.coalesce(F.try_element_at("_m", F.col("_page")), F.lit(1))))
    s = s.withColumn("_m", shares).withColumn("_salt", salt.cast("int")).drop("_m")
    copies = pages.join(dealt, "page").select(F.col("page").alias("_page"), "points", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("_salt"))
    j = s.join(copies, ["_page", "_salt"], "left")
    j = j.withColumn("_i", _last_below(F.col("points"), x, (page_rows - 1).bit_length())).withColumn("_a", F.get("points", F.col("_i")))
    after = F.get("points", F.col("_i") + 1)
    bx, by = F.coalesce(after["x"], F.col("_next.x")), F.coalesce(after["y"], F.col("_next.y"))
    t = (x - F.col("_a.x")) / (bx - F.col("_a.x"))
    p = (F.when(lo["x"].isNull(), x).when(x <= lo["x"], lo["y"]).when(x >= hi["x"], hi["y"]).otherwise(F.col("_a.y") + t * (by - F.col("_a.y"))))
    return j.select(*scores.columns, p.alias("prob"))


# --- F9 --------------------------------------------------------------------------------


def refit_due(log: DataFrame, key: str = "run_id", after: int = V.REFIT_AFTER_OUTCOMES) -> DataFrame:
    """Outcomes since the last fit per workspace and whether a refit is due."""
    fits = log.where("event = 'calibrator_refit'").groupBy(key).agg(F.max("ts").alias("last_fit"))
    outs = log.where("event = 'outcome'").select(key, "ts").join(fits, key, "left").groupBy(key).agg(
        count_if(F.col("last_fit").isNull() | (F.col("ts") > F.col("last_fit"))).alias("outcomes_since_fit"), F.max("last_fit").alias("last_fit"))
    return outs.withColumn("due", F.col("outcomes_since_fit") >= after)
