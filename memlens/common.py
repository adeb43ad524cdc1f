"""Small DataFrame idioms shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """Double division; null when the denominator is zero or null."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def r6(col: Column) -> Column:
    return F.round(col.cast("double"), 6)


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def clamp01(col: Column) -> Column:
    return F.when(F.isnan(col) | col.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), col)))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per key.

    The rank filter sits right on the window, so Spark limits every map task to
    ``k`` rows per key *before* the exchange (WindowGroupLimit); a hot key moves
    at most ``k`` rows per task, whatever its size.
    """
    window = W.partitionBy(*keys).orderBy(*order) if keys else W.partitionBy(F.lit(0)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Last row per key as an aggregate that combines on the map side (Spark plans it as a sort aggregate inside each task)."""
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_last"))
        .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in cols])
    )


def prefix_counts(df: DataFrame, group: Sequence[str], value: str, coarse: Column,
                  measures: Sequence[str]) -> DataFrame:
    """Exclusive running sums of ``measures`` in ``value`` order inside ``group``.

    ``df`` holds one row per (group, value).  Two levels: totals per coarse
    bucket are summed first, then rows inside one bucket; no task ever sorts a
    whole group.  ``coarse`` must not decrease with ``value``.
    """
    rows = df.withColumn("_coarse", coarse)
    heads = rows.groupBy(*group, "_coarse").agg(*[F.sum(m).alias(f"_h_{m}") for m in measures])
    before = W.partitionBy(*group, F.lit(0)).orderBy("_coarse").rowsBetween(W.unboundedPreceding, -1)
    heads = heads.select(*group, "_coarse",
                         *[F.coalesce(F.sum(f"_h_{m}").over(before), F.lit(0)).alias(f"_b_{m}") for m in measures])
    inner = W.partitionBy(*group, "_coarse").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    for m in measures:
        rows = rows.withColumn(f"_i_{m}", F.coalesce(F.sum(m).over(inner), F.lit(0)))
    joined = rows.join(heads, [*group, "_coarse"])
    for m in measures:
        joined = joined.withColumn(f"before_{m}", F.col(f"_i_{m}") + F.col(f"_b_{m}"))
    return joined.drop("_coarse", *[f"_i_{m}" for m in measures], *[f"_b_{m}" for m in measures])


def sums_and_latest(df: DataFrame, group: Sequence[str], value: str, coarse: Column, measure: str, item: str) -> DataFrame:
    """Sum of ``measure`` over earlier rows (``before``) and the maximum of struct ``item`` up to the row itself (``latest``), in
    ``value`` order inside ``group``.

    The second is an as-of join when items start with the value they appear at.  ``df`` holds one row per (group, value).  Two
    levels: each coarse bucket's sum and last item are found first and carried over bucket borders, then rows inside one
    bucket are walked; no task ever sorts a whole group.  ``coarse`` must not decrease with ``value``.
    """
    rows = df.withColumn("_coarse", coarse)
    earlier = W.partitionBy(*group, F.lit(0)).orderBy("_coarse").rowsBetween(W.unboundedPreceding, -1)
    heads = rows.groupBy(*group, "_coarse").agg(F.sum(measure).alias("_sum"), F.max(item).alias("_item")).select(
        *group, "_coarse", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"), F.max("_item").over(earlier).alias("_carried"))
    inner = W.partitionBy(*group, "_coarse").orderBy(value)
    walked = rows.withColumns({"_inner": F.coalesce(F.sum(measure).over(inner.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
                               "_latest": F.max(item).over(inner.rowsBetween(W.unboundedPreceding, 0))})
    joined = walked.join(heads, [*group, "_coarse"])
    return joined.withColumns({"before": F.col("_base") + F.col("_inner"), "latest": F.coalesce("_latest", "_carried")}).drop("_coarse", "_base", "_inner", "_carried", "_latest")


def stabbing_nodes(low: Column, high: Column, bits: int) -> Column:
    """Dyadic nodes (level, place) that tile the whole numbers low..high, which are at most 2**bits apart: two per level at most.

    A point lies in exactly one tile of an interval that holds it, and its own nodes are ``point_nodes``; so "which intervals
    hold this point" is an equality join on nodes, whose interval side can be aggregated per node beforehand.
    """
    def tiles(level: Column) -> Column:
        # the next level's nodes that lie inside are left to it; what sticks out on either side is tiled here
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        first, last = F.ceil(low / size), F.floor((high + 1) / size) - 1
        top, inside = level == bits, first <= last
        left = inside & (top | (F.pmod(first, F.lit(2)) == 1))
        right = inside & (first != last) & (top | (F.pmod(last, F.lit(2)) == 0)) | inside & (first == last) & ~left
        node = lambda place: F.struct(level.alias("level"), place.cast("bigint").alias("place"))
        return F.array(F.when(left, node(first)), F.when(right, node(last)))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bits)), tiles)), lambda t: t.isNotNull())


def point_nodes(value: Column, bits: int) -> Column:
    """The dyadic nodes that hold a whole number, one per level."""
    return F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda level: F.struct(level.alias("level"), F.call_function("shiftright", value.cast("bigint"), level).alias("place")))


def exact_medians(df: DataFrame, group: Sequence[str], value: str, width: float) -> DataFrame:
    """(group, median_avg, median_upper): mean of the two middle values, and the upper middle one.

    Works on counts of distinct values with two-level running sums instead of a
    percentile buffer that would hold one group's values in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    placed = prefix_counts(counts, group, value, F.floor(F.col(value) / F.lit(float(width))), ["n"])
    totals = counts.groupBy(*group).agg(F.sum("n").alias("_total"))
    placed = placed.join(totals, list(group)) if group else placed.withColumn("_total", totals.scalar())
    lo, hi = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)

    def at(pos: Column) -> Column:
        inside = (F.col("before_n") <= pos) & (pos < F.col("before_n") + F.col("n"))
        return F.max(F.when(inside, F.col(value).cast("double")))

    return placed.groupBy(*group).agg(((at(lo) + at(hi)) / 2).alias("median_avg"), at(hi).alias("median_upper"))


def with_position(df: DataFrame, key: str, ts_ms: str, tie: str, pos: str = "pos") -> DataFrame:
    """Dense 0-based position of every row inside ``key`` by (ts, tie), safe for a hot key.

    Rows are counted per (key, hour, second); offsets are prefix sums over
    seconds of an hour and hours of a key; only rows of one second of one key
    are ever ranked together.
    """
    rows = df.withColumn("_hour", F.floor(F.col(ts_ms) / 3_600_000)).withColumn("_sec", F.floor(F.col(ts_ms) / 1000))
    secs = rows.groupBy(key, "_hour", "_sec").agg(F.count("*").alias("_n"))
    hours = secs.groupBy(key, "_hour").agg(F.sum("_n").alias("_hn"))
    before = lambda w: F.coalesce(F.sum(w[0]).over(w[1].rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    hours = hours.select(key, "_hour", before(("_hn", W.partitionBy(key).orderBy("_hour"))).alias("_hoff"))
    secs = secs.select(key, "_hour", "_sec", before(("_n", W.partitionBy(key, "_hour").orderBy("_sec"))).alias("_soff"))
    offsets = secs.join(hours, [key, "_hour"]).select(key, "_sec", (F.col("_hoff") + F.col("_soff")).alias("_off"))
    rank = F.row_number().over(W.partitionBy(key, "_sec").orderBy(ts_ms, tie))
    return (
        rows.withColumn("_rn", rank)
        .join(offsets, [key, "_sec"])
        .withColumn(pos, F.col("_off") + F.col("_rn") - 1)
        .drop("_hour", "_sec", "_rn", "_off")
    )


def with_halo_chunks(df: DataFrame, pos: str, halo: int, rows_per_chunk: int = 20_000, ahead: bool = False) -> DataFrame:
    """Cut long sequences into chunks; every chunk also gets the ``halo`` rows before it (behind it with ``ahead``).

    Adds ``_chunk`` and ``_halo`` (true on borrowed rows).  A window over
    (key, _chunk) ordered by ``pos`` then sees all it needs, and one hot key is
    spread over many tasks.
    """
    home = F.floor(F.col(pos) / rows_per_chunk)
    inside = F.col(pos) % rows_per_chunk
    if ahead:
        lends, other = (inside < halo) & (home > 0), home - 1
    else:
        lends, other = inside >= rows_per_chunk - halo, home + 1
    copies = F.when(lends, F.array(home, other)).otherwise(F.array(home))
    return df.withColumn("_chunk", F.explode(copies)).withColumn("_halo", F.col("_chunk") != home)
