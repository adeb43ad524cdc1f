"""Sharding by a hierarchical weighted hash tree (regions, racks, shards).

A row descends from the root: at each node every child draws -log(u) / weight, where u is a fixed hash of (key, child) in
(0, 1) and the weight is the sum below the child, and the least draw is entered.  A row costs one draw per child of
the nodes on its path, not one per shard.

A child's draw depends on the key and on its own weight alone.  If a weight grows, only draws on the path to it fall: at
each level rows leave unchanged children only for the changed one, and rows inside an unchanged child stay where they are.
A new shard opens a region of its own (``grow``), so rows move only into that shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RACK_SHARDS = 4
REGION_RACKS = 2
SLOT_BUCKETS = 2048
LEVELS = ("region", "rack", "shard")
Tree = dict[int, dict[int, dict[int, float]]]


def uniform_tree(shards: int, rack_shards: int = RACK_SHARDS, region_racks: int = REGION_RACKS) -> Tree:
    """region -> rack -> shard -> weight 1.0; shards fill racks and racks fill regions in order."""
    tree: Tree = {}
    for s in range(shards):
        rack = s // rack_shards
        tree.setdefault(rack // region_racks, {}).setdefault(rack, {})[s] = 1.0
    return tree


def grow(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region and a rack of its own."""
    region = max(tree, default=-1) + 1
    rack = max((r for racks in tree.values() for r in racks), default=-1) + 1
    return tree | {region: {rack: {shard: weight}}}


def _tables(tree: Tree) -> list[list[list[tuple[str, float, int]]]]:
    """For each level, by the node above: its children as (name, weight, place of the child's own children, or the shard)."""
    regions: list[tuple[str, float, int]] = []
    racks: list[list[tuple[str, float, int]]] = []
    shards: list[list[tuple[str, float, int]]] = []
    for region, inner in tree.items():
        own = []
        for rack, leaves in inner.items():
            found = [(str(shard), float(w), shard) for shard, w in leaves.items() if w > 0]
            if found:
                own.append((str(rack), sum(w for _, w, _ in found), len(shards)))
                shards.append(found)
        if own:
            regions.append((str(region), sum(w for _, w, _ in own), len(racks)))
            racks.append(own)
    if not regions:
        raise ValueError("the tree has no shard of positive weight")
    return [[regions], racks, shards]


def _entered(key: Column, children: Column) -> Column:
    """The child with the least weighted draw; ties, which have no weight, go to the first in order."""
    uniform = lambda c: (F.shiftrightunsigned(F.xxhash64(key, c["name"]), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    draws = F.transform(children, lambda c: F.struct((-F.log(uniform(c)) / c["weight"]).alias("draw"), c["child"].alias("child")))
    return F.array_min(draws)["child"]


def assign(df: DataFrame, key: str, tree: Tree, out: str = "shard", seed: int = 0) -> DataFrame:
    """Add ``out``: the shard reached by descending the levels.  Shards of weight 0 get nothing; a null key is a key like any other."""
    node: Column = F.lit(0)
    for level, nodes in zip(LEVELS, _tables(tree), strict=True):
        table = F.array(*[F.array(*[F.struct(F.lit(f"{seed}/{level}/{name}").alias("name"), F.lit(weight).alias("weight"), F.lit(child).alias("child")) for name, weight, child in children])
                          for children in nodes])
        df = df.withColumn(out, _entered(F.col(key), F.element_at(table, node + 1)))
        node = F.col(out)
    return df.withColumn(out, F.col(out).cast("int"))


def with_slots(df: DataFrame, key: str, shard: str = "shard", out: str = "slot", buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Add ``out``: positions 0, 1, 2, ... inside each shard, without gaps; all columns of ``df`` must be comparable.

    Rows of a shard are numbered by (hash bucket of the row, key, all other columns), so slots do not depend on how rows are
    partitioned.  Equal rows are one row with a count until they are numbered; rows of one key, or of none, are dealt to
    many buckets.  Only bucket counts are summed over a shard, so no task holds a shard.
    """
    columns = df.columns
    same = df.groupBy(*columns).agg(F.count("*").alias("_n")).withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int"))
    before = W.partitionBy(shard).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    heads = same.groupBy(shard, "_bucket").agg(F.sum("_n").alias("_sum")).select(
        shard, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    order = W.partitionBy(shard, "_bucket").orderBy(F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in columns if c != key])
    ranked = same.withColumn("_before", F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = ranked.join(heads, [shard, "_bucket"]).withColumn("_first", F.col("_base") + F.col("_before"))
    return placed.select(*columns, F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)).alias(out))


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 0, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row.

    ``law`` is ``key``: the shard depends on the key and the shard count alone.  ``grown_shard`` is the shard with
    one shard more.  ``size`` is the UTF-8 bytes of the text plus 1; a null text has size 1 and checksum 0.
    Equal keys share a shard, null keys too; their slots differ.  Columns named in ``carry`` come along; other columns are
    ignored; an empty table gives an empty result.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    light = docs.select(F.col(key).alias(key), (F.octet_length(whole) + 1).cast("long").alias("size"),
                        F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"), F.xxhash64(whole).alias("_text"), *carry)
    tree = uniform_tree(shards)
    placed = assign(light, key, tree, "shard", seed)
    placed = assign(placed, key, grow(tree, shards), "grown_shard", seed)
    return with_slots(placed, key).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard", *carry)
