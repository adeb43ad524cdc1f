"""N-gram Jaccard join with signature trees.

A document is its set of distinct k-word shingles.  Routing keys send documents that may link to common groups; in
every group a signature tree over the distinct sets finds the links:

* a leaf holds a few sets; a node holds the OR of its sets' token bitmaps and their range of sizes;
* two nodes are searched against each other only if some pair below them could reach the threshold: by the ranges of
  sizes, and by the most tokens that sets below both can share, which the bitmaps' common bits bound;
* pairs already in one class are passed over, so a group of near copies costs about one check per copy.

Links found inside a group are exact.  Routing keys are min-wise samples of ROWS shingles, BANDS of them: a pair at
similarity 0.8 misses all keys with probability (1 - 0.8**4)**48 < 2e-11, about that of a 64-bit hash collision in the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlens.llm.common import list_column, mix, shingle_sets
from memlens.llm.components import components
from memlens.session import cut

SHINGLE_WORDS = 5
THRESHOLD = (80, 100)
BANDS, ROWS = 48, 4
BITMAP_WORDS = 64
LEAF = 4
FANOUT = 4
TILE_SHINGLES = 4_000_000
_SEED = np.random.default_rng(7)
_FACTORS = (_SEED.integers(1, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_MASKS = _SEED.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)[:, None]
_BAND_MIX = _SEED.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def routing_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set, each from ROWS min-wise samples."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full((BANDS * ROWS, 1), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 2048):
        block = (short[None, at : at + 2048] ^ _MASKS) * _FACTORS
        np.minimum(least, block.min(axis=1, keepdims=True), out=least)
    return mix((least.reshape(BANDS, ROWS).astype(np.uint64) * _BAND_MIX).sum(axis=1, dtype=np.uint64))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, prints, keys = [], [], []
        for h in shingle_sets(batch.column(1), SHINGLE_WORDS):
            sizes.append(len(h))
            prints.append(int(mix(mix(h).sum(dtype=np.uint64).reshape(1)).view(np.int64)[0]))
            keys.append(routing_keys(h).view(np.int64) if len(h) else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), list_column(keys, pa.int64())],
                                         ["doc", "n_shingles", "print", "keys"])


class Classes:
    """Union-find over 0..n-1; the root is the smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


class Node:
    """OR of bitmaps, range of sizes, most bit collisions in one set; ``parts`` are nodes, or places of a leaf's sets."""

    __slots__ = ("bits", "low", "high", "spare", "parts", "leaf", "one")

    def __init__(self, bits, low, high, spare, parts, leaf):
        self.bits, self.low, self.high, self.spare, self.parts, self.leaf, self.one = bits, low, high, spare, parts, leaf, False

    def single(self, classes: Classes) -> bool:
        """Whether all sets below are in one class (once true, true for good)."""
        if not self.one:
            self.one = (len({classes.root(i) for i in self.parts}) == 1 if self.leaf
                        else all(p.single(classes) for p in self.parts) and len({classes.root(p.first()) for p in self.parts}) == 1)
        return self.one

    def first(self) -> int:
        return self.parts[0] if self.leaf else self.parts[0].first()


def _bitmap(h: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITMAP_WORDS * 64, bool)
    bits[(h & np.uint64(BITMAP_WORDS * 64 - 1)).astype(np.int64)] = True
    return np.packbits(bits).view(np.uint64)


def build_tree(sets: list[np.ndarray]) -> Node:
    """Leaves take sets that stand together by size and smallest shingle; FANOUT nodes make the next level's node."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]).bit_length(), int(sets[i][0]), len(sets[i])))
    level = []
    for at in range(0, len(order), LEAF):
        part = order[at : at + LEAF]
        maps = [_bitmap(sets[i]) for i in part]
        spare = max(len(sets[i]) - int(np.bitwise_count(m).sum()) for i, m in zip(part, maps, strict=True))
        level.append(Node(np.bitwise_or.reduce(maps), min(len(sets[i]) for i in part), max(len(sets[i]) for i in part), spare, part, True))
    while len(level) > 1:
        level = [Node(np.bitwise_or.reduce([p.bits for p in g]), min(p.low for p in g), max(p.high for p in g), max(p.spare for p in g), g, False)
                 for g in (level[at : at + FANOUT] for at in range(0, len(level), FANOUT))]
    return level[0]


def may_link(a: Node, b: Node, num: int, den: int) -> bool:
    """False only if no set below ``a`` reaches num/den with one below ``b``.

    Overlap i of sizes x, y needs i >= num/(num+den) * (x+y).  Shared tokens set common bits; at most the collisions
    of the poorer side share a bit with another token.
    """
    if a.high * den < b.low * num or b.high * den < a.low * num:
        return False
    most = min(a.high, b.high, int(np.bitwise_count(a.bits & b.bits).sum()) + min(a.spare, b.spare))
    return most * (num + den) >= num * (a.low + b.low)


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    x, y = len(a), len(b)
    if min(x, y) * den < max(x, y) * num:
        return False
    short, long = (a, b) if x <= y else (b, a)
    at = np.searchsorted(long, short)
    at[at == len(long)] = 0
    shared = int((long[at] == short).sum())
    return shared * den >= num * (x + y - shared)


def tree_join(sets: list[np.ndarray], num: int = THRESHOLD[0], den: int = THRESHOLD[1]) -> Classes:
    """Classes of sets linked at similarity >= num/den, by dual traversal of one signature tree with itself."""
    classes = Classes(len(sets))
    if len(sets) < 2:
        return classes
    root = build_tree(sets)
    todo = [(root, root)]
    while todo:
        a, b = todo.pop()
        if a.single(classes) and b.single(classes) and classes.root(a.first()) == classes.root(b.first()):
            continue
        if a is not b and not may_link(a, b, num, den):
            continue
        if a.leaf and b.leaf:
            for x, i in enumerate(a.parts):
                for j in a.parts[x + 1 :] if a is b else b.parts:
                    if classes.root(i) != classes.root(j) and similar(sets[i], sets[j], num, den):
                        classes.join(i, j)
        elif a is b:
            parts = a.parts
            todo += [(parts[x], parts[y]) for x in range(len(parts)) for y in range(x + 1, len(parts))]
            todo += [(p, p) for p in parts]  # popped first: classes inside a node before pairs across
        elif b.leaf or not a.leaf and a.high >= b.high:
            todo += [(p, b) for p in a.parts]
        else:
            todo += [(a, p) for p in b.parts]
    return classes


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, tile, doc, text) to (component, tile, doc, sorted shingle hashes)."""
    for batch in batches:
        rows = [h.view(np.int64) for h in shingle_sets(batch.column(3), SHINGLE_WORDS)]
        at = 0
        while at < len(rows):  # batches of at most about 16 MB
            end, size = at, 0
            while end < len(rows) and size < 2_000_000:
                size += len(rows[end])
                end += 1
            part = batch.slice(at, end - at)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), list_column(rows[at:end], pa.int64())], ["component", "tile", "doc", "hashes"])
            at = end


def _join_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (component, tile): one tree per group; gives (doc, smallest linked doc) inside the group."""
    key, docs, sets = None, [], []

    def finish() -> pa.RecordBatch:
        classes = tree_join(sets)
        best: dict[int, int] = {}
        for i, d in enumerate(docs):
            r = classes.root(i)
            best[r] = min(best.get(r, d), d)
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([best[classes.root(i)] for i in range(len(docs))], pa.int64())], ["u", "v"])

    for batch in batches:
        values, offsets = batch.column(3).flatten().to_numpy(), batch.column(3).offsets.to_numpy()
        offsets = offsets - offsets[0]
        for i, (c, t, d) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
            if (c, t) != key:
                if docs:
                    yield finish()
                key, docs, sets = (c, t), [], []
            docs.append(d)
            sets.append(np.array(values[offsets[i] : offsets[i + 1]].view(np.uint64)))
    if docs:
        yield finish()


def _linked(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) inside every (component, tile) group of ``members(doc, component, tile)``."""
    sets = members.join(texts, "doc").select("component", "tile", "doc", "text").mapInArrow(_sets, "component long, tile long, doc long, hashes array<long>")
    grouped = sets.repartition("component", "tile").sortWithinPartitions("component", "tile")
    return grouped.mapInArrow(_join_groups, "u long, v long")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row; see the module's text for the method.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased.  Sets link when 100 * intersection >= 80 * union; the
    component is the smallest key reachable by links.  Texts of under five words are one shingle; texts without words
    have none, and no links.  Rows with a null key have no component; rows with one key count as one node.

    Equal sets are one from the start: only one row of each gets routing keys.  A routing component whose sets exceed
    TILE_SHINGLES is searched in tiles: twice in random tiles, which joins what is alike in linear work; then only documents
    whose routing keys still span two classes meet again, in tiles pair by pair.
    """
    source = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    signed = cut(source.mapInArrow(_signatures, "doc long, n_shingles long, print long, keys array<long>"))
    known = signed.where("doc IS NOT NULL AND n_shingles > 0")
    firsts = cut(known.groupBy("n_shingles", "print").agg(F.min("doc").alias("first"), F.first("keys").alias("keys")))
    spread = firsts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "first")  # one row becomes BANDS
    keyed = spread.select(F.explode("keys").alias("key"), F.col("first").alias("doc"))
    hubs = keyed.groupBy("key").agg(F.min("doc").alias("hub"), F.max("doc").alias("last")).where("hub < last").drop("last")
    edges = keyed.join(hubs, "key").where("doc <> hub").select(F.col("doc").alias("u"), F.col("hub").alias("v")).distinct()
    routed = cut(components(edges))
    same = known.select("doc", "n_shingles", "print").join(firsts.drop("keys"), ["n_shingles", "print"]).select(F.col("doc").alias("u"), F.col("first").alias("v")).where("u <> v")
    placed = routed.join(firsts.drop("keys"), F.col("node") == F.col("first")).select("first", "component", "n_shingles")
    totals = placed.groupBy("component").agg(F.sum("n_shingles").alias("total"), F.count("*").alias("sets"))
    members = cut(placed.join(totals.where("sets > 1"), "component").select(
        F.col("first").alias("doc"), "component", F.ceil(F.col("total") / TILE_SHINGLES).alias("tiles")).distinct())
    texts = source.where("doc IS NOT NULL")
    links = cut(_linked(members.select("doc", "component", F.pmod(F.xxhash64("doc", F.lit(1)), "tiles").alias("tile")), texts).where("u <> v"))
    large = members.where("tiles > 1")
    if not large.isEmpty():
        links = _search_large(large, texts, keyed, links)
    found = components(same.unionAll(links))
    return signed.select(F.col("doc").alias(key), "n_shingles").join(found.withColumnRenamed("node", key), key, "left").select(
        key, "n_shingles", F.coalesce("component", key).alias("component_id"))


def _search_large(large: DataFrame, texts: DataFrame, keyed: DataFrame, links: DataFrame) -> DataFrame:
    again = _linked(large.select("doc", "component", F.pmod(F.xxhash64("doc", F.lit(2)), "tiles").alias("tile")), texts)
    links = cut(links.unionAll(again.where("u <> v")))
    classes = components(links)
    labelled = large.join(classes, large["doc"] == classes["node"], "left").select("doc", large["component"], "tiles", F.coalesce(classes["component"], "doc").alias("class"))
    by_key = keyed.join(labelled.select("doc", "class"), "doc")
    open_keys = by_key.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select("key")
    rest = labelled.join(by_key.join(open_keys, "key").select("doc").distinct(), "doc", "left_semi")
    tile = F.pmod(F.xxhash64("doc", F.lit(1)), "tiles")
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda o: F.least(o, tile) * F.col("tiles") + F.greatest(o, tile))
    pairs = rest.select("doc", "component", F.explode(others).alias("tile"))
    return cut(links.unionAll(_linked(pairs, texts).where("u <> v")))
