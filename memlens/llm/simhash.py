"""SimHash near-duplicates with an index of deletion variants.

A document's fingerprint has 64 bits; two documents link when at most DISTANCE bits differ.  The fingerprint is cut into
SEGMENTS = 3 segments, so few that of four differing bits one segment gets at most one.  Every segment is indexed
with each of its bits wildcarded in turn (64 variants); segments that differ in at most one bit have a variant in common,
so linked fingerprints meet by an equality join, and the join's condition verifies all 64 bits.

Only classes are asked for, so pairs inside a dense group are never listed:

* equal fingerprints are one row before anything is indexed;
* a bucket is searched in one task and yields a spanning forest of its links, not its pairs;
* crowded buckets, known from the counts of whole segment values, go another way: they link their members to their smallest
  and largest one, which is linear, and where several classes are left, members outside the bucket's largest class are
  joined with all others, and links leave the join as distinct pairs of classes.  Every pair of linked fingerprints in
  different classes has a member outside the largest class of each bucket they share, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlens.llm.common import joined_words, text_slices, word_hashes
from memlens.llm.components import components
from memlens.session import cut

SHINGLE_WORDS = 4
SEED = 42
DISTANCE = 4
SEGMENTS = 3
PIECE = 1 << 16
CROWD = 4096


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed long."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PIECE):
        bits = np.unpackbits(hashes[at : at + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    for batch in batches:
        for first, data, offsets in text_slices(batch.column(0)):
            data = lower[data]
            _, start, stop, at = word_hashes(data, offsets, fold=False)
            buffer, upto = joined_words(data, start, stop)
            begin, end = upto[:-1].tolist(), (upto[1:] - 1).tolist()
            out = []
            for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                k = min(SHINGLE_WORDS, y - x)
                shingles = (xxhash.xxh64_intdigest(buffer[i:j], SEED) for i, j in zip(begin[x : y - k + 1], end[x + k - 1 : y], strict=True)) if k else ()
                out.append(_majority(np.fromiter(shingles, np.uint64)))
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, len(out)), pa.array(out, pa.int64())], ["row", "print"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, print) of every row.  Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a bit is 1 if set in over half of the
    XXH64 values of the text's 4-word shingles, repeats included (fewer words: the whole sequence; none: print 0)."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(text).alias("text"), F.struct(F.col(key).alias("key")).alias("row"))
    return rows.mapInArrow(_fingerprints, f"row struct<key:{kind}>, print long").select(F.col("row.key").alias(key), "print")


def _segments(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    edges = [round(64 * i / segments) for i in range(segments + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variant_masks(segments: int = SEGMENTS) -> list[int]:
    """Masks (signed longs) that keep one segment without one of its bits."""
    return [_signed(((1 << b) - (1 << a)) & ~(1 << j)) for a, b in _segments(segments) for j in range(a, b)]


def _differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _buckets(value: str, masks: list[int], first: int = 0) -> Column:
    """One bucket per mask.  A clash of buckets costs a comparison, no more."""
    kept = [F.xxhash64(F.lit(first + i), F.col(value).bitwiseAND(F.lit(m))) for i, m in enumerate(masks)]
    return F.explode(F.array(*kept)).alias("bucket")


def forest(buckets: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that span the classes inside each bucket: places at one distance in bucket order are compared at a time."""
    order = np.lexsort((prints, buckets))
    buckets, prints = buckets[order], prints[order]
    bits = prints.view(np.uint64)
    n = len(buckets)
    head = np.concatenate(([True], buckets[1:] != buckets[:-1]))
    starts = np.flatnonzero(head)
    end = np.concatenate((starts[1:], [n]))[np.cumsum(head) - 1]
    start = starts[np.cumsum(head) - 1]
    close = np.bitwise_count(bits ^ bits[start]) <= distance
    label = np.where(close, start, np.arange(n))
    alive, lag = np.arange(n), 1
    while len(alive):
        alive = alive[end[alive] > alive + lag]
        pairs = alive[label[alive] != label[alive + lag]]
        pairs = pairs[np.bitwise_count(bits[pairs] ^ bits[pairs + lag]) <= distance]
        for i in pairs.tolist():
            a, b = label[i], label[i + lag]
            if a != b:
                own = label[start[i] : end[i]]
                own[own == max(a, b)] = min(a, b)
        lag += 1
    joined = np.flatnonzero(label != np.arange(n))
    return prints[joined], prints[label[joined]]


def _forests(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            links = np.unique(np.stack(forest(*(np.concatenate(x) for x in zip(*parts, strict=True)), distance), 1), axis=0)
            for at in range(0, len(links), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(links[at : at + 50_000, k]) for k in range(2)], ["u", "v"])

    return run


def crowded_buckets(prints: DataFrame, crowd: int) -> DataFrame:
    """Buckets that may hold ``crowd`` fingerprints: a bucket is two segment values, so one of them has half of its members."""
    cuts = [_signed((1 << b) - (1 << a)) for a, b in _segments()]
    values = prints.select(F.posexplode(F.array(*[F.col("print").bitwiseAND(F.lit(m)) for m in cuts])).alias("segment", "value"))
    many = cut(values.groupBy("segment", "value").agg(F.count("*").alias("n")).where(F.col("n") >= crowd // 2))
    masks, first, parts = variant_masks(), 0, []
    for i, (a, b) in enumerate(_segments()):
        parts.append(many.where(F.col("segment") == i).select(_buckets("value", masks[first : first + b - a], first)))
        first += b - a
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out.distinct()


def _crowded_links(index: DataFrame, distance: int) -> DataFrame:
    """Links that join the classes inside buckets of any size."""
    ends = index.groupBy("bucket").agg(F.min("print").alias("low"), F.max("print").alias("high")).where("low <> high")
    shared = cut(index.join(ends, "bucket"))
    near = lambda end: shared.where((_differing("print", end) <= distance) & (F.col("print") != F.col(end))).select(F.col("print").alias("u"), F.col(end).alias("v"))
    links = cut(near("low").unionAll(near("high")).distinct())
    classed = shared.select("bucket", "print").join(components(links).withColumnRenamed("node", "print"), "print", "left").select(
        "bucket", "print", F.coalesce("component", "print").alias("class"))
    sizes = classed.groupBy("bucket", "class").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max_by("class", F.struct("n", "class")).alias("largest"), F.count("*").alias("classes"))
    open_ = cut(classed.join(largest.where("classes > 1").drop("classes"), "bucket"))
    other = open_.where(F.col("class") != F.col("largest")).select("bucket", F.col("print").alias("print2"), F.col("class").alias("class2"))
    verified = open_.join(other, "bucket").where((F.col("class") != F.col("class2")) & (_differing("print", "print2") <= distance))
    return links.unionAll(verified.select(F.greatest("class", "class2").alias("u"), F.least("class", "class2").alias("v")).distinct())


def link_classes(prints: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """(print, class) of every distinct fingerprint in ``prints(print)``; the class is its smallest fingerprint reachable by links."""
    if distance // SEGMENTS > 1:
        raise ValueError(f"{SEGMENTS} segments of one wildcard find distances up to {2 * SEGMENTS - 1}")
    prints = cut(prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "print"))  # one row becomes 64
    index = prints.select(_buckets("print", variant_masks()), "print")
    crowds = cut(crowded_buckets(prints, crowd))
    crowded = not crowds.isEmpty()
    rest = index.join(crowds, "bucket", "left_anti") if crowded else index
    links = rest.repartition("bucket").mapInArrow(_forests(distance), "u long, v long")
    if crowded:
        links = links.unionAll(_crowded_links(index.join(crowds, "bucket", "left_semi"), distance))
    classes = components(links).withColumnRenamed("node", "print")
    return prints.join(classes, "print", "left").select("print", F.coalesce("component", "print").alias("class"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) of every row: 16 lowercase hex digits, and the smallest key reachable over links.

    Texts without words have fingerprint zero and are linked like any other.  Rows with a null key get their fingerprint, but
    take part in no link and have a null component; rows with one key count as one node for the smallest key, so a key whose
    rows have different texts may show two components.  Other columns are ignored; an empty table gives an empty result.
    """
    signed = cut(fingerprints(docs, key, text))
    heads = signed.where(F.col(key).isNotNull()).groupBy("print").agg(F.min(key).alias("least"))
    heads = heads.join(link_classes(heads.select("print")), "print")
    smallest = heads.groupBy("class").agg(F.min("least").alias("component_id"))
    named = heads.join(smallest, "class").select("print", "component_id")
    out = signed.join(named, "print", "left")
    return out.select(key, F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.when(F.col(key).isNotNull(), F.col("component_id")).alias("component_id"))
