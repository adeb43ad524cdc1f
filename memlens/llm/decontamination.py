"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

A copy of an item scores ``needed_score`` or more at +1 for a match and -1 for an edited, inserted or missing word.  Such an
alignment with M matches and E errors has at most E + 1 runs of matches, so at least M - E - 1 >= needed - 1 of the item's
neighbouring word pairs stand in the copy.  Of any n - needed + 1 of the item's n - 1 pairs one survives: the item's
rarest ones in the corpus are its seeds, and no copy is lost, whatever its edits.

1. One scan counts the items' word pairs in all documents; each item keeps its n - needed + 1 rarest as seeds.
2. Bit filters over the seeds and over all pairs go to every task, one of each per length class of items.  A second scan keeps,
   around the places that pass a seed filter, windows of words wide enough for the class's items, if as many pairs near the
   place pass the other filter as the class's shortest copy has.
3. Equal windows are one candidate.  Seeds join distinct windows to items by an ordinary shuffle join.
4. Each distinct (window, item) that shares needed - 1 pairs is aligned once, word by word, and the documents that hold the
   window join its result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlens.llm.common import NOT_ALNUM, list_column, text_slices, window_hashes, word_hashes
from memlens.session import cut

SEED_WORDS = 2
MIN_ITEM_WORDS = 4
LEAST_FILTER_BITS, MOST_FILTER_BITS = 1 << 16, 1 << 26
MIN_SHARE = 0.5
MIN_WORDS = 8
EXCERPT_WORDS = 30


def needed_score(item_words: int) -> int:
    """Least score of a copy: half of the item's words, and MIN_WORDS of them where it has so many; an excerpt of EXCERPT_WORDS is one of any item."""
    return min(max(int(np.ceil(MIN_SHARE * item_words)), min(item_words, MIN_WORDS), 1), EXCERPT_WORDS)


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, pair hashes) of each text; words are runs of letters, digits and non-ASCII characters, case folded."""
    for _, data, offsets in text_slices(column):
        words, _, _, at = word_hashes(data, offsets, True, NOT_ALNUM)
        seeds = window_hashes(words, SEED_WORDS)
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield words[i:j], seeds[i : max(i, j - SEED_WORDS + 1)]


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with their length class (bits of the word count), the pairs in order and how many of them are seeds."""
    for batch in batches:
        words, seeds, sizes, lengths = [], [], [], []
        for w, s in _texts(batch.column(1)):
            words.append(w.view(np.int64))
            seeds.append(s.view(np.int64))
            sizes.append(len(w).bit_length())
            lengths.append(len(w) - needed_score(len(w)) + 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), list_column(words, pa.int64()), list_column(seeds, pa.int64()), pa.array(sizes, pa.int32()), pa.array(lengths, pa.int32())],
                                         ["item", "item_words", "pairs", "size", "n_seeds"])


def _slots(seeds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (seeds & np.uint64(bits - 1)).astype(np.int64), ((seeds >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def seed_filters(seeds: DataFrame) -> dict[int, np.ndarray]:
    """For each length class in ``seeds(size, seed)`` the bits of its seeds, two per seed, as packed bytes.

    A filter has 16 bits a seed or more, MOST_FILTER_BITS at most; the driver gets a 64th of these as rows.  A fuller filter
    passes more places, which costs time and loses nothing.
    """
    counts = {r["size"]: r["n"] for r in seeds.groupBy("size").agg(F.count("*").alias("n")).collect()}
    bits = {c: min(max(LEAST_FILTER_BITS, 1 << (16 * n - 1).bit_length()), MOST_FILTER_BITS) for c, n in counts.items()}
    if not bits:
        return {}
    mask = F.lit(0)
    for c, n in bits.items():
        mask = F.when(F.col("size") == c, n - 1).otherwise(mask)
    bit = F.explode(F.array(F.col("seed").bitwiseAND(mask), F.shiftrightunsigned("seed", 32).bitwiseAND(mask)))
    words = seeds.select("size", bit.alias("bit")).groupBy("size", F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = {}
    for c, n in bits.items():
        own = words["size"].to_numpy() == c
        packed = np.zeros(n // 64, np.int64)
        packed[words["word"].to_numpy()[own]] = words["bits"].to_numpy()[own]
        out[c] = packed.view(np.uint8)
    return out


def _passing(filters: dict[int, np.ndarray]):
    """Per length class a function that tells which hashes pass."""
    tables = {c: np.unpackbits(p, bitorder="little").view(bool) for c, p in filters.items()}

    def passes(c: int, seeds: np.ndarray) -> np.ndarray:
        one, two = _slots(seeds, len(tables[c]))
        return np.flatnonzero(tables[c][one] & tables[c][two])

    return passes


def _count(filters: dict[int, np.ndarray]):
    """How often the pairs that pass a filter occur in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = _passing(filters)
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0)):
                words, _, _, at = word_hashes(data, offsets, True, NOT_ALNUM)
                seeds = window_hashes(words, SEED_WORDS)
                own = np.ones(len(seeds), bool)
                ends = at[1:] - 1
                own[ends[(ends >= 0) & (ends < len(seeds))]] = False  # the pair of a text's last word and the next text's first
                seeds = seeds[own]
                found, n = np.unique(seeds[passes(0, seeds)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["seed", "n"])

    return run


def _scan(seed_bits: dict[int, np.ndarray], pair_bits: dict[int, np.ndarray], reach: dict[int, tuple[int, int]]):
    """Windows of words around the seeds that pass a class's filter; seeds too far apart for one copy open a new window.

    ``reach``: by class, the most words that a copy spans and the least pairs that it holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_seed, is_pair = _passing(seed_bits), _passing(pair_bits)
        for batch in batches:
            rows: list[int] = []
            sizes: list[int] = []
            starts: list[int] = []
            prints: list[bytes] = []
            words, seeds = [], []
            for row, (w, s) in enumerate(_texts(batch.column(1))):
                if not len(s):
                    continue
                for c, (far, least) in reach.items():
                    hit = is_seed(c, s)
                    if len(hit) and least > 1:
                        pairs = np.zeros(len(s) + 1, np.int64)
                        pairs[is_pair(c, s) + 1] = 1
                        np.cumsum(pairs, out=pairs)
                        hit = hit[pairs[np.minimum(hit + far, len(s))] - pairs[np.maximum(hit - far, 0)] >= least]
                    if not len(hit):
                        continue
                    for part in np.split(hit, np.flatnonzero(np.diff(hit) > far) + 1):
                        low, high = max(0, int(part[0]) - far), min(len(w), int(part[-1]) + SEED_WORDS + far)
                        rows.append(row)
                        sizes.append(c)
                        starts.append(low)
                        prints.append(hashlib.blake2b(w[low:high].tobytes(), digest_size=16).digest())
                        words.append(w[low:high].view(np.int64))
                        seeds.append(np.unique(s[part]).view(np.int64))
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int32()), pa.array(starts, pa.int64()), pa.array(prints, pa.binary()), list_column(words, pa.int64()), list_column(seeds, pa.int64())],
                                             ["doc", "size", "start", "window", "words", "seeds"])

    return run


def best_alignment(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two sequences (match +1, mismatch -1, gap -1): (score, end in a, end in b).

    Row by row over the shorter sequence; gaps along a row are a running maximum.  Ties: the earliest row, then place.
    """
    if len(a) < len(b):
        score, end_b, end_a = best_alignment(b, a)
        return score, end_a, end_b
    place = np.arange(len(a))
    row = np.zeros(len(a) + 1, np.int64)
    best = (0, 0, 0)
    for j, value in enumerate(b):
        cell = np.maximum(row[:-1] + np.where(a == value, 1, -1), np.maximum(row[1:] - 1, 0))
        cell = np.maximum.accumulate(cell + place) - place
        row[1:] = cell
        top = int(cell.argmax())
        if cell[top] > best[0]:
            best = (int(cell[top]), top + 1, j + 1)
    return best


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(score, first word, end word) of the best alignment in ``a``."""
    score, end_a, end_b = best_alignment(a, b)
    if not score:
        return 0, 0, 0
    _, length, _ = best_alignment(a[:end_a][::-1], b[:end_b][::-1])
    return score, end_a - length, end_a


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(1), batch.column(3)
        rows: list[int] = []
        out = []
        for i in range(batch.num_rows):
            a, b = left[i].values.to_numpy(), right[i].values.to_numpy()
            needed = needed_score(len(b))
            # a copy holds needed of the item's words and needed - 1 of its pairs
            if np.isin(b, a).sum() < needed or np.isin(window_hashes(b.view(np.uint64), SEED_WORDS), window_hashes(a.view(np.uint64), SEED_WORDS)).sum() < needed - 1 or best_alignment(a, b)[0] < needed:
                continue
            score, first, end = align(a, b)
            rows.append(i)
            out.append((score, len(b), first, end))
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at)] + [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)],
                                         ["window", "item", "score", "item_len", "first", "end"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Copies of test items in documents: (key, item_key, score, item_words, share, first_word, end_word).

    One row per document and item whose best alignment scores at least ``needed_score``; ``share`` is score over the item's
    words, and [first_word, end_word) the place in the document's words.  Items of under MIN_ITEM_WORDS words, empty and null
    texts match nothing.  Rows with a null id are left out; repeated ids count as one document or item, the best row wins.
    Other columns are ignored; empty tables give an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()
    items = cut(benchmark.where(F.col(item_key).isNotNull()).select(F.col(item_key).cast("long").alias("item"), F.col(item_text).alias("text"))
                .mapInArrow(_items, "item long, item_words array<long>, pairs array<long>, size int, n_seeds int").where(F.size("item_words") >= MIN_ITEM_WORDS))
    source = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("text"))
    pairs = items.select("item", "size", "n_seeds", "item_words", F.posexplode("pairs").alias("place", "seed"))
    everything = seed_filters(pairs.select(F.lit(0).alias("size"), "seed").distinct())
    if everything:
        counts = source.select("text").mapInArrow(_count(everything), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
        pairs = pairs.join(counts, "seed", "left")
    else:
        pairs = pairs.withColumn("n", F.lit(0))
    rarest = W.partitionBy("item", F.xxhash64("item_words")).orderBy(F.coalesce("n", F.lit(0)), "seed", "place")
    seeds = cut(pairs.withColumn("rank", F.row_number().over(rarest)).where("rank <= n_seeds").select("item", "size", "seed").distinct())
    # a copy of n words spans up to n + (n - needed) words and holds needed - 1 pairs; n_seeds = n - needed + 1
    n = F.size("item_words")
    reach = {r["size"]: (r["far"], r["least"]) for r in items.groupBy("size").agg(F.max(n + F.col("n_seeds")).alias("far"), F.min(n - F.col("n_seeds")).alias("least")).collect()}
    scan = _scan(seed_filters(seeds.select("size", "seed").distinct()), seed_filters(items.select("size", F.explode("pairs").alias("seed")).distinct()), reach)
    windows = cut(source.mapInArrow(scan, f"doc {kind}, size int, start long, window binary, words array<long>, seeds array<long>"))
    kinds = cut(windows.select("window", "size", "words", "seeds").dropDuplicates(["window", "size"]))
    met = kinds.select("window", "size", F.explode("seeds").alias("seed")).join(seeds, ["size", "seed"]).select("window", "size", "item").distinct()
    scored = (met.join(kinds, ["window", "size"]).join(items.select("item", "item_words", "size"), ["item", "size"]).select("window", "words", "item", "item_words")
              .mapInArrow(_scores, "window binary, item long, score long, item_len long, first long, end long").distinct())
    aligned = scored.join(windows.select("window", "doc", "start").distinct(), "window").select(
        "doc", "item", "score", "item_len", (F.col("start") + F.col("first")).alias("first_word"), (F.col("start") + F.col("end")).alias("end_word"))
    best = aligned.groupBy("doc", "item").agg(F.max(F.struct("score", (-F.col("first_word")).alias("neg"), "item_len", "end_word")).alias("b"))
    return best.select(F.col("doc").alias(key), F.col("item").alias(item_key), F.col("b.score").alias("score"), F.col("b.item_len").alias("item_words"),
                       F.round(F.col("b.score") / F.col("b.item_len"), 6).alias("share"), (-F.col("b.neg")).alias("first_word"), F.col("b.end_word").alias("end_word"))
