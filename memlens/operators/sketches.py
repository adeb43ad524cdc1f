"""Similar sets without pairs on the wire: sets that share one of their rarest tokens meet, sketches link them, whole sets decide.

Tokens have one order, from rare to common as counted in a bounded sample; any order is right, a good one is fast.  If two sets
reach the threshold, few of their tokens are not shared, so their first shared token stands among the first few of either: a set
is sent to the groups of those tokens only, once per group, with their positions and a sketch of the whole set.  A pair is
looked at if sizes and positions of a shared token leave room for the threshold.  A sketch has one bit per place, flipped by
every token that hashes there; two sketches differ in at most as many bits as their sets differ in tokens, so a pair whose
sketches differ more is none.  Nothing is lost.

A group gives no pairs but what its pairs link: a row per set at most.  Linked sets make clusters, which are small where texts are
unlike, and only inside a cluster whole sets are compared, each pair once.  So what travels grows with the sets, not with the pairs
that large groups of near copies make.  Groups are many enough to stay of one size; a token that very many sets ask for, and a
cluster of very many sets, are cut into parts, each pair of which is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlens.operators import postings as P
from memlens.operators.components import components
from memlens.session import cut

TILE_ROWS = 16_384
GROUP_TOKENS = 4_000_000  # tokens that sets bring to one group
SAMPLE_ROWS = 50_000
CROWD_ROWS = 10_000
RANKS = 1 << 20
CLUSTER_ROWS = 4096
PAIR_ROWS = 1024  # where pairs come out, a part of a cluster gives up to the square
FILTER_BITS = 1 << 23
CHUNK = 1 << 18  # pairs looked at together
PIECE = 1 << 19  # tokens put in order together
BITS_PER_MISS = 3  # bits per token that a pair may differ in: fewer would let unrelated sets through
LEAST_WORDS = 4
SLACK = 1e-6


def apart(sizes: np.ndarray | int, threshold: float) -> np.ndarray:
    """Most tokens that two sets whose sizes add up to ``sizes`` may differ in."""
    return np.floor((1 - threshold) / (1 + threshold) * sizes + SLACK).astype(np.int64)


def sketch_words(sizes: np.ndarray, threshold: float) -> np.ndarray:
    bits = np.maximum(BITS_PER_MISS * apart(2 * sizes.astype(np.int64), threshold), 64 * LEAST_WORDS)
    return (1 << np.ceil(np.log2(bits)).astype(np.int64)) >> 6


def _firsts(hashes: np.ndarray, sizes: np.ndarray, ranks: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, token, position) of the tokens among which a set's first shared one must be, in order of sets."""
    who = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((hashes, ranks[hashes & np.uint64(RANKS - 1)], who))
    position = np.arange(len(who)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = position < (sizes - np.ceil(threshold * sizes - SLACK).astype(np.int64) + 1)[who]
    return who[first], hashes[order][first], position[first]


def _sketches(hashes: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The words of all sketches, one behind the other."""
    start, places = (np.repeat(x, sizes) for x in (64 * (np.cumsum(words) - words), 64 * words))
    bits = np.bincount(start + (hashes % places.astype(np.uint64)).astype(np.int64), minlength=64 * words.sum()) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places start..start + length - 1 of each run, one behind the other."""
    return np.arange(length.sum()) + np.repeat(start - np.cumsum(length) + length, length)


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column("hashes")
    return lists.flatten().to_numpy().view(np.uint64), pc.list_value_length(lists).to_numpy().astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of sets with at most PIECE tokens, or of one set."""
    for batch in batches:
        ends, low = np.cumsum(_read(batch)[1]), 0
        while low < len(ends):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PIECE, "right")))
            yield batch.slice(low, high - low)
            low = high


def _first_tokens(ranks: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_firsts(*_read(batch), ranks, threshold)[1].view(np.int64))], ["tok"])

    return run


DEALT = "word bigint, a int, b int, side int, no binary, src binary, sz binary, held binary, tok binary, pos binary, sketch binary"


def _deal(ranks: np.ndarray, hot: dict[int, int], groups: int, threshold: float):
    """One row per batch of sets and group (or tile of a token in ``hot``, whose values are numbers of parts): columns as bytes of arrays."""
    crowded = np.array(sorted(hot), dtype=np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            no, src = batch.column("no").to_numpy(), batch.column("src").to_numpy().astype(np.int8)
            hashes, sizes = _read(batch)
            words = sketch_words(sizes, threshold)
            sketch, start = _sketches(hashes, sizes, words), np.cumsum(words) - words
            who, tok, pos = _firsts(hashes, sizes, ranks, threshold)
            pos = np.minimum(pos, 0xFFFF).astype(np.uint16)  # an earlier position only leaves more room
            out = []

            def row(word: int, a: int, b: int, side: int, at: np.ndarray) -> None:
                mine, held = np.unique(who[at], return_counts=True)
                arrays = (no[mine], src[mine], sizes[mine].astype(np.int32), held.astype(np.int32), tok[at], pos[at], sketch[_runs(start[mine], words[mine])])
                out.append((word, a, b, side, *[x.tobytes() for x in arrays]))

            many = np.isin(tok, crowded)
            group = np.where(many, groups, (tok % np.uint64(groups)).astype(np.int64))
            order = np.argsort(group, kind="stable")
            edges = np.searchsorted(group[order], np.arange(groups + 1))
            for g, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if high > low:
                    row(g, -1, -1, 0, order[low:high])
            part = no.view(np.uint64)[who] >> np.uint64(20)
            for word in np.unique(tok[many]):
                here, parts = np.flatnonzero(tok == word), hot[int(word.view(np.int64))]
                mine = (part[here] % np.uint64(parts)).astype(np.int64)
                for p in np.unique(mine):
                    for q in range(parts):
                        row(int(word.view(np.int64)), min(p, q), max(p, q), int(p > q), here[mine == p])
            yield pa.RecordBatch.from_pydict({f.name: [r[i] for r in out] for i, f in enumerate(_FIELDS)}, schema=_FIELDS)

    return run


_FIELDS = pa.schema([(name, {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[kind]) for name, kind in (c.split() for c in DEALT.split(", "))])


class _Near:
    """Whether sketches of pairs allow the threshold; the smaller set decides how long the compared sketches are."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, start: np.ndarray, sketch: np.ndarray, threshold: float) -> None:
        self.sizes, self.words, self.start, self.sketch, self.threshold = sizes, words, start, sketch, threshold
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _of(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Sketches of ``w`` words; place i of a shorter sketch is place i + k * size of the longer one."""
        if w not in self.folded:
            longest = sketch_words(np.array([int(self.sizes[self.words == w].max() / self.threshold) + 1]), self.threshold)[0]
            at, some, n = np.full(len(self.words), -1), [], 0
            for v in np.unique(self.words[(self.words >= w) & (self.words <= longest)]):
                rows = np.flatnonzero(self.words == v)
                at[rows] = n + np.arange(len(rows))
                n += len(rows)
                some.append(np.bitwise_xor.reduce(self.sketch[_runs(self.start[rows], self.words[rows])].reshape(len(rows), v // w, w), axis=1))
            self.folded[w] = np.concatenate(some), at
        return self.folded[w]

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for w in np.unique(self.words[x]):
            rows = np.flatnonzero(self.words[x] == w)
            bits, at = self._of(int(w))
            step = max(1, 4 * CHUNK // int(w))
            for low in range(0, len(rows), step):
                some = rows[low:low + step]
                differ = np.bitwise_count(bits[at[x[some]]] ^ bits[at[y[some]]]).sum(axis=1, dtype=np.int64)
                out[some] = differ <= apart(self.sizes[x[some]] + self.sizes[y[some]], self.threshold)
        return out


def _join(link: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Lets ``link``, the least set that each is joined with so far, know of more pairs."""
    while len(x := x[open_ := link[x] != link[y]]):
        y = y[open_]
        np.minimum.at(link, np.maximum(link[x], link[y]), np.minimum(link[x], link[y]))
        while np.any((further := link[link]) != link):
            link[:] = further


def _meet(threshold: float, same: bool):
    """Links between sets of one group, or of one tile of a token: whatever their pairs join whose sketches allow the threshold."""

    def run(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
        column = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in tile[name]])
        no, src, sz, held = column("no", np.int64), column("src", np.int8), column("sz", np.int32).astype(np.int64), column("held", np.int32)
        tok, pos, sketch = column("tok", np.uint64), column("pos", np.uint16), column("sketch", np.uint64)
        side = np.repeat(tile["side"].to_numpy(), [len(x) // 8 for x in tile["no"]])
        # copies of a set are one; sets in order of size
        order = np.lexsort((no, src, sz))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(no[order]) != 0) | (np.diff(src[order]) != 0) | (np.diff(sz[order]) != 0)
        sets = order[new]
        place = np.full(len(no), -1)
        place[sets] = np.arange(len(sets))
        words = sketch_words(sz, threshold)
        near = _Near(sz[sets], words[sets], (np.cumsum(words) - words)[sets], sketch, threshold)
        at = np.repeat(place.astype(np.int32), held)
        tok, pos, at = tok[at >= 0], pos[at >= 0], at[at >= 0]
        no, src, sz, side = no[sets], src[sets], sz[sets], side[sets]
        order = np.lexsort((at, tok))
        tok, pos, at = tok[order], pos[order], at[order]
        del order
        link = np.arange(len(sets))

        def walk(token: np.ndarray, at: np.ndarray, pos: np.ndarray) -> None:
            """Links the sets of some tokens, each with all its sets."""
            n = sz[at]
            # the larger set of a pair ends where the rest of the smaller one, all of it shared, would be too little
            reach = np.floor(np.minimum(n, (n - pos) * (1 + threshold) - n * threshold) / threshold + SLACK).astype(np.int64)
            many = np.maximum(np.searchsorted(token | n, token | np.maximum(reach, 0), "right") - np.arange(len(n)) - 1, 0)
            before, low = np.concatenate([[0], np.cumsum(many)]), 0
            while low < len(n):
                high = max(low + 1, int(np.searchsorted(before, before[low] + CHUNK, "right")) - 1)
                l, some = np.arange(low, high), many[low:high].copy()
                last = l + some
                # nothing to look for where a set and all those behind it are linked already
                linked = link[at[low:last.max() + 1]]
                turns = np.append(np.flatnonzero(np.diff(linked)), len(linked))
                some[turns[np.searchsorted(turns, l - low)] >= last - low] = 0
                l, r = np.repeat(l, some), _runs(l + 1, some)
                low = high
                both, misses = n[l] + n[r], apart(n[l] + n[r], threshold)
                fits = (pos[l] + pos[r] <= misses) & (2 * np.minimum(n[l] - pos[l], n[r] - pos[r]) >= both - misses)
                x, y = at[l[fits]], at[r[fits]]
                other = link[x] != link[y]
                if not same:
                    other &= src[x] != src[y]
                if key[1] != key[2]:
                    other &= side[x] != side[y]
                x, y = x[other], y[other]
                allowed = near(x, y)
                _join(link, x[allowed], y[allowed])

        starts, low = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])), 0
        while low < len(tok):
            high = np.append(starts, len(tok))[np.searchsorted(starts, min(low + PIECE, len(tok)))]
            walk(np.cumsum(np.concatenate([[0], np.diff(tok[low:high]) != 0])) << 32, at[low:high], pos[low:high].astype(np.int64))
            low = high
        more = np.flatnonzero(link != np.arange(len(link)))
        return pd.DataFrame({"u": no[more], "v": no[link[more]]})

    return run


def _ranks(sample: DataFrame) -> np.ndarray:
    """How common tokens are in a sample, by RANKS hashed places, on a scale of 256 steps."""
    counts = sample.select(F.explode("hashes").alias("h")).groupBy(F.pmod("h", F.lit(RANKS)).cast("int").alias("place")).agg(F.count("*").alias("n")).toArrow()
    out = np.zeros(RANKS, np.uint8)
    out[counts["place"].to_numpy()] = np.minimum(np.round(12 * np.log2(1 + counts["n"].to_numpy())), 255)
    return out


def numbered(left: DataFrame, right: DataFrame | None, *more: str) -> DataFrame:
    """(no, src, tokens, ``more``) of sets with tokens.  Two ids of one number, should there be such, are only compared more often."""
    of = lambda d, src: d.where(F.size("tokens") > 0).select(F.xxhash64("set_id", F.lit(src)).alias("no"), F.lit(src).alias("src"), "tokens", *more)
    return of(left, 0) if right is None else of(left, 0).unionByName(of(right, 1))


def allowed_pairs(left: DataFrame, right: DataFrame, threshold: float, same: bool) -> DataFrame:
    """(u, v): numbers of sets, linked so that both of every pair of ``(set_id, tokens)`` that may reach the threshold hang together.

    With ``same`` pairs are inside ``left``, else between the two.  Equal ids are one set; empty sets have no pairs.  Both tables
    are read more than once.
    """
    rows = numbered(left, None if same else right).select("no", "src", F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"))
    size = F.size("hashes")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(size - F.ceil(size * threshold - SLACK) + 1), F.lit(0)).alias("tokens")).first()
    each, at = max(1, total["n"] // SAMPLE_ROWS), F.xxhash64("no")
    sample = cut(rows.where(F.pmod(at, F.lit(each)) == 0))
    ranks, hot = _ranks(sample), {}
    if total["n"] > TILE_ROWS:
        stands_for = max(1, total["n"] // CROWD_ROWS // each) * each
        some = sample.where(F.pmod(at, F.lit(stands_for)) == 0).mapInArrow(_first_tokens(ranks, threshold), "tok bigint")
        crowds = some.groupBy("tok").agg((F.count("*") * stands_for).alias("n")).where(F.col("n") > TILE_ROWS)
        hot = {r["tok"]: int(-(-r["n"] // TILE_ROWS)) for r in crowds.collect()}
    groups = max(rows.sparkSession.sparkContext.defaultParallelism, -(-int(total["tokens"]) // GROUP_TOKENS))
    here = ["word", "a", "b"]
    dealt = rows.mapInArrow(_deal(ranks, hot, groups, threshold), DEALT)
    return dealt.repartition(4 * groups, *here).groupBy(*here).applyInPandas(_meet(threshold, same), "u bigint, v bigint").distinct()


def _compare(threshold: float, same: bool, hits: bool):
    """Whole sets of one group of clusters, or of one tile of a cluster, with each other."""

    def run(key: tuple, tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks()
        cluster, src, side, copies = (tile[c].to_numpy() for c in ("cluster", "src", "side", "copies"))
        lists = tile["tokens"].chunk(0)
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        encoded = lists.flatten().dictionary_encode()
        codes, mark = encoded.indices.to_numpy(), np.zeros(len(encoded.dictionary), np.int32)
        order = np.lexsort((sizes, cluster))
        codes = codes[_runs((np.cumsum(sizes) - sizes)[order], sizes[order])]
        cluster, src, side, copies, sizes = cluster[order], src[order], side[order], copies[order], sizes[order]
        start = np.concatenate([[0], np.cumsum(sizes)])
        rank = np.cumsum(np.concatenate([[0], np.diff(cluster) != 0])) << 32
        stop = np.searchsorted(rank | sizes, rank | np.floor(sizes / threshold + SLACK).astype(np.int64), "right")
        near, found = np.zeros(len(sizes), np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i in np.flatnonzero(stop > np.arange(len(sizes)) + 1):
            mine, others = codes[start[i]:start[i + 1]], slice(i + 1, stop[i])
            mark[mine] = 1
            both = np.add.reduceat(mark[codes[start[i + 1]:start[stop[i]]]], start[others] - start[i + 1])
            mark[mine] = 0
            similarity = both / (sizes[i] + sizes[others] - both)
            ok = similarity >= threshold - 1e-12
            if not same:
                ok &= src[others] != src[i]
            if key[1] != key[2]:
                ok &= side[others] != side[i]
            j = np.flatnonzero(ok) + i + 1
            if hits:
                near[i] += copies[j].sum()
                near[j] += copies[i]
            elif len(j):
                found.append((np.full(len(j), i), j, similarity[ok]))
        ids = tile["set_id"].take(pa.array(order))
        if hits:
            some = np.flatnonzero(near)
            return pa.table({"set_id": ids.take(pa.array(some)), "near": near[some]})
        l, r, similarity = (np.concatenate(x) for x in zip(*found, strict=True))
        swap = src[l] > src[r]
        l, r = np.where(swap, r, l), np.where(swap, l, r)
        return pa.table({"l_set": ids.take(pa.array(l)), "r_set": ids.take(pa.array(r)), "similarity": similarity})

    return run


def _held(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rows of sets in clusters with these.  Where the clusters are too many to be sent to all tasks, most other rows are left out by bits before rows travel."""
    if clusters.count() > P.FEW_ROWS:
        places = clusters.select(F.pmod("no", F.lit(FILTER_BITS)).cast("int").alias("place")).distinct().toArrow()["place"].to_numpy()
        held = np.zeros(FILTER_BITS, np.uint8)
        held[places] = 1
        bits = np.packbits(held)

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = np.unpackbits(bits).astype(bool)
            for batch in batches:
                yield batch.filter(pa.array(known[batch.column("no").to_numpy() % FILTER_BITS]))

        rows = rows.mapInArrow(some, rows.schema)
    return rows.join(P.few(clusters), "no")


def similar(left: DataFrame, right: DataFrame, threshold: float, same: bool, hits: bool = False) -> DataFrame:
    """(l_set, r_set, similarity) of the pairs of distinct sets at or above the threshold (> 0); with ``hits`` (set_id, near) instead:
    how many rows have a set similar to it, in one row or in several that add up, where there are any.
    """
    found = cut(components(allowed_pairs(left, right, threshold, same)))
    most = CLUSTER_ROWS if hits else min(CLUSTER_ROWS, PAIR_ROWS)
    parts = found.groupBy("component").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    clusters = cut(found.join(parts, "component").select(F.col("node").alias("no"), F.col("component").alias("cluster"), "parts"))
    held = _held(numbered(left, None if same else right, "set_id"), clusters)
    sets = held.groupBy("set_id", "src", "no", "cluster", "parts").agg(F.first("tokens").alias("tokens"), F.count("*").alias("copies"))
    groups = max(left.sparkSession.sparkContext.defaultParallelism, -(-clusters.count() // most))
    place = lambda word, a, b, side: F.struct(word.cast("bigint").alias("word"), a.cast("int").alias("a"), b.cast("int").alias("b"), side.cast("int").alias("side"))
    mine = F.pmod(F.xxhash64("no"), F.col("parts"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: place(F.col("cluster"), F.least(mine, q), F.greatest(mine, q), mine > q))
    one = F.array(place(F.pmod(F.xxhash64("cluster"), F.lit(groups)), F.lit(-1), F.lit(-1), F.lit(0)))
    dealt = sets.select("set_id", "src", "cluster", "copies", "tokens", F.explode(F.when(F.col("parts") == 1, one).otherwise(tiles)).alias("t")).select("*", "t.*").drop("t")
    here = ["word", "a", "b"]
    out = "set_id string, near bigint" if hits else "l_set string, r_set string, similarity double"
    return dealt.repartition(4 * groups, *here).groupBy(*here).applyInArrow(_compare(threshold, same, hits), out)
