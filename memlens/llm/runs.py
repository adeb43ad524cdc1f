"""Runs of repeating words, found with a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q whose length is at least MIN_PERIODS * q (and MIN_LENGTH)
and which no neighbouring word extends keeping that period.

* Level k of the dictionary names every stretch of 2**k words that occurs twice in its text: equal stretches, equal
  names.  A name of level k + 1 is the pair of names of its halves.  Places whose stretch occurs once get no name and drop
  out of all higher levels, so ordinary prose leaves few places after two or three levels.
* The next occurrence of a named stretch, where it lies within twice its length, proposes its distance as a period.
  Successors at one distance form arithmetic progressions; neighbouring places with one distance are one proposal.
* A proposal is extended to both sides by descending the levels: two places are compared stretch by stretch.
* What several levels propose is one run: (start, period) decides.

Why nothing is lost: take a run of period q and the level with q <= 2**k < 2 * q.  Its stretches inside the run recur
after q and not sooner (a shorter distance would be a period of the run), and the run's 4 * q words hold such a pair.  Why no
period is too large: a stretch of smaller period p has its next occurrence after p, so p would have been proposed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlens.llm.common import joined_words, mix, text_slices, word_hashes

MIN_LENGTH = 6
MIN_PERIODS = 4
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _recurring(keys: np.ndarray, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names by place (below 0, all different, where a key occurs once), the places with a name, and each place that has a
    next one with its distance.  ``places`` ascend."""
    order = np.argsort(keys, kind="stable")
    sorted_keys, at = keys[order], places[order]
    same = sorted_keys[1:] == sorted_keys[:-1]
    twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
    names = -1 - np.arange(n, dtype=np.int64)
    names[at[twice]] = np.cumsum(np.concatenate(([False], ~same)))[twice]
    return names, np.sort(at[twice]), at[:-1][same], (at[1:] - at[:-1])[same]


def runs_of(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period.  ``words`` holds one number per word, different numbers in
    different texts; ``ends`` the end of each word's text."""
    n = len(words)
    levels: list[np.ndarray] = []
    heads, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    keys, places, size = words, np.arange(n), 1
    while len(places) > 1:
        names, places, at, gap = _recurring(keys, places, n)
        if not len(places):
            break
        levels.append(names)
        near = gap <= 2 * size
        at, gap = at[near], gap[near]
        order = np.argsort(at)
        at, gap = at[order], gap[order]
        head = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (gap[1:] != gap[:-1])))[: len(at)]
        heads.append(at[head])
        periods.append(gap[head])
        fits = places[places + 2 * size <= ends[places]]
        places = fits[names[fits + size] >= 0]
        keys = names[places] * n + names[places + size]
        size *= 2
    at, period = np.concatenate(heads), np.concatenate(periods)
    left, right = at.copy(), at.copy()
    for k in range(len(levels) - 1, -1, -1):
        names, step = levels[k], 1 << k
        inside = np.flatnonzero(right + period < n)
        inside = inside[names[right[inside]] == names[right[inside] + period[inside]]]
        right[inside] += step
        inside = np.flatnonzero(left >= step)
        inside = inside[names[left[inside] - step] == names[left[inside] - step + period[inside]]]
        left[inside] -= step
    length = right + period - left
    whole = length >= np.maximum(MIN_LENGTH, MIN_PERIODS * period)
    found = np.unique(np.stack([left[whole], period[whole], length[whole]], 1), axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (text, row struct) to (row struct, runs, best, collapsed)."""
    for batch in batches:
        for first, data, offsets in text_slices(batch.column(0)):
            words, start, stop, at = word_hashes(data, offsets, fold=False)
            count = np.diff(at)
            words = words ^ np.repeat(mix(np.arange(1, len(count) + 1, dtype=np.uint64)), count)
            run_at, length, period = runs_of(words, np.repeat(at[1:], count))
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, run_at + period, 1)
            np.add.at(edge, run_at + length, -1)
            keep = np.cumsum(edge[:-1]) == 0
            buffer, upto = joined_words(data, start[keep], stop[keep])
            kept = np.concatenate(([0], np.cumsum(keep)))[at]
            runs, best, texts = [], [], []
            of = np.searchsorted(run_at, at)
            for i, (x, y) in enumerate(zip(of[:-1].tolist(), of[1:].tolist(), strict=True)):
                own = [{"start": s, "length": m, "period": p} for s, m, p in zip((run_at[x:y] - at[i]).tolist(), length[x:y].tolist(), period[x:y].tolist(), strict=True)]
                runs.append(own)
                best.append(heapq.nsmallest(1, own, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"]))[0] if own else None)
                texts.append(buffer[upto[kept[i]] : max(upto[kept[i]], upto[kept[i + 1]] - 1)])
            kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, len(count)), pa.array(runs, pa.list_(kind)), pa.array(best, kind), pa.array(texts, pa.binary()).cast(pa.string())],
                                             ["row", "runs", "best", "collapsed"])


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, runs, best, collapsed) of every row: all runs by start and period, the one of greatest length / period (ties:
    smallest start, then period; null without a run), and the words joined by one space without those that a run holds
    after its first period.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0, upper and lower case apart.  A null text has no words, no runs and an empty collapsed text.
    Every row is judged alone: null and repeated keys make no difference, other columns are ignored, an empty table gives
    an empty result.  Memory grows with the longest text times the logarithm of its longest repeated stretch.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(text).alias("text"), F.struct(F.col(key).alias("key")).alias("row"))
    found = rows.mapInArrow(_rows, f"row struct<key:{kind}>, runs array<{RUN}>, best {RUN}, collapsed string")
    return found.select(F.col("row.key").alias(key), "runs", "best", "collapsed")


def with_repeats(text: Column, key: Column) -> Column:
    """The text's words joined by one space, where for one key in ten (crc32(key) % 10 = 0) the words from some place on repeat.

    With h = crc32 of the decimal key, g = floor(h / 10), n words, a = g % n and p = 1 + floor((n - a) / (3 + g % 8)), word
    i >= a becomes word a + (i - a) % p.  Without words or key the text stays.
    """
    h = F.crc32(F.encode(key.cast("string"), "UTF-8"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))).cast("int")
    block = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, best run and SHA-256 of the run list and the collapsed text."""
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return found.select(
        key, F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        sha(F.array_join(line, "")).alias("runs_sha256"), sha("collapsed").alias("collapsed_sha256"))
