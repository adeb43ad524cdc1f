"""Helpers of the training-data operators: table access, word hashes in numpy, batches of bounded size.

Conventions that hold for every operator here:

* the id column may be null or repeated; each input row gives one output row unless a docstring says otherwise;
* a null text counts as an empty one;
* input columns that are not named as arguments are ignored, so extra columns with any name do no harm;
* an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 20
_FAMILY = np.random.default_rng(20240611)
_BYTES = _FAMILY.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_BASE = int(_FAMILY.integers(2**40, 2**61)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_PLACES = _FAMILY.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[np.r_[48:58, 65:91, 97:123, 128:256]] = False
_POWERS: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def text_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows, about SLICE_BYTES at a time; null rows are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of many texts: (hashes, first byte, end byte, index of each text's first word).

    ``fold`` lower-cases A-Z; ``breaks`` marks other bytes that end words.  A word's hash is a polynomial over random byte values, taken from prefix sums.
    """
    n = len(data)
    word = ~breaks[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    filled = offsets[1:] > offsets[:-1]
    begins, ends = offsets[:-1][filled], offsets[1:][filled] - 1
    first[begins], last[ends] = word[begins], word[ends]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n)
    value = (_FOLDED if fold else _BYTES)[data] * up
    sums = np.cumsum(value)
    hashes = (sums[stop - 1] - sums[start] + value[start]) * down[start]
    return mix(hashes + (stop - start).astype(np.uint64)), start, stop, np.searchsorted(start, offsets)


def joined_words(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Words one after another with a space behind each, and the place in that buffer where each word starts (and the end)."""
    size = stop - start + 1
    upto = np.concatenate(([0], np.cumsum(size)))
    if not len(size):
        return b"", upto
    source = np.repeat(start - upto[:-1], size) + np.arange(upto[-1])
    out = data[np.minimum(source, len(data) - 1)]
    out[upto[1:] - 1] = 32
    return out.tobytes(), upto


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words; entry i starts at word i."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += words[j : j + n] * _PLACES[j]
    return mix(out)


def sequence_hash(words: np.ndarray) -> np.uint64:
    """Hash of a whole short sequence."""
    return mix(np.array([(words * _PLACES[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))], np.uint64))[0]


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; fewer than k words make one shingle, none make none."""
    for _, data, offsets in text_slices(column):
        words, _, _, at = word_hashes(data, offsets, fold=True)
        windows = window_hashes(words, k)
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if j - i >= k:
                yield np.unique(windows[i : j - k + 1])
            elif j > i:
                yield sequence_hash(words[i:j]).reshape(1)
            else:
                yield np.zeros(0, np.uint64)


def list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrow list column from numpy pieces, without Python objects per value."""
    sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat).cast(kind))


def batches_of(rows: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
