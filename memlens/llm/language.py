"""Language identification by prediction by partial matching: per-language byte context trees, exact code lengths.

Training counts, for every language, how often a byte follows each context of MAX_ORDER bytes; shorter contexts are sums
over longer ones.  The statistics are then frozen.  The code length of a byte is found at the longest context seen in
training: a byte seen there costs -log2(count / (total + distinct)); any other costs the escape
-log2(distinct / (total + distinct)) and is coded one order lower, down to a uniform order.  Because nothing adapts
while a text is read, each (context, byte) has one fixed cost, and a text's cost is a sum of table entries.

All byte values are symbols of their own.  Only contexts and bytes that were seen are held, as sorted codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlens.llm.common import text_slices

MAX_ORDER = 3
SYMBOLS = 256
SOFT_BYTES = 200
UNKNOWN = "und"


def training_rows(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 != 1


def codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(context, byte) code of every byte of many texts; each text starts after MAX_ORDER blanks."""
    s = data.astype(np.int64)
    out = s.copy()
    begins = offsets[:-1]
    for k in range(1, MAX_ORDER + 1):
        back = np.full(len(s), 32, np.int64)
        back[k:] = s[:-k]
        for j in range(k):  # bytes before a text's start are blanks
            at = begins + j
            back[at[at < offsets[1:]]] = 32
        out += back * SYMBOLS**k
    return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _context_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for at, data, offsets in text_slices(batch.column(1)):
            found = codes(data, offsets)
            names, which = np.unique(np.array(langs[at : at + len(offsets) - 1]), return_inverse=True)
            of_byte = np.repeat(which, np.diff(offsets))
            for i, lang in enumerate(names.tolist()):
                place, keys = pd.factorize(found[of_byte == i])
                parts = total.setdefault(lang, [])
                parts.append((keys, np.bincount(place, minlength=len(keys))))
                while len(parts) > 1 and len(parts[-2][0]) <= 2 * len(parts[-1][0]):  # sizes fall by half: each key is merged a few times
                    last = [parts.pop(), parts.pop()]
                    parts.append(summed(np.concatenate([k for k, _ in last]), np.concatenate([n for _, n in last])))
    for lang, parts in total.items():
        keys, n = summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
        for at in range(0, len(keys), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys[part])), pa.array(keys[part], pa.int64()), pa.array(n[part], pa.int64())], ["lang", "code", "n"])


class Costs:
    """Bits of every (context, byte) of one language, by escape from longer to shorter contexts.

    Per order, from the longest: the codes seen with their bits, and the contexts seen with the bits of their escape.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, size: int = SYMBOLS):
        self.size = size
        self.orders = []
        for order in range(MAX_ORDER, -1, -1):
            keys, counts = summed(keys % size ** (order + 1), counts)
            contexts, which, kinds = np.unique(keys // size, return_inverse=True, return_counts=True)
            whole = np.bincount(which, counts, len(contexts)) + kinds
            self.orders.append((keys, np.log2(whole[which] / counts), contexts, np.log2(whole / kinds)))

    def bits(self, wanted: np.ndarray) -> np.ndarray:
        """Bits of each code."""
        out = np.zeros(len(wanted))
        left = np.arange(len(wanted))
        for order, (keys, bits, contexts, escapes) in zip(range(MAX_ORDER, -1, -1), self.orders, strict=True):
            code = wanted[left] % self.size ** (order + 1)
            at, seen = _places(keys, code)
            out[left[seen]] += bits[at[seen]]
            left, code = left[~seen], code[~seen]
            at, seen = _places(contexts, code // self.size)
            out[left[seen]] += escapes[at[seen]]
        out[left] += np.log2(self.size)
        return out


def _places(ordered: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value is in a sorted array, and whether it is there."""
    at = np.searchsorted(ordered, wanted)
    seen = at < len(ordered)
    seen[seen] = ordered[at[seen]] == wanted[seen]
    return at, seen


def cost_table(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Bits of every (context, byte) of a small alphabet, as one dense table."""
    return Costs(keys, counts, size).bits(np.arange(size ** (MAX_ORDER + 1)))


class Model:
    """Frozen statistics of all languages: the counts of the codes that occur in training."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.counts = counts
        self.langs = sorted(counts)

    def tables(self) -> list[Costs]:
        return [Costs(*self.counts[lang]) for lang in self.langs]


def train(rows: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Context counts of all given rows with a language.  The driver gets the summed counts only: a row for every language and
    run of MAX_ORDER + 1 bytes that occurs, whatever the number of texts."""
    known = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    found = known.mapInArrow(_context_counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    return Model({name: (part["code"].to_numpy(), part["n"].to_numpy()) for name, part in found.groupby("lang")})


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        tables = model.tables()
        for batch in batches:
            names: list[str] = []
            scores: list[float] = []
            bits_per_byte: list[float | None] = []
            texts = batch.column(1)
            for at, data, offsets in text_slices(texts):
                n = np.diff(offsets)
                place, found = pd.factorize(codes(data, offsets))
                bits = np.zeros((len(n), len(tables)))
                for j, costs in enumerate(tables):
                    sums = np.concatenate(([0.0], np.cumsum(costs.bits(found)[place])))
                    bits[:, j] = sums[offsets[1:]] - sums[offsets[:-1]]
                for i in range(len(n)):
                    value = texts[at + i].as_py()
                    if not tables or value is None or not any(map(str.isalpha, value)):
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        bits_per_byte.append(None)
                        continue
                    best = int(bits[i].argmin())
                    odds = np.exp2(-(bits[i] - bits[i, best]) * min(1.0, SOFT_BYTES / n[i]))
                    names.append(model.langs[best])
                    scores.append(float(1.0 / odds.sum()))
                    bits_per_byte.append(float(bits[i, best] / n[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(bits_per_byte, pa.float64())],
                                             ["id", "lang_pred", "score", "bits_per_byte"])

    return run


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, bits_per_byte) of every row: the language with the shortest code.

    Ties go to the first name.  ``score`` is the winner's share of 2**-bits over all languages, with the bits of texts over
    SOFT_BYTES scaled down to that length.  Null texts, texts without a letter, and a model without languages give
    ``und`` and 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the counts of the codes that occur in training
    kind = dict(docs.dtypes)[key]
    light = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return light.mapInArrow(_predict(shared), f"id {kind}, lang_pred string, score double, bits_per_byte double").withColumnRenamed("id", key)


def predict_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on the rows whose key's crc32 mod 3 is not 1, predict all: (key, held_out, lang_pred, score, bits_per_byte)."""
    model = train(docs.where(training_rows(key)), lang, text)
    return identify(docs, model, key, text).select(key, (~F.coalesce(training_rows(key), F.lit(True))).alias("held_out"), "lang_pred", "score", "bits_per_byte")
