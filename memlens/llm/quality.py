"""Quality rules: zstandard ratios over whole documents and fixed chunks, beside simple word and line counts."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlens.llm.common import text_slices, window_hashes, word_hashes

SYMBOLS = "#*$%&|<>"
LEVEL = 3
CHUNK_BYTES = 1024
LENGTH_EDGES = (0, 350, 450, 600, 800, 1000, 1300, 1700, 2200, 3000, 4000, 5600, 8000, 12000, 20000, 40000)
# Fixed values: (bytes from which the band holds, lowest ratio, highest ratio) of compressed to plain size.  They come from
# ``fit_bands`` on the clean labelled texts of the given sf0.1 tables outside a fifth held out, rounded outward; the last
# two go on as the ones before, for want of long clean texts.
DOC_BANDS = ((0, 0.595, 0.80), (350, 0.537, 0.76), (450, 0.537, 0.73), (600, 0.522, 0.71), (800, 0.503, 0.67), (1000, 0.49, 0.64), (1300, 0.48, 0.61), (1700, 0.463, 0.59),
             (2200, 0.458, 0.57), (3000, 0.447, 0.55), (4000, 0.433, 0.53), (5600, 0.42, 0.52), (8000, 0.412, 0.51), (12000, 0.4, 0.50), (20000, 0.388, 0.49), (40000, 0.375, 0.49))
CHUNK_BAND = (0.49, 0.72)
BAD_CHUNKS = 2
BAD_CHUNK_SHARE = 0.25
BAD_CHUNK_RUN = 3
SCHEMA = """n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, doc_ratio double,
            n_chunks long, n_bad_chunks long, bad_run long, base_failed boolean, verdict string, kept boolean"""
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(SYMBOLS.encode(), np.uint8)] = True


Bands = tuple[tuple[int, float, float], ...]


def band(n_bytes: int, bands: Bands) -> tuple[float, float]:
    return bands[bisect_right([b[0] for b in bands], n_bytes) - 1][1:]


def _dup_lines(lines: list[bytes]) -> int:
    seen: set[bytes] = set()
    again = 0
    for line in lines:
        if line.strip(b" \t\n\x0b\x0c\r"):
            again += line in seen
            seen.add(line)
    return again


def _repeat_words(windows: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    words = np.zeros(len(windows) + 2, bool)
    for j in range(3):
        words[j : j + len(windows)] |= twice
    return int(words.sum())


def _ratios(raw: bytes, packer: zstandard.ZstdCompressor, chunk_band: tuple[float, float]) -> tuple[float, int, int, int]:
    """(ratio of the whole, chunks, chunks outside the band, longest run of these).  A last chunk of under half the size joins
    the one before; a text of one chunk is judged as a whole only."""
    if not raw:
        return 0.0, 0, 0, 0
    whole = len(packer.compress(raw)) / len(raw)
    n = max(1, len(raw) // CHUNK_BYTES + (len(raw) % CHUNK_BYTES >= CHUNK_BYTES // 2))
    bad = run = longest = 0
    for i in range(n if n > 1 else 0):
        piece = raw[i * CHUNK_BYTES : (i + 1) * CHUNK_BYTES if i < n - 1 else len(raw)]
        outside = not chunk_band[0] <= len(packer.compress(piece)) / len(piece) <= chunk_band[1]
        bad += outside
        run = run + 1 if outside else 0
        longest = max(longest, run)
    return whole, n, bad, longest


def verdict_of(n_words: int, repeats: int, n_bytes: int, whole: float, chunks: int, bad: int, run: int, bands: Bands = DOC_BANDS) -> str:
    if n_words < 50:
        return "short"
    if 100 * repeats > 50 * n_words:
        return "repeated words"
    low, high = band(n_bytes, bands)
    if whole < low:
        return "repetitive"
    if whole > high:
        return "incompressible"
    if bad >= BAD_CHUNKS and (run >= BAD_CHUNK_RUN or bad >= BAD_CHUNK_SHARE * chunks):
        return "odd chunks"
    return "kept"


def _rules(bands: Bands, chunk_band: tuple[float, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
        for batch in batches:
            out: list[list] = [[] for _ in range(12)]
            for _, data, offsets in text_slices(batch.column(1)):
                words, start, stop, at = word_hashes(data, offsets, fold=False)
                windows = window_hashes(words, 3)
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                in_words = np.concatenate(([0], np.cumsum(points[stop] - points[start])))
                symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
                for i in range(len(offsets) - 1):
                    a, b, lo, hi = at[i], at[i + 1], offsets[i], offsets[i + 1]
                    raw = data[lo:hi].tobytes()
                    repeats = _repeat_words(windows[a : max(a, b - 2)])
                    ratios = _ratios(raw, packer, chunk_band)
                    verdict = verdict_of(int(b - a), repeats, len(raw), *ratios, bands)
                    row = (b - a, in_words[b] - in_words[a], symbols[hi] - symbols[lo], _dup_lines(raw.split(b"\n")), repeats,
                           *ratios, verdict in ("short", "repeated words"), verdict, verdict == "kept")
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = (pa.int64(),) * 5 + (pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                                             ["id", *"n_words word_chars n_symbols n_dup_lines n_repeat_words doc_ratio n_chunks n_bad_chunks bad_run base_failed verdict kept".split()])

    return run


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: Bands = DOC_BANDS, chunk_band: tuple[float, float] = CHUNK_BAND) -> DataFrame:
    """Counts, compression ratios and a verdict for every row.

    * words are runs of characters other than ASCII white space; ``word_chars`` counts their code points;
    * ``n_dup_lines``: lines with a word that equal an earlier line; ``n_repeat_words``: words in 3-word windows
      that occur twice or more in the text;
    * ``doc_ratio``: zstandard size over plain size of the whole text, judged by the band of its length, because short
      texts compress less; texts of several chunks of CHUNK_BYTES are also judged chunk by chunk: a run of BAD_CHUNK_RUN
      chunks outside their band, or a share of BAD_CHUNK_SHARE (two at least), rejects;
    * ``verdict``: ``short`` (under 50 words), ``repeated words`` (over half), ``repetitive``, ``incompressible``,
      ``odd chunks`` or ``kept``.

    A null or empty text has zero words and is ``short``.  Rows are judged one by one: null and repeated keys make no difference,
    other columns are ignored, an empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[key]
    light = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return light.mapInArrow(_rules(bands, chunk_band), f"id {kind}, {SCHEMA}").withColumnRenamed("id", key)


def fit_bands(docs: DataFrame, labels: DataFrame, edges: tuple[int, ...] = LENGTH_EDGES, tail: float = 0.003, slack: tuple[float, float] = (0.005, 0.05), least: int = 20,
              key: str = "doc_id", text: str = "text", label: str = "quality") -> Bands:
    """Bands per length from clean labelled texts (label 1) that pass the word rules: the ``tail`` quantiles of their ratio, and ``slack``.

    A length with under ``least`` such texts takes the band of the next shorter one.  One row per length comes to the driver.
    """
    clean = docs.join(labels.where(F.col(label) == 1).select(key).distinct(), key, "left_semi")
    judged = quality_rules(clean.select(F.struct(F.octet_length(text).alias("n"), F.col(key).alias("k")).alias(key), text), key, text)
    length = F.lit(edges[0])
    for edge in edges[1:]:
        length = F.when(F.col(f"{key}.n") >= edge, edge).otherwise(length)
    found = judged.where("NOT base_failed").groupBy(length.alias("edge")).agg(
        F.count("*").alias("n"), F.percentile("doc_ratio", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    by_edge = {r.edge: (r.n, *r.q) for r in found.collect()}
    out: list[tuple[int, float, float]] = []
    for edge in edges:
        n, low, high = by_edge.get(edge, (0, 0.0, 0.0))
        if n >= least:
            out.append((edge, low - slack[0], high + slack[1]))
        else:
            out.append((edge, *(out[-1][1:] if out else (0.0, 9.9))))
    return tuple(out)
