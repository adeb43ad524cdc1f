"""Toxicity by weak supervision.

Voters: lexicons (words) and patterns (word beginnings) mined from labelled rows, plus fixed surface patterns; each
says toxic, clean or nothing.  A generative label model finds by expectation maximisation how often each voter fires
on toxic and on clean texts, and how voters move together beyond what the class explains; the given label is one more
voter.  Its posterior labels train a linear classifier over the lexicon terms and the voters, which scores every text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlens.session import cut

SAMPLE_ROWS = 20_000
MAX_TERMS = 1024
MIN_TOXIC = 5
MIN_LOG_ODDS = 3.0
MIN_GAIN = 15.0
PREFIXES = (4, 5, 6)
LEXICON_VOTERS = 12
PATTERN_VOTERS = 12
WORD = re.compile(r"[^\W\d_]+")
SURFACE = (
    ("address", re.compile(r"\byou(?:'re| are)? (?:an? )?(?:\w+ )?(?:people|lot|all)\b")),
    ("masked", re.compile(r"\b[a-z]\*{2,}[a-z]?\b")),
    ("marks", re.compile(r"!{3,}")),
    ("threat", re.compile(r"\b(?:kill|hurt|hate) (?:you|yourself|them|him|her)\b")),
)
N_VOTERS = LEXICON_VOTERS + PATTERN_VOTERS + 3 + len(SURFACE)


def training_rows(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0


def terms_of(word: str) -> list[str]:
    return ["w:" + word] + [f"p:{word[:n]}" for n in PREFIXES if len(word) > n]


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a min-wise sample of the text's word pairs; copies and most near copies share it."""
    for batch in batches:
        sketches = []
        for text in batch.column(2).to_pylist():
            words = (text or "").lower().split()
            sketches.append(min((zlib.crc32(f"{a} {b}".encode()) for a, b in pairwise(words)), default=-1 - zlib.crc32(" ".join(words).encode())))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sketches, pa.int64())], ["_id", "_label", "_text", "_sketch"])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per term, toxic and clean, of the (bounded) sample's part in this task."""
    counts = (Counter(), Counter())
    for batch in batches:
        for label, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            counts[label].update({t for w in set(WORD.findall((text or "").lower())) for t in terms_of(w)})
    terms = list(counts[0].keys() | counts[1].keys())
    for at in range(0, len(terms), 50_000):
        part = terms[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), *[pa.array([counts[y][t] for t in part], pa.int64()) for y in (1, 0)]], ["term", "toxic", "clean"])


def mine_terms(sample: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """Terms that mark toxic rows, strongest first, MAX_TERMS at most: enough toxic rows, smoothed log odds, and a
    log-likelihood gain that chance does not give to one of many thousand terms."""
    counts = sample.mapInArrow(_count_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / F.lit(n_toxic + 1.0)) - F.log(b / F.lit(n_clean + 1.0))
    gain = F.col("toxic") * odds
    rows = counts.where(F.col("toxic") >= MIN_TOXIC).withColumn("odds", odds).where((F.col("odds") >= MIN_LOG_ODDS) & (gain >= MIN_GAIN)).orderBy(gain.desc(), "term").limit(MAX_TERMS).select("term").toArrow()
    return rows["term"].to_pylist()


class Lexicon:
    """Mined terms and their voters; ``find`` gives a text's term numbers and which voters fire."""

    def __init__(self, terms: list[str]):
        self.number = {t: i for i, t in enumerate(terms)}
        words = [t for t in terms if t[0] == "w"]
        parts = [t for t in terms if t[0] == "p"]
        self.voter = {self.number[t]: i % LEXICON_VOTERS for i, t in enumerate(words)}
        self.voter |= {self.number[t]: LEXICON_VOTERS + i % PATTERN_VOTERS for i, t in enumerate(parts)}
        self.seen: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            found = self.seen[word] = tuple(self.number[t] for t in terms_of(word) if t in self.number)
        return found

    def find(self, text: str | None) -> tuple[list[int], list[int]]:
        low = (text or "").lower()
        hits = [h for w in WORD.findall(low) if (h := self._of(w))]
        terms = sorted({t for h in hits for t in h})
        fired = {self.voter[t] for t in terms}
        base = LEXICON_VOTERS + PATTERN_VOTERS
        fired |= {base + i for i, least in enumerate((2, 4)) if len(hits) >= least}
        if not hits:
            fired.add(base + 2)  # the one voter for clean
        fired |= {base + 3 + i for i, (_, p) in enumerate(SURFACE) if p.search(low)}
        return terms, sorted(fired)


def _find_all(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for batch in batches:
            found = [lexicon.find(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.int32()))],
                                             ["label", "terms", "voters"])

    return run


@dataclass
class LabelModel:
    """Class-conditional firing rates of voters, with a discount for voters that move together."""

    prior: float = 0.5
    rates: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    discount: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.rates[:, 1] / self.rates[:, 0]) * self.discount
        off = np.log((1 - self.rates[:, 1]) / (1 - self.rates[:, 0])) * self.discount
        z = np.log(self.prior / (1 - self.prior)) + votes @ on + (1 - votes) @ off
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @classmethod
    def fit(cls, votes: np.ndarray, start: np.ndarray, rounds: int = 20) -> LabelModel:
        """EM from the given labels as first guess; after each round, the correlation of voters within a class (the part
        the class leaves unexplained) shrinks their say: a voter with the same news as k others counts 1/(1+k)."""
        q = np.clip(start * 0.9 + 0.05, 0.0, 1.0)
        model = cls(discount=np.ones(votes.shape[1]))
        for _ in range(rounds):
            model.prior = float(np.clip(q.mean(), 1e-3, 1 - 1e-3))
            sums = np.stack([(1 - q) @ votes, q @ votes], 1)
            model.rates = np.clip((sums + 0.5) / (np.array([(1 - q).sum(), q.sum()]) + 1.0), 1e-4, 1 - 1e-4)
            rest = votes - ((1 - q)[:, None] * model.rates[:, 0] + q[:, None] * model.rates[:, 1])
            shared = rest.T @ rest / len(votes)
            spread = np.sqrt(np.clip(np.diag(shared), 1e-9, None))
            related = np.abs(shared / np.outer(spread, spread))
            np.fill_diagonal(related, 0.0)
            model.discount = 1 / (1 + np.where(related > 0.1, related, 0.0).sum(axis=1))
            model.discount[-1] = 1.0  # the given label
            q = model.posterior(votes)
        return model


def fit_linear(rows: np.ndarray, cols: np.ndarray, n: int, width: int, target: np.ndarray, rounds: int = 400, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels over sparse 0/1 features; the last weight is the bias.  AdaGrad over all rows."""
    w = np.zeros(width + 1)
    power = np.full(width + 1, 1e-8)
    w[-1] = np.log(np.clip(target.mean(), 1e-4, 1 - 1e-4) / (1 - np.clip(target.mean(), 1e-4, 1 - 1e-4)))
    for _ in range(rounds):
        z = np.bincount(rows, w[cols], n) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        step = np.append(np.bincount(cols, error[rows], width), error.sum()) / n + l2 * np.append(w[:-1], 0.0)
        power += step**2
        w -= 0.3 * step / np.sqrt(power)
    return w


@dataclass
class Model:
    terms: list[str]
    weights: np.ndarray
    base_rate: float
    labels: LabelModel | None = None


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int) -> DataFrame:
    """(key, label, text) of at most ``rows`` labelled training rows, the first in an order of hashed keys; of copies
    with one label, one row: else the words of a text with many copies would pass for signs of its label.

    The chosen keys are bounded, so they may be broadcast; documents are not shuffled.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max((F.col(label) > 0).cast("int")).alias("_label"))
    chosen = known.where(training_rows("_key")).orderBy(F.xxhash64("_key"), "_key").limit(rows)
    source = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    found = source.join(F.broadcast(chosen), F.col("_id") == F.col("_key")).select("_id", "_label", "_text")
    sketched = found.mapInArrow(_sketched, f"_id {dict(found.dtypes)['_id']}, _label int, _text string, _sketch long")
    first = W.partitionBy("_sketch", "_label").orderBy("_id", "_text")
    return sketched.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("_id", "_label", "_text")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a sample of at most ``sample_rows`` labelled rows whose key's crc32 mod 5 is not 0.

    The driver gets MAX_TERMS terms and, per sample row, the numbers of terms and voters found.  Without rows of both
    classes the model has no terms and scores the share of toxic labels (0 without labels).
    """
    sample = cut(labelled_sample(docs, labels, key, text, label, sample_rows))
    sizes = {r["_label"]: r["n"] for r in sample.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model([], np.zeros(N_VOTERS + 1), float(n_toxic > 0))
    terms = mine_terms(sample, n_toxic, n_clean)
    found = sample.mapInArrow(_find_all(terms), "label int, terms array<int>, voters array<int>").orderBy("label", "terms", "voters").toArrow()
    n = len(found)
    truth = found["label"].to_numpy().astype(float)
    votes = np.zeros((n, N_VOTERS + 1))
    pairs = []
    for name, shift in (("terms", 0), ("voters", len(terms))):
        column = found[name].combine_chunks()
        row = np.repeat(np.arange(n), np.diff(column.offsets.to_numpy()))
        pairs.append((row, column.flatten().to_numpy() + shift))
    votes[pairs[1][0], pairs[1][1] - len(terms)] = 1.0
    votes[:, -1] = truth
    labels_model = LabelModel.fit(votes, truth)
    rows, cols = (np.concatenate(x) for x in zip(*pairs, strict=True))
    weights = fit_linear(rows, cols, n, len(terms) + N_VOTERS, labels_model.posterior(votes))
    return Model(terms, weights, n_toxic / n, labels_model)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.lexicon = model, Lexicon(model.terms)

    def __call__(self, text: str | None) -> float:
        model = self.model
        if not model.terms:
            return model.base_rate
        terms, voters = self.lexicon.find(text)
        z = model.weights[-1] + model.weights[terms].sum() + model.weights[[len(model.terms) + v for v in voters]].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer(t) for t in batch.column(1).to_pylist()], pa.float64())], ["id", "score"])

    return run


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of every row; null and empty texts get the score of a text without any voter's word."""
    kind = dict(docs.dtypes)[key]
    light = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    scored = light.mapInArrow(_score(model), f"id {kind}, score double").withColumnRenamed("id", key)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Train and score: (key, held_out, score, predicted) of every row."""
    held = ~F.coalesce(training_rows(key), F.lit(True))
    return score(docs, train(docs, labels, key, text, label), key, text).select(key, held.alias("held_out"), "score", "predicted")


def toxic_score(model: Model):
    """The model as a column function of the text, for filters that keep a table's own columns."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for part in parts:
            yield pd.Series([scorer(t) for t in part], dtype="float64")

    return run


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that the model does not reject (score under 0.5), with all their columns."""
    return docs.where(toxic_score(model)(F.col(text)) < 0.5)
