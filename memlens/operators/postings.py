"""Stored postings with bounds, and exact BM25 top-k that reads only blocks that can matter.

A term's postings are cut by impact: tier 0 holds contributions near the term's largest, each further tier those a constant
factor lower; a crowded tier is cut again by a hash of the document.  Every block knows its largest contribution.

A query opens blocks, which propose documents with what the opened blocks say of their score; documents that may still reach
the k-th place are scored in full.  Postings lie with their documents (a forward list of terms), so opening blocks is one pass over
these lists, and blocks themselves are kept as sizes and bounds only.

1. The blocks of largest contribution are opened until they hold FIRST_ROWS times k postings.  Of the documents in them that pass the
   caller's filter the most promising are scored; the k-th best score is a floor under the true k-th score.
2. Blocks are closed from the least contribution up while the largest contributions of each term's closed blocks add up
   to less than CLOSED_SHARE of the floor: a document in closed blocks only cannot reach it.  All other blocks are opened, and of
   the documents in them those are left out whose opened part and that sum stay below the floor.  A larger share opens less
   and leaves more documents to be scored in full.
3. Queries that found fewer than k documents have no floor and open everything.  Queries that need all their words open the
   blocks of their rarest word alone, since every hit is there.

So very common words never propose documents as long as rarer ones settle the query, results are exact, and no task holds a
term: joins are on documents, or with opened blocks that were counted and found few.  Terms are 64-bit hashes.

Where the asked words are few (TASK_ROWS), every task gets them: texts are counted for these words only, a document's list is weighed
where it lies, and tasks add up whole scores of documents, query by query, so that nothing is closed in step 2 and only documents
that reach the floor leave a task.  Otherwise the same steps are joins.

``counts`` is the part that reads texts; stored, it serves any later question (``build_counted``) without all words' postings.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlens import fixed_values as V
from memlens.common import top_k
from memlens.functions import text as T
from memlens.session import cut

TIERS = 12
TIER_FACTOR = 0.8
BLOCK_ROWS = 50_000
FIRST_ROWS = 512
FIRST_DOCS = 4
CLOSED_SHARE = 0.4
FEW_ROWS = 300_000
TASK_ROWS = 2_000_000
CELLS = 2_000_000
COUNTED_AT_ONCE = 256
BLOCK = ["term", "tier", "salt"]


class Postings(NamedTuple):
    """``blocks(term, tier, salt, top, n)``, ``forward(doc_id, terms: array<long>, tiers: array<tinyint>, c: array<double>)``."""

    blocks: DataFrame
    forward: DataFrame


def term_key(term: Column) -> Column:
    return F.xxhash64(term)


def counts(docs: DataFrame, weights: dict[str, float], known: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, dl, terms: array<long>, wtf: array<double>): length and weighted term frequencies of ``docs(doc_id, <columns of weights>)``.

    Words are counted row by row, so nothing is shuffled.  ``known``: keys of the words to be counted; lengths count all words.
    """
    weighed = [float(w) for w in weights.values()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = (lambda words: map(known.get, words)) if known is not None else iter
        for whole in batches:
            for at in range(0, whole.num_rows, COUNTED_AT_ONCE):
                batch = whole.slice(at, COUNTED_AT_ONCE)
                lengths, terms, freqs = [], [], []
                for texts in zip(*[c.to_pylist() for c in batch.columns[1:]]):
                    total, length = {}, 0
                    for text, w in zip(texts, weighed):
                        words = text.split()
                        length += len(words)
                        for term, n in Counter(named(words)).items():
                            total[term] = total.get(term, 0.0) + n * w
                    total.pop(None, None)
                    lengths.append(length)
                    terms.append(list(total))
                    freqs.append(list(total.values()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int32()), pa.array(terms, pa.list_(pa.string() if known is None else pa.int64())), pa.array(freqs, pa.list_(pa.float64()))],
                                                 ["doc_id", "dl", "terms", "wtf"])

    texts = docs.select("doc_id", *[T.index_text(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in weights])
    counted = texts.mapInArrow(count, f"doc_id {_kind(docs, 'doc_id')}, dl int, terms array<{'string' if known is None else 'long'}>, wtf array<double>")
    return counted.withColumn("terms", F.transform("terms", term_key)) if known is None else counted


def _kind(table: DataFrame, column: str) -> str:
    return table.schema[column].dataType.simpleString()


def build(docs: DataFrame, weights: dict[str, float], wanted: DataFrame | None = None) -> Postings:
    """Postings of ``docs(doc_id, <columns of weights>)``, of all terms or of those in ``wanted(term)`` only.

    Term frequencies are weighted by column; corpus statistics cover every document.  A term in more than half of the corpus
    counts V.BM25_IDF_FLOOR.  The tables are written once (checkpoint).
    """
    if wanted is not None:
        own = cut(wanted.select("term", term_key(F.col("term")).alias("key")).distinct())
        if own.count() <= FEW_ROWS:
            return _built(counts(docs, weights, dict(zip(*own.toArrow().to_pydict().values()))))
    return build_counted(counts(docs, weights), wanted)


def build_counted(counted_docs: DataFrame, wanted: DataFrame | None = None) -> Postings:
    """``build`` from what ``counts`` gives."""
    if wanted is None:
        return _built(counted_docs)
    own = cut(wanted.select(term_key(F.col("term")).alias("term")).distinct())
    if own.count() > FEW_ROWS:
        return _built(counted_docs, own)
    keys = np.sort(own.toArrow()["term"].to_numpy())

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, terms, freqs = _postings(batch, "terms", "wtf")
            held = _places(keys, terms) >= 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("dl"), *_lists(batch.num_rows, row[held], terms[held], freqs[held])], ["doc_id", "dl", "terms", "wtf"])

    return _built(counted_docs.select("doc_id", "dl", "terms", "wtf").mapInArrow(chosen, f"doc_id {_kind(counted_docs, 'doc_id')}, dl int, terms array<long>, wtf array<double>"))


def _postings(batch: pa.RecordBatch, *columns: str) -> tuple[np.ndarray, ...]:
    """Row numbers and flat values of list columns that are equally long in every row."""
    row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(columns[0]).offsets.to_numpy()))
    return row, *[batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in columns]


def _lists(n: int, row: np.ndarray, *values: np.ndarray) -> list[pa.ListArray]:
    offsets = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]


def _places(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where ``asked`` stand in sorted ``keys``; -1 for those that do not."""
    if not len(keys):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, at, -1)


def _built(counted_docs: DataFrame, own: DataFrame | None = None) -> Postings:
    counted = cut(counted_docs)
    size = counted.agg(F.count("*").alias("n"), F.sum("dl").alias("dl"), F.count_distinct("doc_id").alias("ids")).first()
    rows = counted.select("doc_id", "dl", F.explode(F.arrays_zip("terms", "wtf")).alias("t")).select("doc_id", "dl", F.col("t.terms").alias("term"), "t.wtf")
    if own is not None:
        rows = rows.join(own, "term", "left_semi")
    apart = size["ids"] == size["n"]
    if not apart:  # rows of one id are one document
        rows = cut(rows.groupBy("doc_id", "term").agg(F.sum("wtf").alias("wtf"), F.first("dl").alias("dl")))
    n, avgdl = float(size["n"]), (size["dl"] or 0) / max(size["n"], 1)
    normed = lambda wtf, dl: wtf * (V.BM25_K1 + 1) / (wtf + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * dl / avgdl))
    norm = normed(F.col("wtf"), F.col("dl"))
    df = F.col("df")
    idf = F.ln((n - df + 0.5) / (df + 0.5))
    per_term = cut(rows.select("term", norm.alias("norm")).groupBy("term").agg(F.count("*").alias("df"), F.max("norm").alias("most"))
                   .select("term", "most", F.when(idf <= 0, F.lit(V.BM25_IDF_FLOOR)).otherwise(idf).alias("idf"), F.ceil(df / BLOCK_ROWS).cast("int").alias("salts")))
    if apart and per_term.count() <= FEW_ROWS:
        known = per_term.select("term", "most", "idf").orderBy("term").toArrow()
        keys, most, weight = (known[c].to_numpy() for c in known.column_names)

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, terms, freqs = _postings(batch, "terms", "wtf")
                held = _places(keys, terms)
                row, terms, freqs, held = (x[held >= 0] for x in (row, terms, freqs, held))
                value = normed(freqs, batch.column("dl").to_numpy()[row])
                tier = np.clip(np.floor(np.log(most[held] / value) / np.log(1 / TIER_FACTOR)), 0, TIERS - 1).astype(np.int8)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_lists(batch.num_rows, row, terms, tier, weight[held] * value)], ["doc_id", "terms", "tiers", "c"])

        forward = cut(counted.where(F.size("terms") > 0).mapInArrow(weigh, f"doc_id {_kind(counted, 'doc_id')}, terms array<long>, tiers array<tinyint>, c array<double>"))
    else:
        tier = F.greatest(F.least(F.floor(F.log(F.col("most") / F.col("norm")) / F.log(F.lit(1 / TIER_FACTOR))), F.lit(TIERS - 1)), F.lit(0)).cast("tinyint")
        impacts = rows.select("doc_id", "term", norm.alias("norm")).join(few(per_term), "term").select("doc_id", "term", tier.alias("tier"), (F.col("idf") * F.col("norm")).alias("c"))
        forward = cut(impacts.groupBy("doc_id").agg(F.collect_list(F.struct("term", "tier", "c")).alias("t")).select(
            "doc_id", F.col("t.term").alias("terms"), F.col("t.tier").alias("tiers"), F.col("t.c").alias("c")))
    salt = F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")
    blocks = _entries(forward).join(few(per_term), "term").groupBy("term", "tier", salt.alias("salt")).agg(F.max("c").alias("top"), F.count("*").alias("n"))
    return Postings(cut(blocks), forward)


def _entries(forward: DataFrame) -> DataFrame:
    """(doc_id, term, tier, c), a row per posting; further columns are kept."""
    rest = [c for c in forward.columns if c not in ("terms", "tiers", "c")]
    return forward.select(*rest, F.explode(F.arrays_zip("terms", "tiers", "c")).alias("t")).select(*rest, F.col("t.terms").alias("term"), F.col("t.tiers").alias("tier"), "t.c")


def save(index: Postings, folder: str) -> None:
    for name, table in index._asdict().items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str) -> Postings:
    return Postings(*[spark.read.parquet(f"{folder}/{name}") for name in Postings._fields])


def few(table: DataFrame) -> DataFrame:
    """A checkpointed table, sent to all tasks if it was counted and is small."""
    return F.broadcast(table) if table.count() <= FEW_ROWS else table


def _proposed(opened: DataFrame, index: Postings) -> DataFrame:
    """(query_id, doc_id, part): documents in the blocks of ``opened(query_id, term, tier, least)`` and the sum of what these say, where
    that reaches the query's ``least`` (null: whatever it is)."""
    opened = cut(opened)
    if opened.count() > TASK_ROWS:
        sums = _entries(index.forward).join(few(opened), ["term", "tier"]).groupBy("query_id", "doc_id").agg(F.sum("c").alias("part"), F.first("least").alias("least"))
        return sums.where(F.col("least").isNull() | (F.col("part") >= F.col("least"))).drop("least")
    asked = _Asked(opened.select("query_id", "least", "term", "tier"))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step := max(1, CELLS // max(1, len(asked.ids)))):
                batch = whole.slice(at, step)
                row, terms, tiers, c = _postings(batch, "terms", "tiers", "c")
                cells = np.zeros((batch.num_rows, len(asked.ids)))
                touched = np.zeros(cells.shape, dtype=bool)
                place, query = asked.meet(terms, tiers)
                cell = row[place] * len(asked.ids) + query
                touched.ravel()[cell] = True
                cells = np.bincount(cell, weights=c[place], minlength=cells.size).reshape(cells.shape)
                doc, query = np.nonzero(touched & (cells >= asked.least))
                yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(query)), batch.column("doc_id").take(pa.array(doc)), pa.array(cells[doc, query])], ["query_id", "doc_id", "part"])

    return index.forward.mapInArrow(propose, f"query_id {_kind(opened, 'query_id')}, doc_id {_kind(index.forward, 'doc_id')}, part double")


class _Asked:
    """Counted few rows (query_id, least, term, tier) as arrays that every task holds: which queries ask for a word's tier."""

    def __init__(self, opened: DataFrame) -> None:
        rows = opened.toArrow().combine_chunks()
        coded = rows["query_id"].combine_chunks().dictionary_encode() if rows.num_rows else pa.array([], rows.schema.field("query_id").type).dictionary_encode()
        self.ids, query = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.least = np.full(len(self.ids), -np.inf)
        self.least[query] = np.nan_to_num(rows["least"].to_numpy().astype(float), nan=-np.inf)
        self.terms, term = np.unique(rows["term"].to_numpy(), return_inverse=True)
        code = term * TIERS + rows["tier"].to_numpy()
        order = np.argsort(code, kind="stable")
        self.queries = query[order]
        self.starts = np.searchsorted(code[order], np.arange(len(self.terms) * TIERS + 1))

    def meet(self, terms: np.ndarray, tiers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of a posting, number of a query that asks for it), all of them."""
        at = _places(self.terms, terms)
        held = np.nonzero(at >= 0)[0]
        code = at[held] * TIERS + tiers[held]
        first, n = self.starts[code], self.starts[code + 1] - self.starts[code]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(held, n), self.queries[np.repeat(first, n) + within]


def search(terms: DataFrame, index: Postings, k: int, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, doc_id, bm25, rank): the exact best ``k`` documents per query among those ``keep`` lets through.

    ``terms(query_id, term, n_terms, need_all)`` as ``retrieval.query_terms`` gives it; scores are rounded to six places, ties
    go to the smaller document.  ``keep(query_id, doc_id, bm25)`` must not look at the score: it runs before documents are scored.
    """
    asked = cut(terms.select("query_id", term_key(F.col("term")).alias("term"), "n_terms", "need_all").distinct())
    tiers = index.blocks.groupBy("term", "tier").agg(F.max("top").alias("top"), F.sum("n").alias("n"))
    offered = cut(few(asked).join(tiers, "term"))
    closing = offered.count() > TASK_ROWS
    any_part = F.lit(None).cast("double").alias("least")

    def kept(pairs: DataFrame) -> DataFrame:
        return keep(pairs.withColumnRenamed("part", "bm25")).dropDuplicates(["query_id", "doc_id"]).withColumnRenamed("bm25", "part") if keep else pairs

    def scored(pairs: DataFrame) -> DataFrame:
        own = _entries(index.forward.join(few(cut(pairs.select("query_id", "doc_id"))), "doc_id"))
        hits = own.select("query_id", "doc_id", "term", "c").join(few(asked), ["query_id", "term"])
        out = hits.groupBy("query_id", "doc_id", "n_terms", "need_all").agg(F.sum("c").alias("c"), F.count("*").alias("hits"))
        out = out.where(~F.col("need_all") | (F.col("hits") == F.col("n_terms"))).select("query_id", "doc_id", F.round("c", 6).alias("bm25"))
        return cut(top_k(keep(out) if keep else out, ["query_id"], [F.desc("bm25"), F.asc("doc_id")], k))

    some, every = offered.where("NOT need_all"), offered.where("need_all")
    # a query has at most TIERS rows per word, so these windows are over short groups
    down = W.partitionBy("query_id").orderBy(F.desc("top"), "term", "tier")
    first = some.withColumn("before", F.coalesce(F.sum("n").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < FIRST_ROWS * k)
    likely = top_k(kept(_proposed(first.select("query_id", "term", "tier", any_part), index)), ["query_id"], [F.desc("part"), F.asc("doc_id")], FIRST_DOCS * k)
    floors = scored(likely).where(F.col("rank") == k).select("query_id", F.col("bm25").alias("floor"))
    up = W.partitionBy("query_id").orderBy("top", "term", F.desc("tier"))
    step = F.col("top") - F.coalesce(F.lag("top").over(W.partitionBy("query_id", "term").orderBy("top", F.desc("tier"))), F.lit(0.0))
    reach = F.sum("step").over(up.rowsBetween(W.unboundedPreceding, 0))
    ranked = cut(some.withColumn("step", step).withColumn("reach", reach).join(floors, "query_id", "left")
                 .withColumn("closed", F.coalesce(F.lit(closing) & (F.col("reach") < F.col("floor") * CLOSED_SHARE - 2e-6), F.lit(False))))
    spare = ranked.groupBy("query_id").agg(F.first("floor").alias("floor"), F.coalesce(F.max(F.when(F.col("closed"), F.col("reach"))), F.lit(0.0)).alias("spare"))
    least = spare.select("query_id", (F.col("floor") - F.col("spare") - 2e-6).alias("least"))
    able = _proposed(ranked.where("NOT closed").join(least, "query_id").select("query_id", "term", "tier", "least"), index).select("query_id", "doc_id", "part")
    if not every.isEmpty():
        df = every.groupBy("query_id", "term").agg(F.sum("n").alias("df"))
        rarest = df.groupBy("query_id").agg(F.min(F.struct("df", "term")).alias("m")).select("query_id", F.col("m.term").alias("term"))
        able = able.unionByName(_proposed(every.join(rarest, ["query_id", "term"], "left_semi").select("query_id", "term", "tier", any_part), index))
    return scored(kept(able))
