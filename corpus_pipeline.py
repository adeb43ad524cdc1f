"""From raw documents to sharded training data: five stages, each a Spark job over all that the one before kept.

Toxic documents go; of near copies one stays; documents with copies of test items go; sources are mixed to target
weights; what is left is dealt to shards.  Rows are told apart by what they are, not by their ids: rows without an id and rows
that share one are judged one by one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlens.llm import decontamination, jaccard, mixing, sharding, toxicity
from memlens.llm.common import table
from memlens.session import cut, ensure_checkpoint_dir

MIX_SHARE = 0.8
SHARDS = 16
ROW = "_pipeline_row"


def _columns(docs: DataFrame, without: tuple[str, ...] = ()) -> list:
    return [F.col(f"`{c}`") for c in docs.columns if c not in without]


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number each in column ROW, kept in the shared folder, so that a task that runs again gives the same numbers."""
    return cut(docs.withColumn(ROW, F.monotonically_increasing_id()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones among them, does not reject.  The text alone decides: ids may be
    null or repeated, null and empty texts stay."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).select(*_columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id, one without an id only where no other is.  Of equal rows
    one stays.  Texts without words have no copies and all stay."""
    rows = numbered(docs)
    classes = jaccard.near_copies(rows, key=ROW).select(ROW, "component_id")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", ROW)).alias("least")
    first = classes.join(rows.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(least).select(F.col(f"least.{ROW}").alias(ROW))
    return rows.join(first, ROW, "left_semi").select(*_columns(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a test item.  Rows of one text share their fate, whatever their ids."""
    rows = docs.withColumn(ROW, F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256))
    found = decontamination.find_contamination(rows, table(spark, sf_dir, "benchmark"), key=ROW).select(ROW).distinct()
    return rows.join(found, ROW, "left_anti").select(*_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MIX_SHARE of all tokens, dealt evenly over domains' languages' sources as far as each has them; nothing repeats.  A row is chosen or
    not, whatever its id."""
    chosen = mixing.mix(docs, mixing.tree_of(docs), mixing.source_domain(F.col("source")), MIX_SHARE, share=True, max_epochs=1, seed=8, carry=True)
    return chosen.select("_row.*")


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of the documents and their size, text_crc32, law, shard, slot and grown_shard (see ``sharding.shard_documents``); input
    columns of these names are left out.  Rows without an id share a shard."""
    rows = numbered(docs)
    placed = sharding.shard_documents(rows, SHARDS, carry=(ROW,)).drop("doc_id")
    added = tuple(c for c in placed.columns if c != ROW)
    return rows.select(ROW, *_columns(docs, added)).join(placed, ROW).drop(ROW)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", to_shards),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the table documents; each result is a Parquet table in the shared folder, read by the next."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
