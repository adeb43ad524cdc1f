"""File trees: scan with skip reasons and budget, index with change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlens import fixed_values as V
from memlens.common import prefix_counts
from memlens.functions import text as T
from memlens.session import cut


def path_reason(path: Column) -> Column:
    """Why a path alone excludes a file, or null."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    dirs = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return (F.when(F.arrays_overlap(dirs, T.literal_array(V.EXCLUDED_DIRS)), "excluded-dir").when(~T.is_repo_relative(path), "out-of-repo")
            .when(T.matches_any(name, ["(" + "|".join(s.replace(".", r"\.") for s in V.EXCLUDED_SUFFIXES) + ")$"]), "excluded-suffix"))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, content, size_bytes) of every file under ``root``.

    Oversize files are not opened, and files that their path excludes are not decoded; both keep no content.  Bytes that are
    not UTF-8 become replacement characters, so a binary file is read and then skipped by its NUL bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", "^file:/*" + root.strip("/") + "/|^" + root.rstrip("/") + "/", "")
    small = files.where(F.col("length") <= V.MAX_FILE_BYTES).select(rel.alias("rel_path"), "content", F.col("length").alias("size_bytes"))
    small = small.withColumn("content", F.when(path_reason(F.col("rel_path")).isNull(), F.make_valid_utf8(F.col("content").cast("string"))))
    large = files.where(F.col("length") > V.MAX_FILE_BYTES).select(rel.alias("rel_path"), F.lit(None).cast("string").alias("content"), F.col("length").alias("size_bytes"))
    return small.unionByName(large)


def scan_files(files: DataFrame, max_bytes: int = V.MAX_FILE_BYTES, max_files: int = V.WALK_MAX_FILES, byte_budget: int = V.WALK_MAX_BYTES) -> DataFrame:
    """``files(rel_path, content, size_bytes)`` -> state kept, pending or skipped with its reason.

    The budget is cut by running sums in path order (two-level: over ranges of paths, then inside each range, however alike
    the paths are): every file behind the point where the budget ends is pending.
    """
    reason = (F.coalesce(path_reason(F.col("rel_path")), F.when(F.col("size_bytes") > max_bytes, "too-large").when(F.col("content").isNull(), "unreadable")
              .when(F.contains(F.substring("content", 1, V.NUL_SNIFF_BYTES), F.lit("\0")), "binary")))
    f = files.withColumn("reason", reason)
    ok = f.where(F.col("reason").isNull()).withColumn("one", F.lit(1))
    light = cut(ok.select("rel_path", "size_bytes", "one").repartitionByRange("rel_path").withColumn("_range", F.spark_partition_id()))
    before = prefix_counts(light, [], "rel_path", F.col("_range"), ["size_bytes", "one"]).select("rel_path", "before_size_bytes", "before_one")
    placed = ok.join(before, "rel_path")
    fits = (F.col("before_size_bytes") + F.col("size_bytes") <= byte_budget) & (F.col("before_one") < max_files)
    kept = placed.select(*files.columns, F.lit(None).cast("string").alias("reason"), F.when(fits, "kept").otherwise("pending").alias("state"))
    return kept.unionByName(f.where(F.col("reason").isNotNull()).withColumn("state", F.lit("skipped")))


def index_files(scanned: DataFrame, index: DataFrame) -> DataFrame:
    """``scanned(rel_path, content, summary, symbols)`` against ``index(rel_path, hash)`` -> one action per path.

    no-op, updated, indexed, leakage, injection, or missing for indexed paths no
    longer found.
    """
    s = scanned.select("rel_path", F.sha2("content", 256).alias("new_hash"), F.concat_ws("\n", "summary", "symbols").alias("_corpus"))
    j = s.join(index.select("rel_path", F.col("hash").alias("old_hash")), "rel_path", "full")
    action = (F.when(F.col("new_hash").isNull(), "missing").when(F.col("new_hash") == F.col("old_hash"), "no-op")
              .when(T.leakage(F.col("_corpus"), core=False).isNotNull(), "leakage").when(T.prompt_injection(F.col("_corpus")).isNotNull(), "injection")
              .when(F.col("old_hash").isNotNull(), "updated").otherwise("indexed"))
    j = j.withColumn("action", action)
    took = F.col("action").isin("updated", "indexed")
    return j.select("rel_path", "action", F.when(took, F.col("new_hash")).otherwise(F.col("old_hash")).alias("hash"))
