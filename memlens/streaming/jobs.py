"""Structured Streaming forms of the online path (G10, G12-G14; G11 is in ``loops``).

Each job ends in the same rows as its batch twin on the same input.  State that
several triggers share lives in Parquet versions under the sink folder; a batch
that is replayed after a failure writes the same version again, so nothing is
counted twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memlens import fixed_values as V
from memlens.common import top_k
from memlens.operators import analytics as A
from memlens.operators import usage as U
from memlens.session import cut, ensure_checkpoint_dir
from memlens.sources import events as EV


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder for one job under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/memlens-{name}-{uuid.uuid4().hex}"


def parquet_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Files of ``folder`` by name; a table that is itself a folder of files (``pattern`` is its name) is streamed file by file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isDirectory(path):
        folder, pattern = f"{folder}/{pattern}", "*"
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_available(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


# --- G10 ---------------------------------------------------------------------------


def once_within(events: DataFrame, id_col: str = "event_id", ts_ms: str = "ts", delay: str = "1 day") -> DataFrame:
    """Repeats of an id inside the watermark dropped; rows behind the watermark dropped."""
    timed = events.withColumn("_time", F.timestamp_millis(ts_ms)).withWatermark("_time", delay)
    return timed.dropDuplicatesWithinWatermark([id_col]).drop("_time")


def ingest_events(events: DataFrame, out: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Typed events appended to Parquet, each id once."""
    return (once_within(events, delay=delay).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def ingest_lines(lines: DataFrame, out: str, quarantine: str, checkpoint: str, delay_ms: int = V.DAY_MS) -> StreamingQuery:
    """One stream of ``(line_id, line)`` JSON lines, two sinks: typed events, each id once, and lines that are not taken, with the reason.

    Reasons are those of ``parse_event_lines``, and ``late`` for an event more than ``delay_ms`` behind the newest one of earlier
    triggers.  A trigger owns one folder in each sink and looks back on earlier triggers only as far as the delay, so
    memory does not grow with the stream, and a trigger that runs again writes what it wrote before.  Of lines with one id in a
    trigger the earliest event is taken.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parsed = cut(EV.parse_event_lines(batch.dropDuplicates(["line_id", "line"])).select("line_id", "line", "status"))
        events = EV.event_log(parsed.where("status = 'good'").select(F.col("line_id").alias("event_id"), F.col("line").alias("payload")))
        if batch_id:
            taken = spark.read.parquet(out).where(F.col("batch") < batch_id)
            horizon = taken.agg((F.max("ts") - delay_ms).alias("h")).select("h").scalar()
            events = cut(events.withColumn("_late", F.coalesce(F.col("ts") < horizon, F.lit(False))))
            fresh = events.where("NOT _late").drop("_late").join(taken.where(F.col("ts") >= horizon).select("event_id"), "event_id", "left_anti")
            late = events.where("_late").select(F.col("event_id").alias("line_id")).distinct()
            refused = parsed.where("status = 'good'").join(late, "line_id", "left_semi").withColumn("status", F.lit("late"))
        else:
            fresh, refused = events, parsed.where("false")
        one = top_k(fresh, ["event_id"], [F.asc("ts"), F.xxhash64(*[c for c in fresh.columns if c != "event_id"])], 1).drop("rank")
        one.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        parsed.where("status <> 'good'").unionByName(refused).write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")

    return lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- G12 --------------------------------------------------------------------------------


def usage_by_day(log: DataFrame, store: str, out: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Usage rows per UTC day, kept current.  A trigger appends the state of its own events to their days (``usage.usage_state``) and
    adds up the states of the days it touched; events are read once, and other days' states not at all.

    Rows later than the watermark are dropped before they reach a day.  A day's folder holds one state per trigger, so a
    replayed trigger replaces its own and counts nothing twice.
    """
    def touch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = U.usage_state(A.with_day(batch), ("day",)).withColumn("trigger", F.lit(batch_id))
        _write_days(fresh, store, ["day", "trigger"])
        states = spark.read.parquet(store).withColumns({"day": F.col("day").cast("string")})
        days = states.where(F.col("trigger") == batch_id).select("day").distinct()
        touched = states.where(F.col("trigger") <= batch_id).join(days, "day", "left_semi").drop("trigger")
        rows = U.usage_from_state(cut(U.merge_state(touched, ("day",))), ("day",)).select("day", *U.USAGE_COLS)
        _write_days(rows, out, ["day"])

    return (once_within(log, delay=delay).writeStream.foreachBatch(touch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _write_days(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


# --- G13 -----------------------------------------------------------------------------------


def upsert_stream(rows: DataFrame, store: str, checkpoint: str, apply: Callable[[DataFrame, DataFrame], DataFrame], initial: DataFrame) -> StreamingQuery:
    """``apply(stored, batch)`` per trigger; version ``v`` of the store is the folder ``store/v``.

    A replayed trigger reads the version before it and writes its own again.
    ``apply`` is a batch operator: fact upsert, file index, chunk append or expiry.
    """
    initial.write.mode("overwrite").parquet(f"{store}/v=-1")

    def step(batch: DataFrame, batch_id: int) -> None:
        stored = batch.sparkSession.read.parquet(f"{store}/v={batch_id - 1}")
        apply(stored, batch).write.mode("overwrite").parquet(f"{store}/v={batch_id}")

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark: SparkSession, store: str) -> DataFrame:
    versions = spark.read.option("basePath", store).parquet(store)
    newest = versions.agg(F.max("v").alias("m")).select("m").scalar()
    return versions.where(F.col("v") == newest).drop("v")


# --- G14 --------------------------------------------------------------------------------------


def recall_stream(queries: DataFrame, recall: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Every trigger's queries ranked against a static snapshot; ``recall`` is the batch ranking."""
    def step(batch: DataFrame, batch_id: int) -> None:
        recall(batch).withColumn("trigger", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trigger").parquet(out)

    return queries.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
