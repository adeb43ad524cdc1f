"""Trace tables in and out (A3) and allow-listed export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def import_traces(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows to insert: one per id, ids already stored ignored."""
    first = new.groupBy("trace_id").agg(F.min_by(F.struct(*[c for c in new.columns if c != "trace_id"]), F.struct("created_at", "seq")).alias("r"))
    return first.join(stored.select("trace_id").distinct(), "trace_id", "left_anti").select("trace_id", "r.*")


def export_traces_jsonl(traces: DataFrame, path: str) -> None:
    traces.orderBy("created_at", "trace_id").write.mode("errorifexists").json(path)


def import_traces_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Lines that fit the schema; broken ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def _pick(col: Column, dtype: DataType, spec) -> Column | None:
    if spec is True:
        leaf = not isinstance(dtype, (StructType, MapType)) and not (isinstance(dtype, ArrayType) and isinstance(dtype.elementType, (StructType, ArrayType, MapType)))
        return col if leaf else None
    if isinstance(dtype, ArrayType) and isinstance(dtype.elementType, StructType):
        probe = _fields(F.lit(None), dtype.elementType, spec)
        return F.transform(col, lambda x: F.struct(*_fields(x, dtype.elementType, spec))) if probe else None
    if not isinstance(dtype, StructType):
        return None
    inner = _fields(col, dtype, spec)
    return F.when(col.isNotNull(), F.struct(*inner)) if inner else None


def _fields(col: Column, dtype: StructType, spec: dict) -> list[Column]:
    out = []
    for name, sub in spec.items():
        if name in dtype.fieldNames():
            picked = _pick(col[name], dtype[name].dataType, sub)
            if picked is not None:
                out.append(picked.alias(name))
    return out


def export_allowlisted(df: DataFrame, spec: dict) -> DataFrame:
    """Only the fields named in ``spec`` (True for a leaf, a dict for what is inside); everything else never leaves.

    The projection is built from the schema, so unlisted columns are not even read.
    """
    cols = []
    for name, sub in spec.items():
        if name in df.columns:
            picked = _pick(F.col(name), df.schema[name].dataType, sub)
            if picked is not None:
                cols.append(picked.alias(name))
    return df.select(*cols)
