"""Registry of the named queries: a Spark callable and, where SQL can say it, a DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


Registry = dict[str, Query]


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded so that both engines print the same value."""
    return df.select(*[F.round(F.col(f"`{n}`"), places).alias(n) if t in ("double", "float") else F.col(f"`{n}`")
                       for n, t in df.dtypes])


@cache
def registry() -> Registry:
    from memlens.plans import (event_queries, learning_queries, maintenance_queries, retrieval_queries,
                               sequence_queries, source_queries, streaming_queries, text_queries)
    out: Registry = {}
    for module in (source_queries, text_queries, retrieval_queries, maintenance_queries, event_queries,
                   learning_queries, sequence_queries, streaming_queries):
        out.update(module.QUERIES)
    return out
