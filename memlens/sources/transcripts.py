"""Transcript lines -> turns (A5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlens import fixed_values as V
from memlens.functions import text as T

_PARTS = "type string, message struct<role: string, content: string>"


def parse_transcripts(lines: DataFrame) -> DataFrame:
    """``lines(session_id, line_no, line)`` -> (session_id, line_no, role, content).

    User lines with plain text that are not meta tags; assistant lines with their
    text parts only.  Lines that do not parse are left out.
    """
    e = lines.withColumn("e", F.from_json("line", _PARTS)).withColumn("kind", F.schema_of_variant(F.try_variant_get(F.try_parse_json("line"), "$.message.content", "variant")))
    body = F.col("e.message.content")
    user = T.trim_ws(body)
    parts = F.from_json(body, "array<struct<type: string, text: string>>")
    texts = F.transform(F.filter(parts, lambda p: (p["type"] == "text") & (T.trim_ws(p["text"]) != "")), lambda p: p["text"])
    is_user = (F.col("e.type") == "user") & (F.col("kind") == "STRING") & (user != "") & ~T.matches(user, V.TRANSCRIPT_META)
    is_said = (F.col("e.type") == "assistant") & F.col("kind").startswith("ARRAY") & (F.size(texts) > 0)
    return e.select("session_id", "line_no", F.when(is_user, "user").when(is_said, "assistant").alias("role"),
                    F.when(is_user, user).when(is_said, T.trim_ws(F.array_join(texts, "\n"))).alias("content")).where(F.col("role").isNotNull())
