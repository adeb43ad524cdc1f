"""The queries of this subpackage, one per operator, with the DuckDB text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlens.llm import decontamination, html, jaccard, language, mixing, pii, quality, repair, runs, sharding, simhash, toxicity, warc
from memlens.llm.common import table


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.tree_of(docs), mixing.source_domain(F.col("source")), 0.5, share=True, max_epochs=2, seed=8)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return runs.digest(runs.find_runs(docs.withColumn("text", runs.with_repeats(F.col("text"), F.col("doc_id")))))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_conversations(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_html_text": op2_html_text,
    "op3_toxicity": op3_toxicity,
    "op4_pii": op4_pii,
    "op5_quality_rules": op5_quality_rules,
    "op6_decontamination": op6_decontamination,
    "op7_warc": op7_warc,
    "op8_mixing": op8_mixing,
    "op9_language": op9_language,
    "op10_sharding": op10_sharding,
    "op11_runs": op11_runs,
    "op12_simhash": op12_simhash,
    "op13_repair": op13_repair,
}
OP8_SQL = """
WITH d AS (SELECT doc_id, greatest(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 1) AS tokens,
        'd' || (coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9])$', 1) AS INT), 0) % 5) AS domain, lang, source FROM documents),
    leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, 2 * sum(tokens)::BIGINT AS capacity, 1.0::DOUBLE AS weight FROM d GROUP BY ALL),
    {levels},
    b AS (SELECT l.domain, l.lang, l.source, l.tokens AS leaf_tokens, floor(s.budget + 1e-6)::BIGINT AS budget FROM leaf l JOIN s3 s
          ON l.domain = s.domain AND l.lang IS NOT DISTINCT FROM s.lang AND l.source IS NOT DISTINCT FROM s.source),
    p AS (SELECT d.*, budget // leaf_tokens AS epochs, budget % leaf_tokens AS rest FROM d JOIN b
          ON d.domain = b.domain AND d.lang IS NOT DISTINCT FROM b.lang AND d.source IS NOT DISTINCT FROM b.source),
    c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('8:' || epochs || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM p)
SELECT doc_id, epochs::INT AS epoch, tokens, domain, lang, source FROM c WHERE upto <= rest
UNION ALL SELECT doc_id, unnest(range(epochs))::INT, tokens, domain, lang, source FROM p WHERE epochs > 0
"""


def _level_sql(depth: int) -> str:
    names = mixing.LEVELS[: depth + 1]
    cols, name, up = ", ".join(names), names[-1], ", ".join(names[:-1])
    part = f"PARTITION BY {up} " if up else ""
    budget = "(SELECT sum(tokens) * 0.5::DOUBLE FROM leaf)" if not depth else "s.budget"
    join = "" if not depth else f" JOIN s{depth} s ON " + " AND ".join(f"n.{c} IS NOT DISTINCT FROM s.{c}" for c in names[:-1])
    return f"""
    n{depth + 1} AS (SELECT {cols}, sum(weight) AS weight, sum(capacity)::BIGINT AS capacity FROM leaf GROUP BY ALL),
    r{depth + 1} AS (SELECT n.*, {budget} AS budget, capacity / weight AS ratio FROM n{depth + 1} n{join}),
    f{depth + 1} AS (SELECT *, ratio <= (budget - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / (sum(weight) OVER ({part}) - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS full_ FROM r{depth + 1}
        WINDOW w AS ({part}ORDER BY ratio, {name})),
    g{depth + 1} AS (SELECT *, budget - coalesce(sum(capacity) FILTER (full_) OVER ({part}), 0) AS spare, coalesce(sum(weight) FILTER (NOT full_) OVER ({part}), 0.0) AS open_ FROM f{depth + 1}),
    s{depth + 1} AS (SELECT {cols}, least(CASE WHEN full_ THEN capacity::DOUBLE ELSE greatest(spare, 0.0) * weight / open_ END, capacity::DOUBLE) AS budget FROM g{depth + 1})"""


OP7_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    m AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest AND payload_bytes >= 100
"""

ORACLE_SQL: dict[str, str] = {"op7_warc": OP7_SQL, "op8_mixing": OP8_SQL.format(levels=",".join(_level_sql(i) for i in range(3)))}
