"""Named queries against DuckDB on the smallest given tables.

By default one query per operator family; MEMLENS_ALL=1 runs every one of them
(``python tests/oracle.py <dir>`` does the same on any scale and prints times).
"""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from oracle import compare, duck

from memlens.plans.catalog import registry

SF = os.environ.get("MEMLENS_SF", "/root/testdata/sf0.001")
SHORT = """a1_read_events a2_import_events_jsonl a5_parse_transcripts a7_index_files a8_daily_usage_windows a9_export_allowlisted
b1_tokenize b3_fingerprint b5_scan_leakage b10_intent_key b13_file_symbols b14_normalize_tool_output b15_extract_facts b17_mine_trajectory b18_validate_blocks
c1_bm25_search c3_candidate_filter c4_cosine_topk c5_jaccard_pairs c12_fact_search_no_text c14_chunk_recall c22_pack_budget c24_related_items c25_rank_memories c27_heldout_match
d2_merge_blocks d3_upsert_facts d6_orphan_refs d12_memory_health d18_memory_status
e5_per_block_stats e10_calibration e16_usage_metrics e19_cascade_by_day e26_run_metrics e28_resolve_feedback
f4_bucket_posteriors f6_fit_isotonic f7_predict_isotonic g2_detect_loops g4_pre_call_decisions g6_fold_turns g8_session_digest g11_streaming_loops""".split()
KEYS = sorted(registry()) if os.environ.get("MEMLENS_ALL") else SHORT


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", KEYS)
def test_same_rows_as_duckdb(spark, con, key):
    q = registry()[key]
    assert compare(spark, con, SF, q.run, q.sql) == ""


def test_every_sql_text_has_its_query():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry()) <= set(entry.queries())


def test_keys_are_listed_without_a_session():
    """The entry is imported by processes that have no Spark yet; columns must not be built before a query runs."""
    code = "import __spark_entry__ as e; from pyspark import SparkContext; assert SparkContext._active_spark_context is None; print(*sorted(e.queries()), len(e.oracle_sql()))"
    root = Path(__file__).resolve().parent.parent
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, env=os.environ | {"PYTHONPATH": str(root)})
    assert out.returncode == 0, out.stderr
    *keys, n = out.stdout.split()
    assert set(registry()) <= set(keys) and int(n) > 150
