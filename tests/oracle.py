"""Run named queries in Spark and in DuckDB and compare rows (used by the tests and by hand).

    python tests/oracle.py [sf_dir] [key-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 6) + 0.0
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf, run, sql):
    """Empty string when equal, else a short report."""
    df = run(spark, sf)
    got_cols, got = canon(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if got else "no rows"
    rel = con.execute(sql)
    want_cols, want = canon([d[0] for d in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return f"rows {len(got)} != {len(want)}; only spark {extra}; only sql {missing}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, cols {got_cols}: spark {bad[0][0]} sql {bad[0][1]}" if bad else ("" if got else "EMPTY")


def main():
    from memlens.plans.catalog import registry
    from memlens.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark, con = local_session(8), duck(sf)
    failed = 0
    for key, q in registry().items():
        if wanted and not any(key == w or key.startswith(w + "_") or (w.endswith("*") and key.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        try:
            msg = compare(spark, con, sf, q.run, q.sql)
        except Exception as e:  # report and go on
            msg = f"{type(e).__name__}: {str(e)[:700]}"
        failed += bool(msg)
        print(f"{'ok  ' if not msg else 'FAIL'} {key} {time.time() - t:.1f}s {msg[:1000]}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
