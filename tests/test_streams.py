"""Ingest of JSON lines: two sinks, repeats, late rows, triggers that run again; folding in blocks of segments."""

import json
import random


from memlens.operators import sequences as Q
from memlens.streaming import jobs as J


def line(ts, event="outcome", **more):
    return json.dumps({"ts": ts, "queryId": "q1", "event": event, "resolved": True, "control": False, **more})


def ingest(spark, folder, files, checkpoint="c", delay_ms=100):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "line_id long, line string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    J.run_available(J.ingest_lines(J.parquet_stream(spark, f"{folder}/in", files_per_trigger=1), f"{folder}/out", f"{folder}/quarantine", f"{folder}/{checkpoint}", delay_ms))


def state(spark, folder):
    good = sorted((r.event_id, r.ts, r.batch) for r in spark.read.parquet(f"{folder}/out").collect())
    return good, sorted((r.line_id, r.status, r.batch) for r in spark.read.parquet(f"{folder}/quarantine").collect())


def test_repeats_late_rows_and_bad_lines(spark, tmp_path):
    files = [[(1, line(1000)), (1, line(1000)), (2, line(990)), (3, "{cut"), (4, line(995, event="unknown")), (5, " ")],
             [(1, line(1000)), (6, line(1300)), (6, line(1250)), (7, line(899)), (8, line(900))],  # horizon 900: 7 is late
             [(9, line(1199)), (10, line(1200)), (6, line(1250)), (11, line(5, resolved="yes"))]]  # newest taken is 1250, horizon 1150
    ingest(spark, str(tmp_path), files)
    good, bad = state(spark, str(tmp_path))
    assert good == [(1, 1000, 0), (2, 990, 0), (6, 1250, 1), (8, 900, 1), (9, 1199, 2), (10, 1200, 2)]
    assert bad == [(3, "bad-json", 0), (4, "invalid", 0), (7, "late", 1), (11, "invalid", 2)]
    ingest(spark, str(tmp_path), [], checkpoint="again")  # every trigger once more over the same sinks
    assert state(spark, str(tmp_path)) == (good, bad)


def test_nothing_but_bad_lines(spark, tmp_path):
    ingest(spark, str(tmp_path), [[(1, "no")], [(2, line(50))]])
    assert state(spark, str(tmp_path)) == ([(2, 50, 1)], [(1, "bad-json", 0)])


def test_chunks_of_a_session_in_many_blocks(spark, monkeypatch):
    """Segments of four turns, blocks of three segments: the walk is the same as one from start to end."""
    monkeypatch.setattr(Q, "BLOCK_SEGMENTS", 3)
    rng = random.Random(4)
    turns = [("s", i, rng.choice([1, 5, 30, 120])) for i in range(300)] + [("t", i, 1) for i in range(5)]
    got = sorted((r.session_id, r.start, r["size"]) for r in Q.chunk_starts(spark.createDataFrame(turns, "session_id string, at long, tokens long"), 5, 100, segment=4).collect())
    want = []
    for session in "st":
        own, at = [t for s, _, t in turns if s == session], 0
        while at < len(own):
            size, total = 0, 0
            while size < 5 and at + size < len(own) and total < 100:
                total += own[at + size]
                size += 1
            want.append((session, at, size))
            at += size
    assert got == sorted(want)




def test_a_table_may_be_a_file_or_a_folder(spark, tmp_path):
    """The named table alone is streamed, as one file or as a folder of files with any names."""
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "other.parquet"))
    spark.range(20).repartition(3).write.parquet(str(tmp_path / "table.parquet"))
    part = next((tmp_path / "other.parquet").glob("part-*"))
    part.rename(tmp_path / "single.parquet")
    for i, file in enumerate(sorted((tmp_path / "table.parquet").glob("part-*"))):
        file.rename(file.with_name(f"piece{i}"))
    for name, rows in (("table.parquet", 20), ("single.parquet", 5)):
        out = str(tmp_path / f"out-{name}")
        J.run_available(J.parquet_stream(spark, str(tmp_path), name).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-c").trigger(availableNow=True).start())
        assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(rows))
