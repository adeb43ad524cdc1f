"""Loop signals on a stream: several triggers, many Arrow batches, sessions that end; rows against a plain walk."""

import random

import numpy as np
import pandas as pd
import pytest

from memlens.operators import sequences as Q
from memlens.streaming import jobs as J
from memlens.streaming import loops as LP

OBS = "event_id long, session_id string, ts long, tool_name string, arg_key string"


def plain(window):
    keys = [k for k, _ in window]
    run = next((i for i, k in enumerate(reversed(keys)) if k != keys[-1]), len(keys))
    if run >= 3:
        return "straight", run, window[-1][1]
    if len(keys) >= 4 and keys[-1] != keys[-2] and keys[-1] == keys[-3] and keys[-2] == keys[-4]:
        return "pingpong", 2, window[-1][1]
    count, at = max((keys.count(k), i) for i, k in enumerate(keys))
    return ("duplicate", count, window[at][1]) if count >= 2 else ("none", 0, None)


def walk(rows, n):
    """Rows of one session in order -> (event_id, pos, kind, count, tool, logged)."""
    window, seen, out = [], set(), []
    for pos, (event_id, _, _, tool, key) in enumerate(rows):
        window = [*window, (key, tool)][-n:]
        kind, count, used = plain(window)
        logged = None if kind == "none" else "suppressed" if key in seen else "warned"
        if logged:
            seen.add(key)
        out.append((event_id, pos, kind, count, used, logged))
    return out


def run(spark, folder, files, **options):
    for rows in files:
        spark.createDataFrame(rows, OBS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = J.parquet_stream(spark, f"{folder}/in", files_per_trigger=1)
    J.run_available(LP.loops_to_parquet(stream, f"{folder}/out", f"{folder}/checkpoint", **options))
    got = {}
    for r in spark.read.parquet(f"{folder}/out").orderBy("ts", "event_id").collect():
        got.setdefault(r.session_id, []).append((r.event_id, r.pos, r.kind, r["count"], r.tool, r.logged))
    return got


@pytest.mark.parametrize("n", [1, 3, 6])
def test_signals_of_whole_windows(n):
    rng = random.Random(n)
    rows = [(i, "s", i, rng.choice("xyz"), rng.choice(["a", "b", None])) for i in range(300)]
    keys, tools = (np.array([r[c] for r in rows], dtype=object) for c in (4, 3))
    want = [w[2:5] for w in walk(rows, n)]
    assert list(zip(*[a.tolist() for a in LP.signals(keys, tools, 0, n)])) == want
    held = n - 1
    assert list(zip(*[a.tolist() for a in LP.signals(keys[100 - held:], tools[100 - held:], held, n)])) == want[100:]


def test_a_session_over_triggers_and_batches(spark, tmp_path):
    """A hot session in three triggers, each in many Arrow batches and out of order; ties in ts; null keys; the same as the batch operator."""
    rng = random.Random(1)
    rows, files = [], []
    for trigger in range(3):
        part = [(trigger * 1000 + i, "hot" if i % 3 else f"s{i % 7}", 10_000_000 + trigger * 3_000_000 + rng.randrange(400) * 5_000, rng.choice(["read", "run"]), rng.choice(["a", "b", "c", "d", None])) for i in range(150)]
        rows += part
        rng.shuffle(part)
        files.append(part)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)
    try:
        got = run(spark, str(tmp_path), files)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    rows.sort(key=lambda r: (r[2], r[0]))
    sessions = {r[1] for r in rows}
    assert got == {s: walk([r for r in rows if r[1] == s], 6) for s in sessions}
    named = [r for r in rows if r[4] is not None]
    batch = {r.event_id: r.kind for r in Q.detect_loops(spark.createDataFrame(named, OBS)).collect()}
    again = run(spark, str(tmp_path / "named"), [[r for r in f if r[4] is not None] for f in files])
    assert batch == {e: kind for out in again.values() for e, _, kind, *_ in out}
    assert spark.conf.get(LP.PROVIDER) != LP.ROCKSDB


def test_a_session_ends(spark, tmp_path):
    """The watermark passes the end of session a in the second trigger, so its call in the third starts anew; b goes on."""
    hour = 3_600_000
    first = [(1, "a", hour, "t", "k"), (2, "a", hour + 1, "t", "k"), (3, "b", 12 * hour, "t", "k")]
    second = [(4, "b", 12 * hour + 1, "t", "k")]
    third = [(5, "a", 12 * hour + 2, "t", "k"), (6, "b", 12 * hour + 3, "t", "k")]
    got = run(spark, str(tmp_path), [first, second, third], ttl_ms=4 * hour)
    assert [(p, k, lg) for _, p, k, _, _, lg in got["a"]] == [(0, "none", None), (1, "duplicate", "warned"), (0, "none", None)]
    assert [(p, k, lg) for _, p, k, _, _, lg in got["b"]] == [(0, "none", None), (1, "duplicate", "warned"), (2, "straight", "suppressed")]


class Store:
    """States of one session in memory; every call to the store is counted."""

    def __init__(self):
        self.calls, self.value, self.maps, self.timers = 0, {}, {}, set()

    def __getattr__(self, name):
        def state(kind, *_):
            return type("State", (), {"__getattr__": lambda _, op: lambda *args: self.call(kind, op, args)})()
        return state if name in ("getValueState", "getMapState") else lambda *args: self.call("timer", name, args)

    def call(self, kind, op, args):
        self.calls += 1
        held = self.maps.setdefault(kind, {})
        return {"get": lambda: self.value.get(kind), "update": lambda v: self.value.update({kind: v}), "containsKey": held.__contains__, "getValue": held.get,
                "updateValue": held.__setitem__, "removeKey": held.pop, "registerTimer": self.timers.add, "deleteTimer": self.timers.discard, "clear": lambda: (held.clear(), self.value.pop(kind, None))}[op](*args)


@pytest.mark.parametrize("keys", [10, 200])
def test_a_short_session_asks_the_store_little(keys):
    """Two triggers of one session; what does not fit the session's one value is kept apart and gives the same rows."""
    rng = random.Random(keys)
    rows = [(i, "s", i // 2, rng.choice(["read", "run"]), rng.choice([f"k{rng.randrange(keys)}", None])) for i in range(1200)]
    store, now = Store(), type("Timer", (), {"getCurrentWatermarkInMs": lambda self: 0})()
    loops = LP.LoopState(6, 1000)
    loops.init(store)
    got = []
    for part in (rows[:600], rows[600:]):
        frame = pd.DataFrame(rng.sample(part, len(part)), columns=[c.split()[0] for c in OBS.split(", ")])
        for out in loops.handleInputRows(("s",), iter([frame]), now):
            got += [tuple(None if v is None else v for v in r) for r in out[["event_id", "pos", "kind", "count", "tool", "logged"]].itertuples(index=False)]
    assert got == walk(rows, 6) and len(store.timers) == 1
    assert store.calls <= 7 if keys == 10 else store.maps["warned"]
    list(loops.handleExpiredTimer(("s",), now, None))
    assert not store.maps["warned"] and not store.value if keys == 200 else not store.value
