"""Loop signals of tool calls as they arrive, with state per session (``transformWithState``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from memlens import fixed_values as V

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
INBOX_MS = 60_000
KEPT_KEYS = 64
SCHEMA = "event_id long, session_id string, ts long, pos long, tool_name string, arg_key string, kind string, count int, tool string, logged string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
INPUT = ["event_id", "ts", "tool_name", "arg_key"]


def signals(keys: np.ndarray, tools: np.ndarray, held: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, count, tool) of every call after the first ``held`` ones, each from its last ``n`` keys; null keys equal each other."""
    codes = pd.factorize(keys, use_na_sentinel=False)[0]
    windows = sliding_window_view(np.concatenate([np.full(n - 1, -1), codes]), n)[held:]
    run = np.cumprod(windows[:, ::-1] == windows[:, -1:], axis=1).sum(axis=1)
    counts = (windows[:, :, None] == windows[:, None, :]).sum(axis=2) * (windows >= 0)
    at = (counts * n + np.arange(n)).argmax(axis=1)  # most frequent key, latest place
    most = counts.max(axis=1)
    straight, duplicate = run >= 3, most >= 2
    pingpong = np.zeros(len(windows), dtype=bool)
    if n >= 4:
        a, b = windows[:, -1], windows[:, -2]
        pingpong = (windows[:, -4] >= 0) & (a != b) & (a == windows[:, -3]) & (b == windows[:, -4])
    choose = lambda first, second, third, none: np.select([straight, pingpong, duplicate], [first, second, third], none)
    own = np.arange(held, held + len(windows))
    source = np.where(straight | pingpong, own, own - (n - 1) + at)
    kind = choose("straight", "pingpong", "duplicate", "none").astype(object)
    return kind, choose(run, 2, most, 0), np.where(kind == "none", None, tools[np.maximum(source, 0)])


class LoopState(StatefulProcessor):
    """``recent``: next position, the last ``n - 1`` calls, the first KEPT_KEYS keys with a signal and the session's timer, all in one
    value, since each call to the state store costs more than the walk of a short session; ``warned``: further keys with a
    signal; ``inbox``: rows of one trigger by minute, used while they arrive.

    Rows of a trigger count in (ts, event_id) order.  They come in Arrow batches; one batch is sorted as it is, several go through the
    inbox and are walked minute by minute, so a task holds one batch or one minute of a session and the rest lies in RocksDB.
    """

    def __init__(self, n: int, ttl_ms: int) -> None:
        self.n, self.ttl_ms = n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", "pos long, keys array<string>, tools array<string>, kept array<string>, more boolean, ends long")
        self.warned = handle.getMapState("warned", "arg_key string", "ts long")
        self.inbox = handle.getMapState("inbox", "minute long", "ids array<long>, ts array<long>, tools array<string>, keys array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.pos, keys, tools, kept, self.more, ends = self.recent.get() or (0, [], [], [], False, None)
        self.keys, self.tools, self.kept = list(keys), list(tools), dict.fromkeys(kept)
        newest = None
        for ordered in self._in_order(rows):
            newest = int(ordered[1][-1])
            yield self._judge(key[0], *ordered)
        if newest is None:
            return
        if ends is not None:
            self.handle.deleteTimer(ends)
        ends = max(newest + self.ttl_ms, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(ends)
        self.recent.update((self.pos, self.keys, self.tools, list(self.kept), self.more, ends))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if (self.recent.get() or (False,) * 6)[4]:
            self.warned.clear()
        self.recent.clear()  # the inbox is empty between triggers
        return iter([])

    def close(self) -> None:
        pass

    def _in_order(self, rows: Iterator[pd.DataFrame]) -> Iterator[list[np.ndarray]]:
        batches = (b for b in rows if len(b))
        first, second = next(batches, None), next(batches, None)
        if first is None:
            return
        if second is None:
            yield _ordered([first[c].to_numpy() for c in INPUT])
            return
        minutes = set()
        for batch in _chain(first, second, batches):
            for minute, part in batch.groupby(batch["ts"] // INBOX_MS):
                self._put(int(minute), part)
                minutes.add(int(minute))
        for minute in sorted(minutes):
            ids, ts, tools, keys = self.inbox.getValue((minute,))
            self.inbox.removeKey((minute,))
            yield _ordered([np.array(ids), np.array(ts), np.array(tools, dtype=object), np.array(keys, dtype=object)])

    def _put(self, minute: int, part: pd.DataFrame) -> None:
        new = [part[c].tolist() for c in INPUT]
        if self.inbox.containsKey((minute,)):
            new = [list(old) + more for old, more in zip(self.inbox.getValue((minute,)), new)]
        self.inbox.updateValue((minute,), tuple(new))

    def _judge(self, session: str | None, ids: np.ndarray, times: np.ndarray, own_tools: np.ndarray, own_keys: np.ndarray) -> pd.DataFrame:
        held, n = len(self.keys), len(ids)
        keys, tools = self.keys + own_keys.tolist(), self.tools + own_tools.tolist()
        kind, count, tool = signals(np.array(keys, dtype=object), np.array(tools, dtype=object), held, self.n)
        logged = np.full(n, None, dtype=object)
        flagged = np.nonzero(kind != "none")[0]
        logged[flagged] = "suppressed"
        first = np.unique(pd.factorize(own_keys[flagged], use_na_sentinel=False)[0], return_index=True)[1]
        for place in flagged[np.sort(first)].tolist():  # each key of the batch once
            if self._new(own_keys[place], int(times[place])):
                logged[place] = "warned"
        out = pd.DataFrame({"event_id": ids, "session_id": session, "ts": times, "pos": np.arange(self.pos, self.pos + n), "tool_name": own_tools, "arg_key": own_keys,
                            "kind": kind, "count": count.astype("int32"), "tool": tool, "logged": logged})
        last = self.n - 1
        self.pos, self.keys, self.tools = self.pos + n, keys[-last:] if last else [], tools[-last:] if last else []
        return out[COLUMNS]

    def _new(self, key: str | None, ts: int) -> bool:
        """Whether the session had no signal with this key; it has from now on."""
        if key in self.kept:
            return False
        if len(self.kept) < KEPT_KEYS:
            self.kept[key] = None
            return True
        name = ("-" if key is None else f"+{key}",)
        if self.more and self.warned.containsKey(name):
            return False
        self.warned.updateValue(name, (ts,))
        self.more = True
        return True


def _ordered(columns: list[np.ndarray]) -> list[np.ndarray]:
    order = np.lexsort((columns[0], columns[1]))  # by ts, then event_id
    return [c[order] for c in columns]


def _chain(first: pd.DataFrame, second: pd.DataFrame, rest: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield first
    yield second
    yield from rest


def stream_loops(obs: DataFrame, ttl_ms: int = V.DAY_MS, n: int = V.LOOP_WINDOW, delay: str = "1 hour") -> DataFrame:
    """Loop signal of every call ``(event_id, session_id, ts, tool_name, arg_key)`` from the session's last ``n`` keys, and whether a
    signal is the first of its key (``warned``) or a later one (``suppressed``).

    Rows behind the watermark (``delay``) are dropped.  A session's state ends when the watermark is ``ttl_ms`` past its newest call;
    a call after that starts a new session at position 0.  Needs the RocksDB state store (``loops_to_parquet`` sets it).
    """
    timed = obs.select("event_id", "session_id", "ts", "tool_name", "arg_key", F.timestamp_millis("ts").alias("time")).withWatermark("time", delay)
    return timed.groupBy("session_id").transformWithStateInPandas(LoopState(n, ttl_ms), SCHEMA, "append", "eventTime")


def loops_to_parquet(obs: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """``stream_loops`` appended to Parquet; ``options`` go to it."""
    conf = obs.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKSDB)
    try:  # the setting is read when the query starts
        return (stream_loops(obs, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
                .outputMode("append").trigger(availableNow=True).start())
    finally:
        conf.set(PROVIDER, before)
