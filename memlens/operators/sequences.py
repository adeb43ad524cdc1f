"""Sequences of tool calls and turns: loops, call decisions, folding, digests (G operators).

Frames of a few rows are evaluated on chunks of a session with borrowed rows
(``common.with_halo_chunks``); "seen before" questions are answered by joining
with the first time, an aggregate, instead of scanning a session's past.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlens import fixed_values as V
from memlens.common import top_k, with_halo_chunks, with_position
from memlens.functions import text as T
from memlens.functions.tools import intent_key, tool_family

# --- G1..G3 ------------------------------------------------------------------------


def recent_calls(obs: DataFrame, n: int = V.LOOP_WINDOW) -> DataFrame:
    """Last ``n`` calls per session; ``position`` counts from the oldest kept one."""
    last = top_k(obs, ["session_id"], [F.desc("ts"), F.desc("event_id")], n, "_r")
    return last.withColumn("position", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("_r")))).drop("_r")


def observe_batch(calls: DataFrame, most: int = V.BATCH_MAX_CALLS) -> DataFrame:
    """First ``most`` calls of every written batch, in order."""
    return top_k(calls, ["session_id", "batch_id"], [F.asc("batch_order")], most, "kept_order")


def loop_signal(window: Column) -> Column:
    """Struct(kind, count, tool) of a window of struct(key, tool), oldest first.

    A trailing run of three or more is ``straight``; ABAB at the end is
    ``pingpong``; otherwise the most frequent key, the later one on ties, with at
    least two calls is ``duplicate``.
    """
    def judge(w: Column) -> Column:
        n, rev = F.size(w), F.reverse(w)
        at = lambda i: F.try_element_at(rev, F.lit(i))["key"]
        other = F.array_position(F.transform(rev, lambda x: x["key"] == F.element_at(rev, 1)["key"]), False)
        run = F.when(other == 0, n).otherwise(other - 1).cast("int")
        pingpong = (n >= 4) & (at(1) != at(2)) & (at(1) == at(3)) & (at(2) == at(4))
        counts = F.array_max(F.transform(w, lambda x, i: F.struct(F.size(F.filter(w, lambda y: y["key"] == x["key"])).alias("n"), i.alias("i"), x["tool"].alias("tool"))))
        out = lambda kind, count, tool: F.struct(F.lit(kind).alias("kind"), count.alias("count"), tool.alias("tool"))
        none = out("none", F.lit(0), F.lit(None).cast("string"))
        last = F.element_at(rev, 1)["tool"]
        return T.let(counts, lambda c: F.when(n < 2, none).when(run >= 3, out("straight", run, last)).when(pingpong, out("pingpong", F.lit(2), last))
                     .when(c["n"] >= 2, out("duplicate", c["n"], c["tool"])).otherwise(none))
    return T.let(window, judge)


def call_windows(obs: DataFrame, n: int = V.LOOP_WINDOW, semantic: bool = False, rows_per_chunk: int = 20_000) -> DataFrame:
    """Every call with its position and the window of the last ``n`` calls up to it."""
    placed = obs if "pos" in obs.columns else with_position(obs, "session_id", "ts", "event_id")
    key = intent_key(F.col("arg_summary"), F.col("tool_name")) if semantic else F.col("arg_key")
    cut = with_halo_chunks(placed.withColumn("_call", F.struct(key.alias("key"), F.col("tool_name").alias("tool"))), "pos", n - 1, rows_per_chunk)
    frame = W.partitionBy("session_id", "_chunk").orderBy("pos").rowsBetween(-(n - 1), 0)
    return cut.withColumn("window", F.collect_list("_call").over(frame)).where(~F.col("_halo")).drop("_call", "_chunk", "_halo")


def detect_loops(obs: DataFrame, n: int = V.LOOP_WINDOW, semantic: bool = False) -> DataFrame:
    """G2 (and G3 with ``semantic``, where a signal on intent keys overrides the exact one)."""
    w = call_windows(obs, n)
    w = w.withColumn("signal", loop_signal(F.col("window"))).drop("window")
    if semantic:
        i = call_windows(obs, n, semantic=True).select("event_id", loop_signal(F.col("window")).alias("intent_signal"))
        w = w.join(i, "event_id")
        w = w.withColumn("signal", F.when(F.col("intent_signal.kind") != "none", F.col("intent_signal")).otherwise(F.col("signal")))
    return w.select("event_id", "session_id", "ts", "pos", "tool_name", "arg_key", F.col("signal.kind").alias("kind"), F.col("signal.count").alias("count"), F.col("signal.tool").alias("tool"))


# --- G4 ------------------------------------------------------------------------------


def pre_call_decisions(obs: DataFrame, strict: bool = False) -> DataFrame:
    """none / warn / block for every call, from a window of the last six calls plus the current one.

    Read and search calls are blocked in strict mode, or once the same key was
    already warned about in the session; a search whose intent was tried three
    times is blocked too.  The log holds calls as made, so a call that would have
    been blocked still counts in later windows.
    """
    calls = (call_windows(obs, V.LOOP_WINDOW + 1).withColumn("signal", loop_signal(F.col("window"))).drop("window")
             .withColumn("family", tool_family(F.col("tool_name"))))
    search = F.col("family") == "search"
    calls = calls.withColumn("intent", F.when(search, intent_key(F.col("arg_summary"), F.col("tool_name"))))
    warned = calls.where(F.col("signal.kind") != "none").groupBy("session_id", "arg_key").agg(F.min("pos").alias("first_signal"))
    tried = top_k(calls.where(search).select("session_id", "intent", "pos"), ["session_id", "intent"], [F.asc("pos")], V.INTENT_BLOCK_AT)
    third = tried.where(F.col("rank") == V.INTENT_BLOCK_AT).select("session_id", "intent", F.col("pos").alias("third_pos"))
    j = calls.join(warned, ["session_id", "arg_key"], "left").join(third, ["session_id", "intent"], "left")
    safe = F.col("family").isin("read", "search")
    already = F.coalesce(F.col("first_signal") < F.col("pos"), F.lit(False))
    spent = F.coalesce(F.col("third_pos") < F.col("pos"), F.lit(False))
    blocked = spent | (safe if strict else (safe & already))
    seen = F.col("signal.kind") != "none"
    return j.select("event_id", "session_id", "pos", "tool_name", "arg_key", F.col("signal.kind").alias("kind"),
                    F.when(~seen, "none").when(blocked, "block").otherwise("warn").alias("decision"),
                    F.when(seen, F.when(already, "suppressed").otherwise("warned")).alias("logged"))


# --- G5 ------------------------------------------------------------------------------


def loop_redirect(loops: DataFrame, block_hits: DataFrame, file_hits: DataFrame, seen: DataFrame,
                  threshold: float = V.REDIRECT_CONFIDENCE) -> DataFrame:
    """Anchor for every looping call: best block at or above the threshold, else best file, else a fallback reason.

    ``loops(query_id, session_id, arg_key)``; ``block_hits(query_id, block_id,
    prob)``; ``file_hits(query_id, file_id, rank)``; ``seen(session_id, anchor_id, arg_key)``.
    """
    b = block_hits.groupBy("query_id").agg(F.max(F.struct("prob", "block_id")).alias("b"))
    f = file_hits.where(F.col("rank") == 1).groupBy("query_id").agg(F.min("file_id").alias("f"))
    j = loops.join(b, "query_id", "left").join(f, "query_id", "left")
    strong = F.coalesce(F.col("b.prob") >= threshold, F.lit(False))
    anchor = F.when(strong, F.col("b.block_id").cast("string")).otherwise(F.col("f").cast("string"))
    j = j.withColumn("anchor_id", anchor).withColumn("anchor_kind", F.when(strong, "block").when(F.col("f").isNotNull(), "file"))
    j = j.join(seen.select("session_id", "anchor_id", "arg_key").distinct().withColumn("_old", F.lit(True)), ["session_id", "anchor_id", "arg_key"], "left")
    reason = (F.when(F.col("anchor_id").isNull(), F.when(F.col("b").isNotNull(), "low-confidence").otherwise("no-hit")).when(F.col("_old"), "anti-self-loop"))
    ok = reason.isNull()
    return j.select("query_id", "session_id", "arg_key", F.when(ok, F.col("anchor_id")).alias("anchor_id"), F.when(ok, F.col("anchor_kind")).alias("anchor_kind"),
                    F.when(ok, F.when(strong, F.col("b.prob")).otherwise(F.lit(V.REDIRECT_FILE_CONFIDENCE))).alias("confidence"), reason.alias("fallback_reason"))


# --- G6, G7 ----------------------------------------------------------------------------


BLOCK_SEGMENTS = 512


def _entries(seg: DataFrame, width: int) -> DataFrame:
    """(session_id, seg, entry): where each segment is entered when segment 0 is entered at 0; ``exits[e]`` is the next
    segment's entry for entry e < ``width``."""
    def after(maps: Column, start: Column) -> Column:
        return F.aggregate(maps, start, lambda at, m: F.element_at(m["exits"], at + 1))

    def along(maps: Column, start: Column, name: str) -> Column:
        """(name, entry) of every map in order; the array grows to the length of one block."""
        return F.aggregate(maps, F.struct(start.alias("at"), F.array().cast(f"array<struct<{name}:bigint,entry:int>>").alias("out")), lambda acc, m: F.struct(
            F.element_at(m["exits"], acc["at"] + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(m[name].alias(name), acc["at"].alias("entry")))).alias("out")))["out"]

    blocks = seg.withColumn("block", F.floor(F.col("seg") / BLOCK_SEGMENTS)).groupBy("session_id", "block").agg(F.array_sort(F.collect_list(F.struct("seg", "exits"))).alias("maps"))
    blocks = blocks.withColumn("exits", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda e: after(F.col("maps"), e)))
    sessions = blocks.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("block", "exits"))).alias("maps"))  # one entry per BLOCK_SEGMENTS segments
    started = sessions.select("session_id", F.explode(along(F.col("maps"), F.lit(0), "block")).alias("b")).select("session_id", "b.block", "b.entry")
    inside = blocks.select("session_id", "block", "maps").join(started, ["session_id", "block"])
    return inside.select("session_id", F.explode(along(F.col("maps"), F.col("entry"), "seg")).alias("e")).select("session_id", "e.seg", "e.entry")


def chunk_starts(turns: DataFrame, turn_limit: int, token_limit: int, segment: int = 4096) -> DataFrame:
    """(session_id, start, size, complete): where a chunk of at most ``turn_limit`` turns or reaching ``token_limit`` tokens begins.

    ``turns(session_id, at, tokens)`` with dense ``at``.  Each row knows by a short
    frame where a chunk starting there would end, so a session is a walk over
    those jumps.  A segment of rows is reduced to the exit for each of the
    ``turn_limit`` possible entries; exits are composed in two levels, over the
    segments of a block and over a session's blocks; then every segment marks its
    own starts.  No task walks more than one segment or one block, however long the session.
    """
    cut = with_halo_chunks(turns, "at", turn_limit - 1, segment, ahead=True)
    frame = W.partitionBy("session_id", "_chunk").orderBy("at").rowsBetween(0, turn_limit - 1)
    run = F.collect_list("tokens").over(frame)
    cum = F.transform(F.sequence(F.lit(1), F.size("_run")), lambda i: F.aggregate(F.slice("_run", 1, i), F.lit(0).cast("bigint"), lambda a, x: a + x) >= token_limit)
    hit = F.array_position(cum, True)
    size = F.when(hit > 0, hit).otherwise(F.size("_run")).cast("int")
    rows = (cut.withColumn("_run", run).where(~F.col("_halo")).withColumn("size", size)
            .withColumn("complete", (hit > 0) | (F.size("_run") == turn_limit)).select("session_id", F.col("_chunk").alias("seg"), "at", "size", "complete"))
    seg = rows.groupBy("session_id", "seg").agg(F.array_sort(F.collect_list(F.struct("at", "size", "complete"))).alias("jumps"))
    first = F.col("seg") * segment

    def walk_exit(entry: Column) -> Column:
        return F.aggregate("jumps", (first + entry).cast("bigint"), lambda nxt, j: F.when(j["at"] == nxt, nxt + j["size"]).otherwise(nxt)) - first - segment

    exits = F.transform(F.sequence(F.lit(0), F.lit(turn_limit - 1)), lambda e: F.greatest(F.lit(0), walk_exit(e)).cast("int"))
    seg = seg.withColumn("exits", exits)
    entry = _entries(seg.select("session_id", "seg", "exits"), turn_limit)
    marked = seg.join(entry, ["session_id", "seg"]).select("session_id", F.explode(F.aggregate(
        "jumps", F.struct((first + F.col("entry")).cast("bigint").alias("nxt"), F.slice("jumps", 1, 0).alias("got")),
        lambda acc, j: F.when(j["at"] == acc["nxt"], F.struct((acc["nxt"] + j["size"]).alias("nxt"), F.concat(acc["got"], F.array(j)).alias("got"))).otherwise(acc))["got"]).alias("c"))
    return marked.select("session_id", F.col("c.at").alias("start"), "c.size", "c.complete")


def fold_turns(turns: DataFrame, now_ms: int, turn_limit: int = V.CHUNK_TURN_LIMIT, token_limit: int = V.CHUNK_TOKEN_LIMIT, min_tokens: int = V.MIN_CHUNK_TOKENS,
               watermarks: DataFrame | None = None) -> DataFrame:
    """Chunks of every session with summary, hash and expiry, or the reason a chunk is skipped.

    ``watermarks(session_id, watermark)`` resumes behind what was folded before.
    """
    t = turns.select("session_id", F.col("turn").cast("bigint").alias("turn"), "role", F.coalesce("content", F.lit("")).alias("content"))
    if watermarks is not None:
        t = t.join(watermarks, "session_id", "left").where(F.col("turn") > F.coalesce("watermark", F.lit(-1))).drop("watermark")
    t = with_position(t, "session_id", "turn", "turn", "at").withColumn("tokens", T.estimate_tokens(F.col("content")))
    starts = chunk_starts(t.select("session_id", "at", "tokens"), turn_limit, token_limit)
    member = starts.withColumn("at", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)))
    filled = T.trim_ws(F.col("content")) != ""
    text = T.trim_ws(F.col("content"))
    g = t.join(member, ["session_id", "at"]).groupBy("session_id", "start", "complete").agg(
        F.min("turn").alias("chunk_start"), F.max("turn").alias("chunk_end"), F.sum("tokens").alias("tokens_before"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "role", "content"))), lambda r: F.concat(r["role"], F.lit(":"), r["content"])), "\n"), 256).alias("turn_hash"),
        F.min_by(text, F.when(filled & (F.col("role") == "user"), F.col("at"))).alias("asked"),
        F.max_by(text, F.when(filled & (F.col("role") == "assistant"), F.col("at"))).alias("answered"), F.min_by(text, "at").alias("opening"))
    lines = F.concat_ws("\n", F.concat(F.lit("User asked: "), F.col("asked")), F.concat(F.lit("Assistant: "), F.col("answered")))
    g = g.withColumn("_s", F.when(F.col("asked").isNull() & F.col("answered").isNull(), F.col("opening")).otherwise(lines))
    g = g.withColumn("summary", T.clamp_text(F.col("_s"), V.FOLD_SUMMARY_CHARS))
    reason = (F.when(~F.col("complete") & (F.col("tokens_before") < min_tokens), "below-threshold").when(T.leakage(F.col("summary"), core=False).isNotNull(), "leakage")
              .when(T.prompt_injection(F.col("summary")).isNotNull(), "injection"))
    g = g.withColumn("skip_reason", reason)
    return g.select("session_id", "chunk_start", "chunk_end", "turn_hash", "summary", "tokens_before", T.estimate_tokens(F.col("summary")).alias("tokens_after"),
                    F.lit(now_ms + V.CHUNK_TTL_MS).alias("expires_at"), "skip_reason")


def append_chunks(stored: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append: no repeat of (session, turn_hash), stored or within the batch; watermark per session)."""
    key = ["session_id", "turn_hash"]
    ok = new.where(F.col("skip_reason").isNull())
    once = ok.groupBy(*key).agg(F.min("chunk_start").alias("chunk_start"), F.min("chunk_end").alias("chunk_end"))
    fresh = once.join(stored.select(*key).distinct(), key, "left_anti")
    marks = (stored.select("session_id", "chunk_end").unionByName(fresh.select("session_id", "chunk_end")).groupBy("session_id").agg(F.max("chunk_end").alias("watermark")))
    return fresh, marks


# --- G8, G9 -------------------------------------------------------------------------------


def session_digest(turns: DataFrame) -> DataFrame:
    """Last user lines, headings and list-leading bullets of a session, bounded; null when too short or leaking."""
    trimmed = T.trim_ws(F.col("content"))
    meta = T.matches(trimmed, V.TRANSCRIPT_META)
    first = F.trim(F.element_at(F.split(trimmed, "\n"), 1))
    users = turns.where((F.col("role") == "user") & ~meta & F.length(first).between(12, 200)).select("session_id", "turn", F.lit(0).alias("at"), F.lit("user").alias("kind"), first.alias("line"))
    lines = F.transform(F.split(T.strip_code(F.col("content")), "\n"), T.trim_ws)
    said = turns.where("role = 'assistant'").select("session_id", "turn", F.posexplode(F.zip_with(
        lines, F.concat(F.array(F.lit("")), lines), lambda l, before: F.struct(l.alias("line"), before.alias("before")))).alias("at", "x")).where(F.col("x.line").isNotNull())
    head = F.trim(F.regexp_extract("x.line", r"^#{1,4}\s+(.+?)\s*$", 1))
    heads = said.where(F.length(head).between(4, 120)).select("session_id", "turn", "at", F.lit("head").alias("kind"), head.alias("line"))
    is_bullet = lambda c: c.rlike(r"^[-*•]\s+.+$")
    bullet = F.trim(F.regexp_extract("x.line", r"^[-*•]\s+(.+)$", 1))
    first_item = is_bullet(F.col("x.line")) & ~F.coalesce(is_bullet(F.col("x.before")), F.lit(False))
    bullets = said.where(first_item & F.length(bullet).between(10, 180) & ~(bullet.startswith("`") & bullet.endswith("`"))).select(
        "session_id", "turn", "at", F.lit("bullet").alias("kind"), bullet.alias("line"))
    most = max(V.DIGEST_USER_LINES, V.DIGEST_HEADERS, V.DIGEST_BULLETS)
    last = top_k(users.unionByName(heads).unionByName(bullets), ["session_id", "kind"], [F.desc("turn"), F.desc("at")], most)
    keep = F.when(F.col("kind") == "user", V.DIGEST_USER_LINES).when(F.col("kind") == "head", V.DIGEST_HEADERS).otherwise(V.DIGEST_BULLETS)
    section = lambda kind, title: F.concat(F.lit(title + "\n"), F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(F.col("kind") == kind, F.struct("turn", "at", "line")))), lambda r: F.concat(F.lit("- "), r["line"])), "\n"), F.lit("")))
    g = last.where(F.col("rank") <= keep).groupBy("session_id").agg(F.concat_ws(
        "\n\n", section("user", "Recent user questions:"), section("head", "Discussion topics:"), section("bullet", "Key points:")).alias("_d"))
    bounded = F.when(F.length("_d") > V.DIGEST_MAX_CHARS, F.concat(F.substring("_d", 1, V.DIGEST_MAX_CHARS - 1), F.lit("…"))).otherwise(F.col("_d"))
    g = g.withColumn("_b", bounded)
    return g.select("session_id", F.when((F.length("_b") >= 40) & T.leakage(F.col("_b"), core=False).isNull(), F.col("_b")).alias("digest"))


def reuse_window(obs: DataFrame, keep: int = V.REUSE_CACHE_ROWS) -> DataFrame:
    """Intent counts per session over the newest ``keep`` calls of the whole log (a bounded cache)."""
    last = obs.orderBy(F.desc("ts"), F.desc("event_id")).limit(keep)
    return (last.withColumn("intent", intent_key(F.col("arg_summary"), F.col("tool_name"))).groupBy("session_id", "intent")
            .agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")))
