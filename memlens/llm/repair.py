"""Repair of conversation structure by a parallel Viterbi with rank convergence.

A conversation is well formed if its role initials read `(s?(ua)+)?`.  Edits: keep a row (0), give it the role user or
assistant (2), delete it (3), insert an empty user or assistant row anywhere (2); a truncated row that stays costs 1 more;
blank rows and repeats must go.  The cheapest edits are wanted, and of these the least string of initials (D < I < K < R).

The costs still to come at a row, one per state of the grammar (start, after s, after u, after a), are a vector; a row turns
the vector behind it into the one before it.  Rows are cut into pieces that Spark works on side by side:

1. every piece runs backward from a speculative vector (that of a conversation's end);
2. fix-up passes: a piece whose speculation differs from what the piece behind it now says runs again, until its vector
   equals the earlier run's up to a constant; from there on the earlier run holds.  Passes go on until no piece differs;
3. every piece tells for each of the four states at its start in which one it ends; these maps are chained along a
   conversation, which gives each piece its true start;
4. every piece traces its edits from there: first letter in D, I, K, R whose cost plus the cost behind it is the cost here.

Vectors are kept less their minimum, so "equal up to a constant" is equality, and the constants, which no choice
depends on, need no stitching beyond that.  A row that must go leaves the vector as it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlens.session import cut

PIECE_BITS = 12
START, SYSTEM, USER, ASSISTANT = range(4)
OTHER = 0
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NEXT_ROLE = (USER, USER, ASSISTANT, USER)  # what may be inserted, or a role given, in each state; also the state it leads to
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEEPS = {(START, SYSTEM): SYSTEM, (START, USER): USER, (SYSTEM, USER): USER, (ASSISTANT, USER): USER, (USER, ASSISTANT): ASSISTANT}
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
END = (0, 4, 2, 0)
TRUNCATED_BIT, GONE_BIT = 4, 8
Vector = tuple[int, ...]


@cache
def _costs(after: Vector, code: int) -> Vector:
    """Costs before a row with this code, given those behind it."""
    role, extra = code & 3, TRUNCATED * bool(code & TRUNCATED_BIT)
    out = []
    for state in range(4):
        ways = [DELETE + after[state], RENAME + extra + after[NEXT_ROLE[state]]]
        if (state, role) in KEEPS:
            ways.append(extra + after[KEEPS[state, role]])
        out.append(min(ways))
    for _ in range(2):  # three inserts in a row never pay
        out = [min(c, INSERT + out[NEXT_ROLE[state]]) for state, c in enumerate(out)]
    return tuple(out)


@cache
def before(after: Vector, code: int) -> Vector:
    if code & GONE_BIT:
        return after
    costs = _costs(after, code)
    low = min(costs)
    return tuple(c - low for c in costs)


def backward(codes: bytes, after: Vector) -> Vector:
    for code in reversed(codes):
        after = before(after, code)
    return after


def rerun(codes: bytes, old: Vector, old_out: Vector, new: Vector) -> Vector:
    """The vector before the piece when ``new`` stands behind it, from the run that assumed ``old``."""
    for code in reversed(codes):
        if old == new:
            return old_out
        old, new = before(old, code), before(new, code)
    return new


@cache
def choose(after: Vector, code: int, state: int) -> tuple[str, int, int, int]:
    """(letters, state behind the row, role kept or given or OTHER if the row goes, cost) of the least cheapest edits."""
    if code & GONE_BIT:
        return "D", state, OTHER, DELETE
    costs, extra, letters, paid = _costs(after, code), TRUNCATED * bool(code & TRUNCATED_BIT), "", 0
    while True:
        if DELETE + after[state] == costs[state]:
            return letters + "D", state, OTHER, paid + DELETE
        if INSERT + costs[NEXT_ROLE[state]] == costs[state]:
            letters, paid, state = letters + "I", paid + INSERT, NEXT_ROLE[state]
            continue
        kept = KEEPS.get((state, code & 3))
        if kept is not None and extra + after[kept] == costs[state]:
            return letters + "K", kept, kept, paid + extra
        return letters + "R", NEXT_ROLE[state], NEXT_ROLE[state], paid + RENAME + extra


def vectors(codes: bytes, after: Vector) -> list[Vector]:
    """The vector behind each row."""
    out = [after] * len(codes)
    for i in range(len(codes) - 1, 0, -1):
        out[i - 1] = before(out[i], codes[i])
    return out


def packed(v: Vector) -> int:
    return int.from_bytes(bytes(v), "little")


def unpacked(v: int) -> Vector:
    return tuple(v.to_bytes(4, "little"))


def _speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the assumed vector behind each piece, the one before it and the illegal neighbours inside it."""
    for batch in batches:
        codes = [bytes(x) for x in batch.column("codes").to_pylist()]
        copies = batch.column("copies").to_pylist()
        out = [packed(backward(c, END)) for c in codes]
        illegal = [sum((x & 3, y & 3) not in LEGAL for x, y in zip(c[:-1], c[1:], strict=True)) + sum(n) - len(n) for c, n in zip(codes, copies, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([packed(END)] * len(out), pa.int64()), pa.array(out, pa.int64()), pa.array(illegal, pa.int64())],
                                         [*batch.schema.names, "behind", "ahead", "illegal"])


def _fix_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ahead = [rerun(bytes(c), unpacked(o), unpacked(x), unpacked(n)) for c, o, x, n in zip(*(batch.column(k).to_pylist() for k in ("codes", "behind", "ahead", "said")), strict=True)]
        columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"behind": batch.column("said"), "ahead": pa.array([packed(v) for v in ahead], pa.int64())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, chunk, end state for each start state, first and last role)."""
    for batch in batches:
        ends, first, last = [], [], []
        for codes, behind in zip(batch.column("codes").to_pylist(), batch.column("behind").to_pylist(), strict=True):
            states = list(range(4))
            for code, after in zip(codes, vectors(bytes(codes), unpacked(behind)), strict=True):
                states = [choose(after, code, s)[1] for s in states]
            ends.append(packed(tuple(states)))
            first.append(codes[0] & 3)
            last.append(codes[-1] & 3)
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), *(pa.array(x, pa.int64()) for x in (ends, first, last))], ["conv", "chunk", "ends", "first", "last"])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (conv, chunk) to (conv, chunk, state at the start, illegal pair at the seam)."""
    conv, state, role = None, START, OTHER
    for batch in batches:
        states, seams = [], []
        for c, ends, first, last in zip(*(batch.column(k).to_pylist() for k in ("conv", "ends", "first", "last")), strict=True):
            seams.append(int(c == conv and (role, first) not in LEGAL))
            state = state if c == conv else START
            states.append(state)
            conv, state, role = c, unpacked(ends)[state], last
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), pa.array(states, pa.int64()), pa.array(seams, pa.int64())], ["conv", "chunk", "state", "seam"])


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces to (conv, chunk, audit, cost, rows that stay or are inserted)."""
    line = pa.struct([("at", pa.int64()), ("sub", pa.int32()), ("role", pa.string()), ("renamed", pa.bool_()), ("inserted", pa.bool_())])
    for batch in batches:
        audits, costs, lines = [], [], []
        for codes, copies, places, behind, state, last in zip(*(batch.column(k).to_pylist() for k in ("codes", "copies", "places", "behind", "state", "ends_here")), strict=True):
            audit, cost, rows = [], 0, []
            for code, n, at, after in zip(codes, copies, places, vectors(bytes(codes), unpacked(behind)), strict=True):
                letters, then, role, paid = choose(after, code, state)
                for i in range(len(letters) - 1):
                    state = NEXT_ROLE[state]
                    rows.append({"at": at, "sub": i - len(letters), "role": NAMES[state], "renamed": False, "inserted": True})
                if role:
                    renamed = letters[-1] == "R"
                    rows.append({"at": at, "sub": 0, "role": NAMES[role] if renamed else None, "renamed": renamed, "inserted": False})
                state = then
                audit.append(letters + "D" * (n - 1))
                cost += paid + DELETE * (n - 1)
            while last and END[state]:
                state = NEXT_ROLE[state]
                rows.append({"at": places[-1], "sub": len(audit) + 1, "role": NAMES[state], "renamed": False, "inserted": True})
                audit.append("I")
                cost += INSERT
            audits.append("".join(audit))
            costs.append(cost)
            lines.append(rows)
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), pa.array(audits, pa.string()), pa.array(costs, pa.int64()), pa.array(lines, pa.list_(line))],
                                         ["conv", "chunk", "audit", "cost", "lines"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and place to one SHA-256 each; holds one batch and one hash state."""
    conv, sha, done = None, None, []
    for batch in batches:
        for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv", "role", "text")), strict=True):
            if c != conv:
                if sha is not None:
                    done.append((conv, sha.hexdigest()))
                conv, sha = c, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done, strict=True)], ["conv", "sha"])
            done = []
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), pa.array([sha.hexdigest()], pa.string())], ["conv", "sha"])


def _key(conv: Column) -> Column:
    return F.when(conv.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), conv.cast("string")))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by crc32(`conv_id:turn`) % 20, where nulls count as one space.

    0 drops the row, 1 empties its text, 2 takes its sentence ends away, 3 repeats it, 4 gives it to the user.
    """
    text = F.coalesce("text", F.lit(" "))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.encode(F.concat(blank("conv_id"), F.lit(":"), blank("turn")), "UTF-8")), F.lit(20))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"), kind.alias("_kind")).where("_kind <> 0").drop("_kind")


class Repair:
    """The cheapest repair of every conversation in ``rows(conv_id, turn, role, text, copies)``; no column null but the first two.

    Rows go by turn, nulls first; rows of one turn by role and SHA-256 of the text.  Equal rows are one with a count before
    anything else, and texts stay out of the search.  A piece is at most 2**PIECE_BITS rows of one conversation, so a
    conversation of any length is spread out; a null conversation id is a conversation.

    ``pieces``: audit, cost and fault counts by (conv, chunk).  ``lines()``: the repaired rows.  ``summary()``: one row a conversation.
    """

    def __init__(self, rows: DataFrame):
        text = F.col("text")
        rows = rows.withColumn("conv", _key(F.col("conv_id")))
        self.texts = rows.select("conv", "turn", "role", "text", F.sha2(F.encode(text, "UTF-8"), 256).alias("digest"))
        is_blank = ~text.rlike(r"[^\x20\x09-\x0D]")
        light = rows.select("conv", "turn", "role", F.sha2(F.encode(text, "UTF-8"), 256).alias("digest"), is_blank.alias("blank"),
                            (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"), "copies")
        light = light.groupBy("conv", "turn", "role", "digest", "blank", "open").agg(F.sum("copies").alias("n"))
        order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
        self.ordered = cut(light.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
        self.pieces = self._solved()

    def _coded(self) -> DataFrame:
        turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
        seen = (self.ordered.where("NOT blank").groupBy("conv", "role", "digest").agg(F.min(turn).alias("seen"), F.count("*").alias("turns"))
                .where("turns > 1").select("conv", "role", "digest", "seen"))
        rows = self.ordered.join(seen, ["conv", "role", "digest"], "left")
        later = F.coalesce(turn > F.col("seen"), F.lit(False))
        initial = F.substring("role", 1, 1)
        role = F.lit(OTHER)
        for letter, code in INITIALS.items():
            role = F.when(initial == letter, code).otherwise(role)
        gone = F.col("blank") | later
        cut_off = F.col("open") & ~gone
        return rows.select(
            "conv", F.shiftright("at", PIECE_BITS).alias("chunk"), "at", "n", (role + F.when(cut_off, TRUNCATED_BIT).otherwise(0) + F.when(gone, GONE_BIT).otherwise(0)).cast("byte").alias("code"),
            F.when(F.col("blank"), F.col("n")).otherwise(0).alias("blanks"), F.when(F.col("blank"), 0).when(later, F.col("n")).otherwise(F.col("n") - 1).alias("repeats"), cut_off.cast("long").alias("cut_off"), "turn")

    def _solved(self) -> DataFrame:
        packs = self._coded().groupBy("conv", "chunk").agg(
            F.array_sort(F.collect_list(F.struct("at", "code", "n"))).alias("rows"), F.sum("blanks").alias("blank"), F.sum("repeats").alias("duplicate"), F.sum("cut_off").alias("truncated"))
        along = W.partitionBy("conv").orderBy("chunk")
        packs = packs.select("conv", "chunk", "blank", "duplicate", "truncated", F.col("rows.code").alias("codes"), F.col("rows.n").alias("copies"), F.col("rows.at").alias("places"),
                             F.lead("chunk").over(along).isNull().alias("ends_here"), F.lag("chunk").over(along).isNull().alias("starts_here"))
        schema = packs.schema.simpleString()[7:-1]
        pieces = cut(packs.mapInArrow(_speculate, f"{schema},behind:bigint,ahead:bigint,illegal:bigint"))
        whole = pieces.where("ends_here AND starts_here")
        parts = self._converged(pieces.where("NOT (ends_here AND starts_here)"))
        heads = parts.mapInArrow(_exits, "conv string, chunk long, ends long, first long, last long")
        entry = heads.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(_chain, "conv string, chunk long, state long, seam long")
        ready = whole.withColumns({"state": F.lit(START).cast("long"), "seam": F.lit(0).cast("long")}).unionByName(parts.join(entry, ["conv", "chunk"]))
        traced = ready.select("conv", "chunk", "codes", "copies", "places", "behind", "state", "ends_here").mapInArrow(
            _trace, "conv string, chunk long, audit string, cost long, lines array<struct<at:bigint,sub:int,role:string,renamed:boolean,inserted:boolean>>")
        return cut(traced.join(ready.select("conv", "chunk", "blank", "duplicate", "truncated", (F.col("illegal") + F.col("seam")).alias("illegal")), ["conv", "chunk"]))

    def _converged(self, parts: DataFrame) -> DataFrame:
        """Fix-up passes; a pass can settle one more piece of a conversation at least, and mostly settles all."""
        said = F.coalesce(F.lead("ahead").over(W.partitionBy("conv").orderBy("chunk")), F.lit(packed(END)))
        self.passes = 0
        while True:
            told = cut(parts.withColumn("said", said))
            wrong = told.where("said <> behind")
            if wrong.isEmpty():
                return told.drop("said")
            self.passes += 1
            fixed = wrong.mapInArrow(_fix_up, told.schema)
            parts = told.where("said = behind").unionByName(fixed).drop("said")

    def lines(self) -> DataFrame:
        """(conv, at, sub, role, text, edit): the repaired rows in (at, sub) order; inserted ones have an empty text."""
        made = self.pieces.select("conv", F.explode("lines").alias("l")).select("conv", "l.*").withColumnRenamed("role", "new_role")
        inserted = made.where("inserted").select("conv", "at", "sub", F.col("new_role").alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit"))
        kept = made.where("NOT inserted").join(self.ordered.select("at", "turn", "role", "digest"), "at")
        texts = self.texts.groupBy("conv", "turn", "role", "digest").agg(F.min("text").alias("text")).withColumnRenamed("conv", "c").withColumnRenamed("turn", "t")
        same = (F.col("conv") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
        found = kept.alias("k").join(texts.alias("x"), same & (F.col("k.role") == F.col("x.role")) & (F.col("k.digest") == F.col("x.digest")))
        return found.select("conv", "at", "sub", F.coalesce("new_role", "k.role").alias("role"), "text", F.when(F.col("renamed"), "R").otherwise("K").alias("edit")).unionByName(inserted)

    def summary(self) -> DataFrame:
        """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of conversations that have rows."""
        turns = self.ordered.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
        parts = self.pieces.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
                                                F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda p: p["audit"]), "").alias("audit"))
        return parts.join(turns, "conv").withColumn("gaps", F.coalesce("gaps", F.lit(0)).cast("long"))


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conv_id, null too, after ``damaged``.

    Conversations without rows after damage: zeros, an empty audit, the hash of the empty string.  Other columns are ignored; an
    empty table gives an empty result.  The hash reads a conversation's repaired rows in order, one batch at a time.
    """
    source = conversations.select("conv_id", "turn", "role", "text")
    repair = Repair(damaged(source))
    lines = repair.lines().repartition("conv").sortWithinPartitions("conv", "at", "sub").select("conv", "role", "text")
    hashes = lines.mapInArrow(_digests, "conv string, sha string")
    ids = source.select("conv_id").distinct().withColumn("conv", _key(F.col("conv_id")))
    out = ids.join(repair.summary(), "conv", "left").join(hashes, "conv", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
