"""Conversation structure repair by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows consumed, last role given); edges keep, rerole, delete or insert a turn.
One heap grows from the start, one from the end, each in order of cost and then of rows, so that a
node is final when it is taken. They stop when no meeting can be as cheap any more; all crossings
of the least cost are then compared and the ASCII-least audit is kept. Two audits of equal
cost that end in the same node are never prefixes of one another (the longer would only insert after it),
so the least prefix and the least suffix of a node are all that it needs.

Spark does the rest on narrow rows (digests in place of texts): faults by grouping, order by a range
partitioning over (conversation, turn, role, digest), so a conversation of any length is spread over
tasks. Each task solves segments of at most ``SEGMENT`` rows; a segment that may be part of a longer
conversation is solved for every role before and after it, and the segments of a conversation are
chained in order. The repaired text is hashed from a stream of the rows next to their audit; only this digest
needs the rows of one conversation one after another, never together.

Defined results
* A null text or role is one space; a null conversation id or turn is one space in the damage key. Null turns come first.
* Rows of one turn go by role, then by the MD5 of their text, after damage; repeated rows stay side by side and count as duplicates.
* A role's initial is its first character; roles that begin with none of s, u, a must be reroled or deleted.
* An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from haptrace.session import cut_lineage

SEGMENT = 1024
DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
# Last role given: nothing yet, system, user, assistant.
NONE, S, U, A = range(4)
FOLLOWS = {NONE: (S, U), S: (U,), U: (A,), A: (U,)}
PRECEDES = {S: (NONE,), U: (NONE, S, A), A: (U,)}
ROLE_OF = {"s": S, "u": U, "a": A}
ACCEPTED = (NONE, A)


def _steps_out(rows: str, i: int, role: int) -> Iterator[tuple[int, str, int, int]]:
    """(cost, edit, i, role) of the edges out of a node."""
    for after in FOLLOWS[role]:
        if after != S:
            yield COST[INSERT], INSERT, i, after
    if i < len(rows):
        row = rows[i]
        yield COST[DELETE], DELETE, i + 1, role
        if row != "-":
            late = row.isupper()
            for after in FOLLOWS[role]:
                if ROLE_OF.get(row.lower()) == after:
                    yield COST[KEEP] + late, KEEP, i + 1, after
                if after != S:
                    yield COST[REROLE] + late, REROLE, i + 1, after


def _steps_in(rows: str, i: int, role: int) -> Iterator[tuple[int, str, int, int]]:
    """(cost, edit, i, role) of the edges into a node."""
    before = PRECEDES.get(role, ())
    if role in (U, A):
        for earlier in before:
            yield COST[INSERT], INSERT, i, earlier
    if i:
        row = rows[i - 1]
        yield COST[DELETE], DELETE, i - 1, role
        if row != "-":
            late = row.isupper()
            for earlier in before:
                if ROLE_OF.get(row.lower()) == role:
                    yield COST[KEEP] + late, KEEP, i - 1, earlier
                if role != S:
                    yield COST[REROLE] + late, REROLE, i - 1, earlier


@lru_cache(maxsize=20_000)
def least_edits(rows: str, entry: int = NONE, exits: tuple[int, ...] = ACCEPTED) -> tuple[int, str] | None:
    """Least cost and its ASCII-least audit from role ``entry`` to one of ``exits``; None if there is no way.

    ``rows`` has one letter a row: s, u, a or x (any other role), capital if the row is truncated, - if it must go.
    """
    n = len(rows)
    # Node to (cost, audit), open and final, for both directions.
    open_f, open_b = {(0, entry): (0, "")}, {(n, role): (0, "") for role in exits}
    done_f: dict[tuple[int, int], tuple[int, str]] = {}
    done_b: dict[tuple[int, int], tuple[int, str]] = {}
    heap_f, heap_b = [(0, 0, entry)], [(0, -n, role) for role in exits]
    heapq.heapify(heap_b)
    best = None

    def meet(cost: int, audit: str) -> None:
        nonlocal best
        if best is None or (cost, audit) < best:
            best = cost, audit

    while heap_f and heap_b and (best is None or heap_f[0][0] + heap_b[0][0] <= best[0]):
        forward = heap_f[0][0] <= heap_b[0][0]
        heap, opened, done, others = (heap_f, open_f, done_f, done_b) if forward else (heap_b, open_b, done_b, done_f)
        cost, at, role = heapq.heappop(heap)
        node = abs(at), role
        if node in done or opened[node][0] < cost:
            continue
        audit = opened[node][1]
        done[node] = cost, audit
        if node in others:
            rest = others[node]
            meet(cost + rest[0], audit + rest[1] if forward else rest[1] + audit)
        for step, edit, i, after in (_steps_out if forward else _steps_in)(rows, *node):
            there = i, after
            reached = cost + step, audit + edit if forward else edit + audit
            if there in others:
                rest = others[there]
                meet(reached[0] + rest[0], reached[1] + rest[1] if forward else rest[1] + reached[1])
            if there not in done and (there not in opened or reached < opened[there]):
                if there not in opened or reached[0] < opened[there][0]:
                    heapq.heappush(heap, (reached[0], i if forward else -i, after))
                opened[there] = reached
    return best


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) after the damage that the key asks for; a repeated row appears twice."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))
    hit = F.crc32(F.encode(key, "UTF-8")) % 20
    text, role = F.coalesce(F.col(text_col).cast("string"), space), F.coalesce(F.col(role_col).cast("string"), space)
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), hit.alias("hit"))
    return rows.filter("hit != 0").select(
        "conv", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))


def digest(text: str | Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, letter, copies, first): different rows with the letter of ``least_edits`` for their first copy."""
    text = F.col("text")
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    letter = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    marked = rows.select("conv", "turn", "role", digest("text").alias("digest"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("late"), letter.alias("letter"))
    keys = ["conv", "turn", "role", "digest"]
    merged = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.first("blank").alias("blank"), F.first("late").alias("late"), F.first("letter").alias("letter"))
    # Null turns come before all others, as the struct's order has it.
    first = merged.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("head"))
    a, b = merged.alias("a"), first.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("conv", "role", "digest")]
    joined = a.join(b, same[0] & same[1] & same[2]).select("a.*", F.col("a.turn").eqNullSafe(F.col("b.head.turn")).alias("first"))
    code = F.when(F.col("blank") | ~F.col("first"), "-").when(F.col("late"), F.upper("letter")).otherwise(F.col("letter"))
    return joined.select(*keys, "copies", "first", "blank", "late", "letter", code.alias("code"))


SEGMENT_SCHEMA = ("conv {conv}, part int, seq int, rows bigint, whole boolean, costs array<int>, audits array<string>, blank bigint, duplicate bigint, truncated bigint, "
                  "illegal bigint, first_letter string, last_letter string, turns bigint, first_turn bigint, last_turn bigint")
LEGAL = {"su", "ua", "au"}


class Segment:
    """Rows of one conversation in one task, in order."""

    def __init__(self):
        self.codes: list[str] = []
        self.size = 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.letters = ["", ""]
        self.ends: list[int | None] = [None, None]

    def add(self, turn: int | None, copies: int, first: bool, blank: bool, late: bool, letter: str, code: str) -> None:
        self.codes.append(code + "-" * (copies - 1))
        self.size += copies
        self.blank += copies if blank else 0
        self.duplicate += 0 if blank else copies - first
        self.truncated += bool(first and not blank and late)
        pair = self.letters[1] + letter
        self.illegal += (len(pair) == 2 and pair not in LEGAL) + (copies - 1 if 2 * letter not in LEGAL else 0)
        self.letters = [self.letters[0] or letter, letter]
        if turn is not None:
            self.turns += turn != self.ends[1]
            self.ends = [turn if self.ends[0] is None else self.ends[0], turn]

    def solved(self, whole: bool) -> tuple[list[int | None], list[str | None], int]:
        rows = "".join(self.codes)
        ways = [least_edits(rows)] if whole else [least_edits(rows, entry, (leave,)) for entry in range(4) for leave in range(4)]
        return [w and w[0] for w in ways], [w and w[1] for w in ways], len(rows)


def segments(found: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Solved segments; ``whole`` if the task saw the conversation from before its first to beyond its last row."""
    conv = found.schema["conv"].dataType.simpleString()
    order = ["conv", "turn", "role", "digest"]
    ranged = found.repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["conv", "turn", "copies", "first", "blank", "late", "letter", "code"]
    columns = [c.split(" ")[0] for c in SEGMENT_SCHEMA.format(conv="x").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, at, seq, opening = Segment(), None, 0, True
        out: list[tuple] = []

        def close(conv, whole: bool) -> None:
            nonlocal held
            costs, audits, rows = held.solved(whole)
            out.append((conv, part, seq, rows, whole, costs, audits, held.blank, held.duplicate, held.truncated, held.illegal,
                        held.letters[0], held.letters[1], held.turns, *held.ends))
            held = Segment()

        def batch_of(schema: pa.Schema) -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return made

        schema = None
        for batch in batches:
            if schema is None:
                schema = segment_arrow(batch.schema.field("conv").type, columns)
            for conv, *row in zip(*(batch.column(c).to_pylist() for c in names)):
                turn, copies, first, blank, late, letter, code = row
                while copies:
                    if held.codes and conv != at:
                        # The task's first conversation may have begun in another task.
                        close(at, seq == 0 and not opening)
                        opening, seq = False, 0
                    elif held.size >= segment:
                        close(at, False)
                        seq += 1
                    at, some = conv, min(copies, segment)
                    held.add(turn, some, first, blank, late, letter, code)
                    # What is left of a row that repeats very often goes on as copies.
                    copies, first, code = copies - some, False, "-"
                    if len(out) >= 1000:
                        yield batch_of(schema)
        if held.codes:
            close(at, False)
        if out:
            yield batch_of(schema)

    return ranged.select(*names).mapInArrow(run, SEGMENT_SCHEMA.format(conv=conv))


def segment_arrow(conv: pa.DataType, columns: list[str]) -> pa.Schema:
    kinds = {"conv": conv, "part": pa.int32(), "seq": pa.int32(), "whole": pa.bool_(), "costs": pa.list_(pa.int32()), "audits": pa.list_(pa.string()),
             "first_letter": pa.string(), "last_letter": pa.string()}
    return pa.schema([(c, kinds.get(c, pa.int64())) for c in columns])


REPORT = "conv {conv}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def chained(parts: DataFrame) -> DataFrame:
    """(conv, gaps, ..., cost, audit) per conversation, from its segments in order."""
    conv_type = parts.schema["conv"].dataType.simpleString()
    dealt = parts.repartition("conv").sortWithinPartitions("conv", "part", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = at = None
        out: list[tuple] = []
        kind = None

        def close() -> None:
            ways, sums, ends, turns = state["ways"], state["sums"], state["ends"], state["turns"]
            cost, audit = min(ways[r] for r in ACCEPTED if r in ways)
            gaps = ends[1] - ends[0] + 1 - turns if ends[0] is not None else 0
            out.append((at, gaps, *sums, cost, audit))

        def batch_of() -> pa.RecordBatch:
            names = [c.split(" ")[0] for c in REPORT.format(conv="x").split(", ")]
            kinds = [kind, *[pa.int64()] * 6, pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out.clear()
            return made

        for batch in batches:
            kind = batch.schema.field("conv").type
            for r in batch.to_pylist():
                if state is not None and r["conv"] != at:
                    close()
                    state = None
                    if len(out) >= 1000:
                        yield batch_of()
                if state is None:
                    at = r["conv"]
                    state = {"ways": {NONE: (0, "")}, "sums": [0] * 4, "ends": [None, None], "turns": 0, "letter": ""}
                extend(state, r)
        if state is not None:
            close()
        if out:
            yield batch_of()

    return dealt.mapInArrow(run, REPORT.format(conv=conv_type))


def extend(state: dict, r: dict) -> None:
    """Adds a segment to what is known of its conversation."""
    if r["whole"]:
        state["ways"] = {NONE: (r["costs"][0], r["audits"][0])}
    else:
        longer: dict[int, tuple[int, str]] = {}
        for entry, (cost, audit) in state["ways"].items():
            for leave in range(4):
                step = r["costs"][4 * entry + leave]
                if step is not None:
                    way = cost + step, audit + r["audits"][4 * entry + leave]
                    if leave not in longer or way < longer[leave]:
                        longer[leave] = way
        state["ways"] = longer
    border = state["letter"] + r["first_letter"]
    add = [r["blank"], r["duplicate"], r["truncated"], r["illegal"] + (len(border) == 2 and border not in LEGAL)]
    state["sums"] = [a + b for a, b in zip(state["sums"], add)]
    state["letter"] = r["last_letter"]
    if r["first_turn"] is not None:
        state["turns"] += r["turns"] - (state["ends"][1] == r["first_turn"])
        state["ends"] = [r["first_turn"] if state["ends"][0] is None else state["ends"][0], r["last_turn"]]


class Repair:
    """Digest of a repaired conversation, fed row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.hash, self.role, self.any = audit, 0, hashlib.sha256(), NONE, False

    def put(self, role: str, text: str) -> None:
        self.hash.update(("\n" if self.any else "").encode() + f"{role}:".encode("utf-8", "surrogatepass") + text.encode("utf-8", "surrogatepass"))
        self.any = True

    def next_role(self) -> str:
        self.role = A if self.role == U else U
        return "assistant" if self.role == A else "user"

    def inserts(self) -> None:
        while self.audit[self.at: self.at + 1] == INSERT:
            self.put(self.next_role(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == KEEP:
            self.role = ROLE_OF[role[0]]
            self.put(role, text)
        elif edit == REROLE:
            self.put(self.next_role(), text)

    def digest(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


def hashed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) from the rows in order, streamed behind the audit of their conversation."""
    conv_type = rows.schema["conv"].dataType.simpleString()
    head = audits.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"))
    body = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", digest("text").alias("digest"), "text")
    order = ["conv", "kind", "turn", "role", "digest"]
    dealt = head.union(body).repartition("conv").sortWithinPartitions(*order).select("conv", "kind", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = repair = None
        for batch in batches:
            convs, digests = [], []
            for conv, kind, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    if repair is not None:
                        convs.append(at)
                        digests.append(repair.digest())
                    at, repair = conv, Repair(text)
                else:
                    repair.row(role, text)
            if convs:
                yield pa.RecordBatch.from_arrays([pa.array(convs, batch.schema.field("conv").type), pa.array(digests)], names=["conv", "repaired_sha256"])
            kind_of = batch.schema.field("conv").type
        if repair is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], kind_of), pa.array([repair.digest()])], names=["conv", "repaired_sha256"])

    return dealt.mapInArrow(run, f"conv {conv_type}, repaired_sha256 string")


def repaired(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows (conv, turn, role, text)."""
    parts = cut_lineage(segments(faults(rows), segment))
    report = cut_lineage(chained(parts))
    a, b = report.alias("a"), hashed(rows, report).alias("b")
    return a.join(b, F.col("a.conv").eqNullSafe(F.col("b.conv"))).select("a.*", "b.repaired_sha256")


def repair_damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                   segment: int = SEGMENT) -> DataFrame:
    """One row per original conversation, those that lost all their rows included."""
    done = repaired(damaged(turns, conv_col, turn_col, role_col, text_col), segment).alias("d")
    every = turns.select(F.col(conv_col).alias("conv")).distinct().alias("e")
    joined = every.join(done, F.col("e.conv").eqNullSafe(F.col("d.conv")), "left")
    counts = [F.coalesce(f"d.{c}", F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(F.col("e.conv").alias(conv_col), *counts, F.coalesce("d.audit", F.lit("")).alias("audit"),
                         F.coalesce("d.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
