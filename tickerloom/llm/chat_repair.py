"""Cheapest repair of damaged conversations, by Hirschberg's divide and conquer.

Each turn may be kept (K, free), given another role (R, 3) or deleted (D, 4), and empty
turns may be put in anywhere (I, 3), so that role initials read ``(s?(ua)+)?``.  Blank and
repeated turns must go; a truncated turn that stays adds 3.  Of the cheapest edit
sequences the one whose initials are least in ASCII order counts.

States and crossings
    Four states say what may follow: nothing yet, after a system turn, after user, after
    assistant.  Insertions count with the turn they stand before, so an edit sequence
    up to a turn ends with that turn's own edit, and no such sequence is a prefix of another.
    A forward vector has per state the least cost and the rank of its least
    sequence among the states; a backward vector has the least cost to the end.
    Where both meet in the middle, the cheapest crossing with the smallest rank lies on the
    audit-least optimum.  Both halves follow by recursion; only vectors of four are held.

Long conversations
    Turns are range-sorted by conversation, turn, role and text, so a conversation may
    spread over many partitions, and cut into blocks of ``BLOCK`` turns.  A block is
    summed up by four forward vectors, one per state it may start in.  Of conversations with several blocks
    these summaries (one row per ``BLOCK`` turns) go through the same search with blocks
    instead of turns, which fixes the states at block edges; then every block is
    repaired on its own.  Equal turns are counted before the sort, so many of them are one row.

Defined cases: null conversation, role and text are one space each in the damage's key and in
the text; rows without conversation are one conversation; turns without number come first;
rows of one turn follow by role and text; a role without initial s, u or a cannot be
kept; a conversation without turns is repaired by nothing; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.text import small_batches
from tickerloom.scratch import materialize

BLOCK = 2048
RENAME = INSERT = TRUNCATED = 3
DELETE = 4
#: States: nothing yet, after system, after user, after assistant.  A conversation may end in the first and last.
START, SYSTEM, USER, ASSISTANT = range(4)
_OPEN = 1 << 60
_AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The state after an inserted or renamed turn; which role that is follows from the state.
_FREE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
_BLANK = r"[^\\x20\\x09-\\x0D]"


# --- one conversation or block -------------------------------------------------------------

@functools.cache
def _edits(kind: str) -> tuple[tuple[int, str, int, int], ...]:
    """(from, initials, to, cost) of every way past one turn.

    ``kind`` is the turn's initial (small, or capital if truncated), ``o``/``O`` for other roles, ``d`` for
    a turn that must go, and ``e`` for the end of the conversation.
    """
    out = []
    for start in range(4):
        state, initials, cost = start, "", 0
        for _ in range(3):  # a third insertion returns to a state that was there for less
            if kind == "e":
                if state in (START, ASSISTANT):
                    out.append((start, initials, START, cost))
            else:
                out.append((start, initials + "D", state, cost + DELETE))
                if kind != "d":
                    extra = TRUNCATED if kind.isupper() else 0
                    out.append((start, initials + "R", _FREE[state], cost + RENAME + extra))
                    kept = _AFTER.get(kind.lower(), {}).get(state)
                    if kept is not None:
                        out.append((start, initials + "K", kept, cost + extra))
            state, initials, cost = _FREE[state], initials + "I", cost + INSERT
    return tuple(out)


#: A forward vector: (cost, rank) per state; costs are relative to the least.
Vector = tuple[tuple[int, int], ...]


def at_state(state: int) -> Vector:
    return tuple((0, 0) if q == state else (_OPEN, 0) for q in range(4))


def _settled(best: list[tuple | None]) -> Vector:
    """The vector of (cost, from rank, initials) per state."""
    order = {x[1:]: i for i, x in enumerate(sorted((b for b in best if b), key=lambda b: b[1:]))}
    least = min(b[0] for b in best if b)
    return tuple((b[0] - least, order[b[1:]]) if b else (_OPEN, 0) for b in best)


@functools.lru_cache(maxsize=1 << 16)
def _forward(vector: Vector, kind: str) -> Vector:
    best: list[tuple | None] = [None] * 4
    for start, initials, to, cost in _edits(kind):
        before, rank = vector[start]
        if before < _OPEN:
            found = (before + cost, rank, initials)
            if best[to] is None or found < best[to]:
                best[to] = found
    return _settled(best)


@functools.lru_cache(maxsize=1 << 16)
def _backward(costs: tuple[int, ...], kind: str) -> tuple[int, ...]:
    out = [_OPEN] * 4
    for start, _, to, cost in _edits(kind):
        out[start] = min(out[start], cost + costs[to])
    least = min(out)
    return tuple(x - least if x < _OPEN else _OPEN for x in out)


def crossing(vector: Vector, costs: tuple[int, ...]) -> int:
    """The state in which the audit-least of the cheapest sequences crosses."""
    return min((cost + rest, rank, q) for q, ((cost, rank), rest) in enumerate(zip(vector, costs, strict=True)))[2]


def _steps(start: int, kinds: str, end: int) -> Iterator[str]:
    if len(kinds) == 1:
        yield min((cost, initials) for p, initials, q, cost in _edits(kinds) if p == start and q == end)[1]
        return
    middle = len(kinds) // 2
    vector, costs = at_state(start), tuple(0 if q == end else _OPEN for q in range(4))
    for kind in kinds[:middle]:
        vector = _forward(vector, kind)
    for kind in reversed(kinds[middle:]):
        costs = _backward(costs, kind)
    state = crossing(vector, costs)
    yield from _steps(start, kinds[:middle], state)
    yield from _steps(state, kinds[middle:], end)


def steps(kinds: str, start: int = START, end: int | None = None) -> list[str]:
    """The initials at each turn of ``kinds``; without ``end`` the conversation ends here, and what it needs for that is the last entry."""
    if end is None:
        kinds, end = kinds + "e", START
    return _short(start, kinds, end) if len(kinds) <= 16 else list(_steps(start, kinds, end))


@functools.lru_cache(maxsize=1 << 16)
def _short(start: int, kinds: str, end: int) -> list[str]:
    return list(_steps(start, kinds, end))


# --- blocks of one conversation --------------------------------------------------------------

def summary(kinds: str) -> list[tuple[int, int, int, int]]:
    """(from, to, cost, rank) through a block; ranks compare the sequences of one start."""
    out = []
    for start in range(4):
        # The least cost is carried beside the relative vector.
        vector, base = at_state(start), 0
        for kind in kinds:
            base += min(vector[p][0] + c for p, _, _, c in _edits(kind) if vector[p][0] < _OPEN)
            vector = _forward(vector, kind)
        out += [(start, to, base + cost, rank) for to, (cost, rank) in enumerate(vector) if cost < _OPEN]
    return out


_END = [(p, q, cost, 0) for p, _, q, cost in _edits("e")]


def edge_states(blocks: list[list[tuple[int, int, int, int]]]) -> list[int]:
    """The states before each block and after the last one (before the conversation's end), by the same search over summaries."""

    def forward(vector: Vector, block: list) -> Vector:
        best: list[tuple | None] = [None] * 4
        for start, to, cost, rank in block:
            before, mine = vector[start]
            if before < _OPEN and (best[to] is None or (before + cost, mine, rank) < best[to]):
                best[to] = (before + cost, mine, rank)
        return _settled(best)

    def search(start: int, low: int, high: int, end: int) -> Iterator[int]:
        if high - low == 1:
            yield start
            return
        middle = (low + high) // 2
        vector, costs = at_state(start), [0 if q == end else _OPEN for q in range(4)]
        for block in blocks[low:middle]:
            vector = forward(vector, block)
        for block in reversed(blocks[middle:high]):
            new = [_OPEN] * 4
            for p, q, cost, _ in block:
                new[p] = min(new[p], cost + costs[q])
            costs = new
        state = crossing(vector, tuple(costs))
        yield from search(start, low, middle, state)
        yield from search(state, middle, high, end)

    blocks = [*blocks, _END]
    return list(search(START, 0, len(blocks), START))


# --- tables ----------------------------------------------------------------------------------

def damaged(turns: DataFrame) -> DataFrame:
    """(c, turn, role, text, lost): the table's turns with planned faults, by crc32 of ``conv_id:turn``.

    One in twenty each is lost, emptied, stripped of stops, doubled, or made a user's.
    """
    known = turns.selectExpr(
        "CAST(conv_id AS string) AS c", "CAST(turn AS long) AS turn", "coalesce(CAST(role AS string), ' ') AS role", "coalesce(CAST(text AS string), ' ') AS text",
        "crc32(concat(coalesce(CAST(conv_id AS string), ' '), ':', coalesce(CAST(turn AS string), ' '))) % 20 AS fault")
    return known.selectExpr(
        "c", "turn", "IF(fault = 4, 'user', role) AS role", "CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text",
        "fault = 0 AS lost", "explode(IF(fault = 3, array(1, 2), array(1))) AS copy").drop("copy")


def _judged(turns: DataFrame) -> DataFrame:
    """(c, lost, turn, role, text, m, fault): distinct turns with their number and fault; one row for all that a conversation has lost."""
    counted = turns.selectExpr("c", "lost", "IF(lost, NULL, turn) AS turn", "IF(lost, NULL, role) AS role", "IF(lost, NULL, text) AS text").groupBy("c", "lost", "turn", "role", "text").agg(F.count(F.lit(1)).alias("m"))
    counted = materialize(counted, "turns").withColumn("solid", F.expr(f"NOT lost AND text RLIKE '{_BLANK}'"))
    hashed = counted.withColumns({"x": F.when(F.col("solid"), F.xxhash64("c", "role", "text")), "y": F.when(F.col("solid"), F.xxhash64(F.lit(1), "text", "role", "c"))})
    # Texts that come again under another number, with the first of those.
    again = hashed.where("solid").groupBy("x", "y").agg(F.min(F.struct(F.expr("turn IS NOT NULL AS numbered"), "turn")).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    again = materialize(again.select("x", "y", F.col("first.turn").alias("first")), "repeats").withColumn("found", F.lit(True))
    plain = hashed.where("NOT solid").withColumns({"first": F.lit(None).cast("long"), "found": F.lit(None).cast("boolean")})
    joined = hashed.where("solid").join(again, ["x", "y"], "left").select(*plain.columns)
    return joined.union(plain).selectExpr(
        "c", "lost", "turn", "role", "text", "m",
        rf"""CASE WHEN lost THEN 'lost' WHEN NOT solid THEN 'blank' WHEN found AND NOT (turn <=> first) THEN 'duplicate'
             WHEN NOT text RLIKE '[.!?][\\x20\\x09-\\x0D]*\\z' THEN 'truncated' ELSE '' END AS fault""")


_EDIT = "struct<edit:string,fault:string,turn:long,role:string,text:string>"
_TURN = "struct<fault:string,turn:long,role:string,text:string>"
_EDIT_TYPE = pa.list_(pa.struct([("edit", pa.string()), ("fault", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
_TURN_TYPE = pa.list_(pa.struct([("fault", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))


def kind_of(fault: str, role: str) -> str:
    if fault in ("blank", "duplicate"):
        return "d"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial.upper() if fault == "truncated" else initial


def _blocks(judged: DataFrame) -> DataFrame:
    """(slice, block, c, kinds, turns) of range-sorted turns; blocks of a conversation follow by (slice, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, now, turns, ready, held = 0, None, [], [], 0

        def close() -> None:
            nonlocal number, turns
            ready.append((number, now[0], "".join(kind_of(t["fault"], t["role"]) for t in turns), turns))
            number, turns = number + 1, []

        def flush() -> pa.RecordBatch:
            nonlocal held
            numbers, c, kinds, lists = zip(*ready, strict=True) if ready else ((),) * 4
            ready.clear()
            held = 0
            return pa.RecordBatch.from_arrays([
                pa.array([part] * len(numbers), pa.int64()), pa.array(numbers, pa.int64()), pa.array(c, pa.string()), pa.array(kinds, pa.string()), pa.array(lists, _TURN_TYPE)],
                names=["slice", "block", "c", "kinds", "turns"])

        for batch in batches:
            for row in batch.to_pylist():
                if now is not None and now[0] != row["c"]:
                    close()
                    now = None
                now = (row["c"],)
                for copy in range(0 if row["fault"] == "lost" else row["m"]):
                    if len(turns) == BLOCK:
                        close()
                    fault = row["fault"] if copy == 0 or row["fault"] == "blank" else "duplicate"
                    turns.append({"fault": fault, "turn": row["turn"], "role": row["role"], "text": row["text"]})
                    held += len(row["text"]) + 50
                    if held > 1 << 22:
                        yield flush()
        if now is not None:
            close()
        yield flush()

    order = ["c", "lost", "turn", "role", "text"]
    return judged.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"slice long, block long, c string, kinds string, turns array<{_TURN}>")


def _edges(blocks: DataFrame) -> DataFrame:
    """(slice, block, before, after): states around the blocks of conversations that have several; ``after`` is null for a last one."""
    several = blocks.groupBy("c").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("c").alias("several"))
    mine = blocks.select("slice", "block", "c", "kinds").join(several, F.expr("c <=> several"), "left_semi")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[x for row in summary(kinds) for x in row] for kinds in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], names=["slice", "block", "c", "paths"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def states() -> pa.RecordBatch:
            before = edge_states(paths)
            # Each block's end is the next one's start; the entry past the last block belongs to the conversation's end.
            rows = [(s, b, before[i], None if i + 1 == len(paths) else before[i + 1]) for i, (s, b) in enumerate(places)]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["slice", "block", "before", "after"])

        now, places, paths = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if places and now != row["c"]:
                    yield states()
                    places, paths = [], []
                now = row["c"]
                flat = row["paths"]
                places.append((row["slice"], row["block"]))
                paths.append([tuple(flat[i:i + 4]) for i in range(0, len(flat), 4)])
        if places:
            yield states()

    summaries = mine.mapInArrow(summed, "slice long, block long, c string, paths array<long>")
    ordered = summaries.repartition("c").sortWithinPartitions("c", "slice", "block")
    return ordered.mapInArrow(chosen, "slice long, block long, before long, after long")


def _solved(kinds: str, turns: list[dict], start: int, end: int | None) -> list[dict]:
    """The edits of a block in order; inserted turns have no number and fault."""
    out, state = [], start
    found = steps(kinds, start, end)
    for i, initials in enumerate(found):
        turn = turns[i] if i < len(turns) else None
        for edit in initials:
            if edit == "I":
                state = _FREE[state]
                out.append({"edit": edit, "fault": "", "turn": None, "role": ROLES[state], "text": ""})
                continue
            role = turn["role"]
            if edit == "R":
                state = _FREE[state]
                role = ROLES[state]
            elif edit == "K":
                state = _AFTER[role[0]][state]
            out.append({"edit": edit, "fault": turn["fault"], "turn": turn["turn"], "role": role, "text": turn["text"]})
    return out


def repair_blocks(turns: DataFrame) -> DataFrame:
    """(c, slice, block, roles, edits) for (c, turn, role, text, lost): the edits of up to ``BLOCK`` turns a row, in order of (slice, block).

    ``roles`` are the turns' initials before the repair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                edits = _solved(row["kinds"], row["turns"], START if row["before"] is None else row["before"], row["after"])
                initials = [t["role"][:1] for t in row["turns"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["c"]], pa.string()), pa.array([row["slice"]]), pa.array([row["block"]]), pa.array([initials], pa.list_(pa.string())), pa.array([edits], _EDIT_TYPE)],
                    names=["c", "slice", "block", "roles", "edits"])

    blocks = materialize(_blocks(_judged(small_batches(turns))), "blocks")
    edges = materialize(_edges(blocks), "edges")
    return blocks.join(edges, ["slice", "block"], "left").select("c", "slice", "block", "kinds", "turns", "before", "after").mapInArrow(
        run, f"c string, slice long, block long, roles array<string>, edits array<{_EDIT}>")


def repaired_turns(blocks: DataFrame) -> DataFrame:
    """(conv_id, slice, block, place, edit, role, text): the turns that :func:`repair_blocks` leaves, in that order."""
    rows = blocks.selectExpr("c AS conv_id", "slice", "block", "posexplode(edits) AS (place, e)")
    return rows.where("e.edit <> 'D'").selectExpr("conv_id", "slice", "block", "place", "e.edit AS edit", "e.role AS role", "e.text AS text")


class _Report:
    """What one conversation comes to, fed with its blocks in order."""

    COST = {"K": 0, "R": RENAME, "D": DELETE, "I": INSERT}

    def __init__(self) -> None:
        self.low = self.high = self.last_turn = self.last_role = None
        self.turns = self.illegal = self.cost = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.audit: list[str] = []
        self.text, self.begun = hashlib.sha256(), False

    def feed(self, roles: list[str], edits: list[dict]) -> None:
        for role in roles:
            if self.last_role is not None and self.last_role + role not in ("su", "ua", "au"):
                self.illegal += 1
            self.last_role = role
        for e in edits:
            self.faults[e["fault"]] += 1
            turn = e["turn"]
            if turn is not None and turn != self.last_turn:
                self.low = turn if self.low is None else self.low
                self.high = self.last_turn = turn
                self.turns += 1
            self.cost += self.COST[e["edit"]]
            if e["edit"] != "D":
                if e["fault"] == "truncated":
                    self.cost += TRUNCATED
                self.text.update(("\n" if self.begun else "").encode() + f"{e['role']}:{e['text']}".encode())
                self.begun = True
        self.audit.append("".join(e["edit"] for e in edits))

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal, self.cost, "".join(self.audit), self.text.hexdigest()


_RESULT = "c string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_digest(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of (c, turn, role, text, lost).

    A digest reads a conversation in order, so one task reads all of it, block by block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _RESULT.split(", ")])

        now, report, rows = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if report is None or now != row["c"]:
                    if report is not None:
                        rows.append((now, *report.row()))
                    now, report = row["c"], _Report()
                report.feed(row["roles"], row["edits"])
            if rows:
                yield made(rows)
                rows = []
        if report is not None:
            yield made([(now, *report.row())])

    ordered = repair_blocks(turns).repartition("c").sortWithinPartitions("c", "slice", "block")
    return ordered.mapInArrow(run, _RESULT).selectExpr("CAST(c AS long) AS conv_id", "* EXCEPT (c)")
