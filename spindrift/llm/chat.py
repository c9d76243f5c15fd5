"""Chat formatting with minimum-cost role repair.

The legal-turn automaton has a state per role of the last turn: it starts with a system or a user turn, a user turn
follows the system turn, then assistant and user turns alternate; a conversation may end after either.  Each input turn
opens a new turn (after empty turns, if the automaton asks for them) or is merged into the one before, under its own
role or another.  Dynamic programming finds the cheapest sequence; ties go to the earlier state in STATES.

Turns are range-partitioned, so that a conversation of any length may span partitions.  The cost of a stretch of turns
is a matrix (state before x state after) under (min, +); only the matrices of the first and the last conversation of
each partition reach the driver, which joins them and fixes the states at the partitions' edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

STATES = ("start", "system", "user", "assistant")
ALIASES = {"system": "system", "developer": "system", "user": "user", "human": "user", "prompter": "user", "assistant": "assistant", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Empty turns to insert before a turn of the second state can follow the first; absent: it never can.
BETWEEN = {
    (0, 1): (), (0, 2): (), (0, 3): (2,), (1, 2): (), (1, 3): (2,),
    (2, 3): (), (2, 2): (3,), (3, 2): (), (3, 3): (2,),
}
INFINITE = float("inf")
REPAIRED = "conv_id long, seq long, turn long, role string, final_role string, action string, inserted array<string>, cost long, rendered string"


@dataclass(frozen=True)
class Costs:
    merge: int = 2
    relabel: int = 3
    relabel_unknown: int = 1
    insert: int = 4

    def step(self, before: int, role: int | None, after: int) -> tuple[float, bool]:
        """(cost, merged) of taking a turn of role (None: unknown) from one state to another."""
        name = 0 if role == after else self.relabel_unknown if role is None else self.relabel
        opened = self.insert * len(BETWEEN[before, after]) if (before, after) in BETWEEN else INFINITE
        merged = self.merge if before == after != 0 else INFINITE
        return name + min(opened, merged), merged <= opened and merged < INFINITE

    def table(self) -> dict[int | None, list[tuple[int, int, float]]]:
        """By role, the possible (before, after, cost)."""
        moves = {}
        for role in (None, 1, 2, 3):
            moves[role] = [(p, q, c) for p in range(4) for q in (1, 2, 3) if (c := self.step(p, role, q)[0]) < INFINITE]
        return moves

    def end(self, state: int) -> float:
        return 0 if state in (2, 3) else self.insert if state == 1 else INFINITE


def role_of(role: str | None) -> int | None:
    name = ALIASES.get((role or "").strip().lower())
    return STATES.index(name) if name else None


def forward(costs: list[float], role: int | None, moves: dict) -> tuple[list[float], list[int]]:
    """Costs after one turn, and the state before for each state after (the smallest among equals)."""
    out, back = [INFINITE] * 4, [-1] * 4
    for p, q, c in moves[role]:
        if costs[p] + c < out[q]:
            out[q], back[q] = costs[p] + c, p
    return out, back


def matrix(roles: list[int | None], moves: dict) -> list[list[float]]:
    rows = [[0 if i == j else INFINITE for j in range(4)] for i in range(4)]
    for role in roles:
        rows = [forward(r, role, moves)[0] for r in rows]
    return rows


def states_of(roles: list[int | None], first: int, last: int | None, costs: Costs, moves: dict) -> list[int]:
    """The state after each turn on the cheapest way from state first to state last (None: to any end)."""
    now, backs = [0 if s == first else INFINITE for s in range(4)], []
    for role in roles:
        now, back = forward(now, role, moves)
        backs.append(back)
    if last is None:
        last = min(range(4), key=lambda s: now[s] + costs.end(s))
    out = []
    for back in reversed(backs):
        out.append(last)
        last = back[last]
    return out[::-1]


def render(role: int, text: str | None, inserted: tuple[int, ...], merged: bool, before: int) -> str:
    """The text that this turn adds: pieces of a conversation, in order, make up its rendering."""
    if merged:
        return "\n" + (text or "")
    close = "<|im_end|>\n" if before else ""
    empty = "".join(f"<|im_start|>{STATES[r]}\n<|im_end|>\n" for r in inserted)
    return f"{close}{empty}<|im_start|>{STATES[role]}\n{text or ''}"


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple]]]:
    """(conv_id, turns) of the stretches of one conversation, in order."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
            if held and held[0][0] != row[0]:
                yield held[0][0], held
                held = []
            held.append(row)
    if held:
        yield held[0][0], held


def _edges(parts: list[dict], costs: Costs) -> dict[tuple[int, bool], tuple[int, int | None, bool, int]]:
    """By (part, is it its first stretch): (state before, state after or None, does it end here, turns before).

    parts: the first and the last stretch of every partition, in order (one row where they are the same).
    """
    runs: list[list[dict]] = []
    for x in parts:
        if runs and runs[-1][-1]["conv_id"] == x["conv_id"] and runs[-1][-1]["part"] != x["part"] and runs[-1][-1]["last"] and x["first"]:
            runs[-1].append(x)
        else:
            runs.append([x])
    out = {}
    for run in runs:
        before = [[0, INFINITE, INFINITE, INFINITE]]
        for x in run:
            before.append([min(before[-1][p] + x["cost"][4 * p + q] for p in range(4)) for q in range(4)])
        state = min(range(4), key=lambda s: before[-1][s] + costs.end(s))
        seen = sum(x["n"] for x in run)
        for k in range(len(run) - 1, -1, -1):
            x = run[k]
            first = min(range(4), key=lambda p: before[k][p] + x["cost"][4 * p + state])
            seen -= x["n"]
            out[x["part"], x["first"]] = (first, state, k == len(run) - 1, seen)
            state = first
    return out


def repair(df: DataFrame, costs: Costs | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn (REPAIRED): its place seq in its conversation, its final role, what was done (keep, merge, relabel,
    relabel+merge), the roles of empty turns inserted before it, its cost, and the text it adds to the rendering.

    Turns are ordered by turn number (null first), then by a hash of role and text; repeated rows are turns of their own.
    Null and empty texts are empty turns; null or unknown roles are relabelled.  Rows without a conversation id form one
    conversation.  Turns of any length and conversations of any number of turns are repaired whole.
    Other columns are ignored; an empty table gives no rows.  Texts are rendered as they are: one that holds
    ``<|im_start|>`` or ``<|im_end|>`` itself must be encoded without special tokens, as ops 3, 5 and 7 do by default.
    """
    costs = costs or Costs()
    moves = costs.table()
    spark = df.sparkSession
    base = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    turns = df.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"))
    keys = ["conv_id", "turn", "tie", "row"]
    turns = turns.withColumn("tie", F.xxhash64("role", "text")).withColumn("row", F.monotonically_increasing_id())
    dealt = turns.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text").checkpoint()

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, n = TaskContext.get().partitionId(), None, None, 0
        for conv, rows in _stretches(batches):
            last = (conv, [role_of(r[2]) for r in rows])
            first, n = first or last, n + 1
        ends = [] if not n else [(first, True, True)] if n == 1 else [(first, True, False), (last, False, True)]
        cells = [[min(c, 1e15) for line in matrix(roles, moves) for c in line] for (_, roles), _, _ in ends]
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(ends), pa.int32()), pa.array([e[0][0] for e in ends], pa.int64()), pa.array([e[1] for e in ends], pa.bool_()), pa.array([e[2] for e in ends], pa.bool_()), pa.array([len(e[0][1]) for e in ends], pa.int64()), pa.array(cells, pa.list_(pa.float64()))],
            ["part", "conv_id", "first", "last", "n", "cost"],
        )

    ends = dealt.mapInArrow(summary, "part int, conv_id long, first boolean, last boolean, n long, cost array<double>").collect()  # two a partition at most
    edges = _edges(sorted((r.asDict() for r in ends), key=lambda r: (r["part"], not r["first"])), costs)
    names = [f.split()[0] for f in REPAIRED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, at_first = TaskContext.get().partitionId(), [], True
        stretches = _stretches(batches)
        ahead = next(stretches, None)
        while ahead:
            (conv, rows), ahead = ahead, next(stretches, None)
            fixed = edges[part, at_first] if at_first or ahead is None else (0, None, True, 0)
            at_first = False
            before, last, ends_here, seen = fixed
            roles = [role_of(r[2]) for r in rows]
            for k, (role, after, row) in enumerate(zip(roles, states_of(roles, before, last, costs, moves), rows, strict=True)):
                cost, merged = costs.step(before, role, after)
                inserted = () if merged else BETWEEN[before, after]
                text = render(after, row[3], inserted, merged, before)
                if ends_here and k == len(rows) - 1:
                    cost += costs.end(after)
                    text += "<|im_end|>\n" + ("<|im_start|>user\n<|im_end|>\n" if costs.end(after) else "")
                action = "+".join(["relabel"] * (role != after) + ["merge"] * merged) or "keep"
                out.append((conv, seen + k, row[1], row[2], STATES[after], action, [STATES[i] for i in inserted], int(cost), text))
                before = after
            if len(out) >= 4096 or ahead is None:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []

    return dealt.mapInArrow(run, REPAIRED)
