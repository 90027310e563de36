"""Chat formatting with role repair at least cost (operator 2).

Legal conversations follow an automaton: an optional system turn, then user and assistant turns by turns, ending with
the assistant. A conversation that does not is repaired: a turn may be merged into the one before (cost MERGE),
relabelled (RELABEL, or UNKNOWN if its role is none of the three) or preceded by empty turns (INSERT each), and empty
turns may close it. Dynamic programming over the automaton's states finds the least cost; ties go to the earlier role
in ROLES, and to a merge.

Turns are put in order in ranges of a written table and cut in blocks of ``BLOCK`` rows of it, so that a long conversation,
also one whose turns share a number or have none, is dealt to many tasks and is held by none.
The least costs from every state before a block to every state behind it depend on the block alone. A second step
puts these small tables together, one row a block, and tells each block where its path enters and leaves; a third one
works out the path within each block and renders it.

Each turn yields one row whose ``piece``, joined in order of ``place``, is the rendered conversation. Turns are ordered by
turn, role and a hash of the text, nulls first. Null texts are empty, texts may be of any length; null roles are unknown;
turns with a null conv_id form one conversation, turns with a null number come first; repeated rows are turns of their own.
An empty table gives no rows. Other columns are left behind, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import global_rank
from .common import small_batches, table

ROLES = ("system", "user", "assistant")
MERGE, INSERT, UNKNOWN, RELABEL = 1, 2, 2, 3
_START = -1
#: Empty turns that lead from one state to a role; states that cannot reach a role are left out.
_BETWEEN: dict[tuple[int, int], tuple[int, ...]] = {
    (_START, 0): (), (_START, 1): (), (_START, 2): (1,), (0, 1): (), (0, 2): (1,), (1, 2): (), (1, 1): (2,), (2, 1): (), (2, 2): (1,),
}
_CLOSING = {0: (1, 2), 1: (2,), 2: ()}
_STATES = (_START, 0, 1, 2)
#: Turn numbers of a block.
BLOCK = 1024


class Repair:
    """Feeds on the roles of a block, from one state before it; each path has its cost, its messages, and its steps linked backwards."""

    def __init__(self, start: int = _START, steps: bool = True):
        self.paths: dict[int, tuple[int, int, tuple | None]] = {start: (0, 0, None)}
        self.steps = steps

    def feed(self, role: str | None) -> None:
        own = ROLES.index(role) if role in ROLES else None
        best: dict[int, tuple[int, int, tuple | None]] = {}
        for q in range(len(ROLES)):
            label = 0 if own == q else UNKNOWN if own is None else RELABEL
            for p, (cost, messages, step) in self.paths.items():
                if p == q and (q not in best or cost + label + MERGE < best[q][0]):
                    best[q] = (cost + label + MERGE, messages, (step, q, "merge" if own == q else "relabel+merge", ()) if self.steps else None)
                if (p, q) in _BETWEEN:
                    between = _BETWEEN[p, q]
                    if q not in best or cost + label + INSERT * len(between) < best[q][0]:
                        best[q] = (cost + label + INSERT * len(between), messages + len(between) + 1, (step, q, "keep" if own == q else "relabel", between) if self.steps else None)
        self.paths = best

    def back(self, state: int) -> list[tuple[int, str, tuple[int, ...]]]:
        """Role, action and inserted turns of each step of the path that ends in ``state``."""
        out, step = [], self.paths[state][2]
        while step is not None:
            step, *rest = step
            out.append(tuple(rest))
        return out[::-1]


def _whole(paths: dict[int, tuple]) -> tuple[int, int]:
    """The least cost of a conversation whose last block ends as ``paths`` tells, and the state that it ends in."""
    return min((cost + INSERT * len(_CLOSING[q]), q) for q, (cost, *_) in paths.items())


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, block, n turns, and cost and messages of every way through each block, from rows in order of (conv_id, block)."""
    none = object()
    key, runs, n = none, [], 0
    rows: list[tuple] = []

    def done() -> None:
        ways = [x for r in runs for q in range(len(ROLES)) for x in (r.paths[q][:2] if q in r.paths else (None, None))]
        rows.append((*key, n, ways))

    def out() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["conv_id", "block", "n", "ways"])
        rows.clear()
        return batch

    for batch in batches:
        for conv, block, role in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if key is none or (conv, block) != key:
                if key is not none:
                    done()
                key, runs, n = (conv, block), [Repair(p, steps=False) for p in _STATES], 0
            for r in runs:
                r.feed(role)
            n += 1
        if rows:
            yield out()
    if key is not none:
        done()
        yield out()


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, block, enter, leave, place, message, cost (null but in the last block): the cheapest way, from rows in order of (conv_id, block)."""
    none = object()
    key, blocks = none, []
    rows: list[tuple] = []

    def done() -> None:
        paths: dict[int, tuple[int, int]] = {_START: (0, 0)}
        froms = []
        for _, _, ways in blocks:
            best: dict[int, tuple[int, int]] = {}
            came: dict[int, int] = {}
            for q in range(len(ROLES)):
                for p, (cost, messages) in paths.items():
                    at = 2 * (len(ROLES) * _STATES.index(p) + q)
                    if ways[at] is not None and (q not in best or cost + ways[at] < best[q][0]):
                        best[q], came[q] = (cost + ways[at], messages + ways[at + 1]), p
            froms.append((came, paths))
            paths = best
        cost, state = _whole(paths)
        place = sum(n for _, n, _ in blocks)
        for k in range(len(blocks) - 1, -1, -1):
            came, before = froms[k]
            place -= blocks[k][1]
            rows.append((key, blocks[k][0], came[state], state, place, before[came[state]][1] - 1, cost if k == len(blocks) - 1 else None))
            state = came[state]

    def out() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["conv_id", "block", "enter", "leave", "place", "message", "cost"])
        rows.clear()
        return batch

    for batch in batches:
        for conv, block, n, ways in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if key is none or conv != key:
                if key is not none:
                    done()
                key, blocks = conv, []
            blocks.append((block, n, ways))
        if rows:
            yield out()
    if key is not none:
        done()
        yield out()


def _opened(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


CLOSED = "<|end|>\n"


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rendered turns, from rows in order of (conv_id, block) whose first one in each block is its plan."""
    none = object()
    key, plan, repair, waiting = none, None, None, []
    rows: list[tuple] = []

    def done() -> None:
        at, message, cost = plan["place"], plan["message"], plan["cost"]
        steps = repair.back(plan["leave"])
        for k, ((turn, text), (role, action, inserted)) in enumerate(zip(waiting, steps, strict=True)):
            piece = ""
            if "merge" in action:
                piece = "\n"
            else:
                for r in (*inserted, role):
                    piece += (CLOSED if message >= 0 else "") + _opened(r)
                    message += 1
            piece += text
            closing = _CLOSING[role] if cost is not None and k == len(steps) - 1 else None
            if closing is not None:
                piece += CLOSED + "".join(_opened(r) + CLOSED for r in closing)
            rows.append((key[0], turn, at, message, ROLES[role], action, len(inserted) + len(closing or ()), cost if closing is not None else None, piece))
            at += 1

    def out() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string())
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["conv_id", "turn", "place", "message", "role", "action", "inserted", "cost", "piece"])
        rows.clear()
        return batch

    for batch in batches:
        for row in batch.to_pylist():
            if key is none or (row["conv_id"], row["block"]) != key:
                if key is not none:
                    done()
                key, plan, repair, waiting = (row["conv_id"], row["block"]), row, Repair(row["enter"]), []
            else:
                waiting.append((row["turn"], row["text"] or ""))
                repair.feed(row["role"])
        if rows:
            yield out()
    if key is not none:
        done()
        yield out()


def format_turns(conversations: DataFrame, block: int | None = None) -> DataFrame:
    """conv_id, turn, place, message, role, action, inserted (empty turns before it, or closing), cost (of the conversation, in its last row), piece."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ranked = global_rank(turns.withColumn("hash", F.xxhash64("text")), ["conv_id", "turn", "role", "hash"])
    turns = ranked.withColumn("block", F.expr(f"rank div {block or BLOCK}"))
    small_batches(conversations.sparkSession)
    roles = turns.select("conv_id", "block", "role", "rank").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "rank")
    costs = roles.select("conv_id", "block", "role").mapInArrow(_costs, "conv_id long, block long, n long, ways array<long>")
    plan_kind = "enter int, leave int, place long, message long, cost long"
    plans = costs.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_plans, f"conv_id long, block long, {plan_kind}")
    fields = [f.split() for f in plan_kind.split(", ")]
    both = turns.select("conv_id", "block", F.lit(True).alias("own"), "rank", "turn", "role", "text", *[F.lit(None).cast(t).alias(n) for n, t in fields]).unionByName(plans.withColumn("own", F.lit(False)), allowMissingColumns=True)
    dealt = both.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "own", "rank")
    return dealt.mapInArrow(_formatted, "conv_id long, turn long, place long, message long, role string, action string, inserted int, cost long, piece string")


def rendered(conversations: DataFrame) -> DataFrame:
    """conv_id, cost, rendered: one row for each conversation."""
    pieces = format_turns(conversations).groupBy("conv_id").agg(F.max("cost").alias("cost"), F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("pieces"))
    return pieces.select("conv_id", "cost", F.array_join("pieces.piece", "").alias("rendered"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_turns(table(spark, sf_dir, "conversations"))


QUERIES = {"op2_chat": op2_chat}
SQL: dict[str, str] = {}
