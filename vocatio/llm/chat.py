"""Operator 4: minimum-cost repair of the roles in conversations, and rendering.

A legal conversation may open with one system turn, then user and assistant take turns, user first,
and it ends with the assistant. For each turn a repair keeps it, relabels it, or merges it into the
turn before; between turns it may insert empty turns. The automaton's states are what was said
last; a turn is a small matrix of least costs from state to state, and a run of turns is the
min-plus product of theirs. So a long conversation is cut into segments of SEGMENT turn numbers,
each segment's matrix is computed on its own, the matrices are combined, and every segment then
finds its cheapest path between the states that the whole path has at its ends. No task holds more
than one segment's turns, and the rendered text is given turn by turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import cut, table

#: States: nothing said yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = (None, "system", "user", "assistant")
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
STATES = 4

#: Costs. Relabelling to or from system costs more; a role that is none of the three is relabelled
#: for less, as it has to be.
MERGE, RELABEL, RELABEL_SYSTEM, UNKNOWN, INSERT = 1.0, 2.0, 3.0, 0.5, 1.5

#: Turn numbers of a segment.
SEGMENT = 256

FOREVER = 1e9


@lru_cache(maxsize=None)
def steps(role: str | None) -> tuple[tuple[int, int, float, tuple], ...]:
    """All ways to take in one turn: state before, state after, cost, (action, inserted roles).

    Up to two empty turns may be inserted before it: more never help, as two lead from any state
    to any other. Of equal costs the first listed is taken: keep, then merge, relabel, insert.
    """
    known = ROLES.index(role) if role in ROLES[1:] else None
    out = []
    for s in range(STATES):
        if s != START:
            # merged into the turn before, whatever that is; for free relabelling it would cost as much
            cost = MERGE if known == s else MERGE + (UNKNOWN if known is None else RELABEL_SYSTEM if SYSTEM in (known, s) else RELABEL)
            out.append((s, s, cost, ("merge" if known == s else "merge_relabel", ())))
        for n in (0, 1, 2):
            for inserted in product((SYSTEM, USER, ASSISTANT), repeat=n):
                at, ok = s, True
                for r in inserted:
                    ok &= r in NEXT[at]
                    at = r
                if not ok:
                    continue
                for r in NEXT[at]:
                    cost = n * INSERT + (0 if r == known else UNKNOWN if known is None else RELABEL_SYSTEM if SYSTEM in (known, r) else RELABEL)
                    out.append((s, r, cost, ("keep" if r == known else "relabel", inserted)))
    return tuple(out)


@lru_cache(maxsize=None)
def step_table(role: str | None) -> tuple[np.ndarray, dict]:
    """The least cost from each state to each, and how."""
    cost, how = np.full((STATES, STATES), FOREVER), {}
    order = {"keep": 0, "merge": 1, "relabel": 2, "merge_relabel": 3}
    for s, r, c, act in sorted(steps(role), key=lambda x: (x[2], len(x[3][1]), order[x[3][0]])):
        if c < cost[s, r]:
            cost[s, r], how[s, r] = c, act
    return cost, how


#: Cost of ending in each state: a last assistant turn is inserted (after a user turn, too) if missing.
END = {START: (0.0, ()), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), USER: (INSERT, (ASSISTANT,)), ASSISTANT: (0.0, ())}


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def segment_cost(roles: list[str | None]) -> np.ndarray:
    out = np.where(np.eye(STATES, dtype=bool), 0.0, FOREVER)
    for r in roles:
        out = times(out, step_table(r)[0])
    return np.minimum(out, FOREVER)


def path(roles: list[str | None], first: int, last: int) -> list[tuple[int, tuple]]:
    """The cheapest way through the turns between two states: state after and action of each.
    Of equal costs the smaller state before is taken."""
    best = np.full(STATES, FOREVER)
    best[first] = 0
    back = []
    for r in roles:
        total = best[:, None] + step_table(r)[0]
        back.append(total.argmin(axis=0))
        best = total.min(axis=0)
    out, s = [], last
    for r, b in zip(reversed(roles), reversed(back), strict=True):
        before = int(b[s])
        out.append((s, step_table(r)[1][before, s]))
        s = before
    return out[::-1]


def rendered(role: int, text: str) -> str:
    return f"<|{ROLES[role]}|>\n{text}\n"


def _segments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole segments: rows come sorted by conversation and segment."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in it:
        if not batch.num_rows:
            continue
        conv, seg = batch.column("conv").to_pylist(), batch.column("segment").to_numpy()
        start = 0
        for i in range(batch.num_rows):
            key = (conv[i], seg[i])
            if i and key != (conv[i - 1], seg[i - 1]) or not i and held and key != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, start = [], i
        held.append(batch.slice(start))
        last = (conv[-1], seg[-1])
    if held:
        yield pa.Table.from_batches(held)


def _costs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _segments(it):
        cost = segment_cost([(r or "").strip().lower() or None for r in t.column("role").to_pylist()])
        yield pa.RecordBatch.from_pydict({"conv": t.column("conv")[:1].combine_chunks(), "segment": t.column("segment")[:1].combine_chunks(), "cost": pa.array([cost.ravel().tolist()], pa.list_(pa.float64()))})


def _repairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv", "segment", "n", "turn", "role", "action", "cost", "piece"]
    types = [None, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]
    for t in _segments(it):
        raw, texts, turns = t.column("role").to_pylist(), t.column("text").to_pylist(), t.column("turn").to_pylist()
        roles = [(r or "").strip().lower() or None for r in raw]
        first, last, final = (t.column(c)[0].as_py() for c in ("first", "last", "final"))
        out = []
        at = first
        for turn, role, text, (state, (action, inserted)) in zip(turns, roles, texts, path(roles, first, last), strict=True):
            for r in inserted:
                out.append((None, ROLES[r], "insert", INSERT, rendered(r, "")))
            piece = f"{text or ''}\n" if action.startswith("merge") else rendered(state, text or "")
            out.append((turn, ROLES[state], action, float(step_table(role)[0][at, state]) - INSERT * len(inserted), piece))
            at = state
        if final:
            for r in END[last][1]:
                out.append((None, ROLES[r], "insert", INSERT, rendered(r, "")))
        conv, seg = t.column("conv")[0].as_py(), t.column("segment")[0].as_py()
        cols = list(zip(*[(conv, seg, i, *x) for i, x in enumerate(out)], strict=True))
        types[0] = t.schema.field("conv").type
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names)


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired turns, in order of (conv, segment, n): role, action (keep, relabel, merge,
    merge_relabel, insert), its cost, turn (the input's number; null for inserted ones) and piece,
    the rendered text. A conversation is rendered by joining its pieces in order.

    Turns are ordered by turn number; those that tie, by a hash of role and text, then by these;
    null numbers come first. Only rows that agree in all of that are never parted.
    Null texts are empty. Roles are compared trimmed and in lower case; null and unknown ones are
    relabelled or merged. Repeated rows are turns of their own, which tie. Rows with a null
    conversation form one conversation, of null. An empty table gives an empty result. Other columns
    aren't returned.
    """
    t = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    number = F.coalesce("turn", F.lit(-(1 << 40)))
    # Turns that share a number are told apart by a hash, so that they too spread over segments
    crowded = t.groupBy("conv", F.floor(number / SEGMENT).alias("block")).agg(F.count("*").alias("size")).withColumn("parts", F.expr(f"(size + {2 * SEGMENT - 1}) div {2 * SEGMENT}"))
    blocks = crowded.where("parts > 1").select(F.col("conv").alias("c"), F.col("block").alias("b"), "parts")
    t = t.withColumn("block", F.floor(number / SEGMENT))
    t = t.join(blocks, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left").drop("c", "b")
    # within a crowded block, each number has its segments, by ranges of the hash
    tie = F.shiftrightunsigned(F.xxhash64("role", "text"), 50)
    fine = F.pmod(number, F.lit(SEGMENT)) * (1 << 16) + F.floor(tie * F.least("parts", F.lit(1 << 14)) / (1 << 14))
    t = t.withColumn("segment", F.col("block") * (1 << 24) + F.when(F.col("parts") > 1, fine).otherwise(0)).withColumn("tie", tie)
    order = ["conv", "segment", "turn", "tie", "role", "text"]
    shape = turns.schema[conv_col].dataType.simpleString()
    sorted_ = t.select(*order).repartition("conv", "segment").sortWithinPartitions(*order)
    costs = cut(sorted_.select("conv", "segment", "role").mapInArrow(_costs, f"conv {shape}, segment long, cost array<double>"))
    ends = _ends(costs)
    with_ends = t.select(*order).join(ends, F.col("conv").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s"))).drop("c", "s")
    ready = with_ends.repartition("conv", "segment").sortWithinPartitions(*order)
    return ready.mapInArrow(_repairs, f"conv {shape}, segment long, n long, turn long, role string, action string, cost double, piece string")


def _ends(costs: DataFrame) -> DataFrame:
    """For each segment, the states of the cheapest whole path before and after it: c, s, first,
    last, final. The path goes over segments: one row for SEGMENT turns."""
    w = Window.partitionBy("conv").orderBy("segment")
    rows = costs.withColumn("i", F.row_number().over(w))
    listed = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("i", "segment", "cost"))).alias("segs"))
    shape = costs.schema["conv"].dataType.simpleString()

    def states(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in range(batch.num_rows):
                segs = batch.column("segs")[k].as_py()
                best = np.array([0.0, FOREVER, FOREVER, FOREVER])
                back = []
                for s in segs:
                    total = best[:, None] + np.array(s["cost"]).reshape(STATES, STATES)
                    back.append(total.argmin(axis=0))
                    best = total.min(axis=0)
                at = int((best + [END[s][0] for s in range(STATES)]).argmin())
                out = []
                for n, (s, b) in enumerate(zip(reversed(segs), reversed(back), strict=True)):
                    out.append((s["segment"], int(b[at]), at, n == 0))
                    at = int(b[at])
                seg, first, last, final = zip(*out, strict=True)
                conv = pa.array([batch.column("conv")[k].as_py()] * len(out), batch.schema.field("conv").type)
                yield pa.RecordBatch.from_arrays([conv, pa.array(seg, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(final, pa.bool_())], ["c", "s", "first", "last", "final"])

    return listed.mapInArrow(states, f"c {shape}, s long, first int, last int, final boolean")


def op4_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair(table(spark, sf_dir, "conversations"))
    return out.select(F.col("conv").alias("conv_id"), "segment", "n", "turn", "role", "action", "cost", "piece")
