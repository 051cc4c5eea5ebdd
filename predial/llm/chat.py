"""Chat formatting by minimum-cost role repair.

A legal conversation may begin with a system turn, then user and assistant alternate, and it ends with an assistant. A
dynamic programme over that automaton decides for every turn whether it keeps its role, is relabelled or joins the turn
before, and where empty turns are inserted. Its steps are products of small cost matrices, so a conversation that spans
several range partitions is solved from one matrix a partition: only these reach the driver, and no conversation is
ever gathered in one task.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import write_table

#: States are the role of the turn before; 0 is the beginning.
ROLES = ("", "system", "user", "assistant")
#: Costs of the repairs. A role that is no role costs UNKNOWN to name.
MERGE, RELABEL, INSERT, UNKNOWN = 1.0, 2.0, 2.5, 0.5
FAR = 1e18
TURNS = "__conv long, turn long, role string, role_out string, action string, inserted_before string, inserted_after string, rendered string"


class Step(NamedTuple):
    cost: float
    action: str
    inserted: tuple[int, ...]


def _gap(before: int, role: int) -> tuple[int, ...] | None:
    """The empty turns that make ``role`` legal after ``before``; None if nothing does."""
    if role == 1:
        return () if before == 0 else None
    if role == 2:
        return (3,) if before == 2 else ()
    return () if before == 2 else (2,)


def _step(given: int, before: int, role: int) -> Step:
    """The cheapest way to make a turn of the given role (0: unknown) one of ``role`` after ``before``."""
    named = 0.0 if given == role else UNKNOWN if given == 0 else RELABEL
    gap = _gap(before, role)
    ways = [] if gap is None else [Step(named + INSERT * len(gap), "keep" if given == role else "relabel", gap)]
    if before == role:
        ways.append(Step(named + MERGE, "merge" if given == role else "merge_relabel", ()))
    return min(ways, key=lambda w: w.cost) if ways else Step(FAR, "", ())


STEPS = [[[_step(g, p, q) if q else Step(FAR, "", ()) for q in range(4)] for p in range(4)] for g in range(4)]
#: Empty turns that end a conversation legally, by the last role.
ENDS: tuple[tuple[int, ...], ...] = ((), (2, 3), (3,), ())


def _given(role: str | None) -> int:
    name = (role or "").strip().lower()
    return {"system": 1, "user": 2, "human": 2, "assistant": 3, "bot": 3, "gpt": 3}.get(name, 0)


def matrix(given: list[int]) -> np.ndarray:
    """Least costs from each state before the turns to each state after them."""
    total = np.full((4, 4), FAR)
    np.fill_diagonal(total, 0)
    for g in given:
        step = np.array([[STEPS[g][p][q].cost if q else FAR for q in range(4)] for p in range(4)])
        total = np.minimum((total[:, :, None] + step[None]).min(axis=1), FAR)
    return total


def solve(given: list[int], start: int = 0, end: int | None = None) -> list[tuple[int, Step]]:
    """The roles and steps of least cost from state ``start`` to state ``end`` (None: any, with the cost to end there)."""
    costs, back = [FAR] * 4, []
    costs[start] = 0.0
    for g in given:
        best = [min((costs[p] + STEPS[g][p][q].cost, p) for p in range(4)) if q else (FAR, 0) for q in range(4)]
        back.append([p for _, p in best])
        costs = [c for c, _ in best]
    if end is None:
        end = min(range(1, 4), key=lambda q: (costs[q] + INSERT * len(ENDS[q]), q)) if given else start
    out = []
    for g, before in zip(reversed(given), reversed(back)):
        out.append((end, STEPS[g][before[end]][end]))
        end = before[end]
    return out[::-1]


def _fragments(table: pa.Table) -> list[tuple]:
    """(conversation, first row, last row + 1) in a sorted partition."""
    names = table.column("__conv").to_pylist()
    cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
    return [(names[a], a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by([("__row", "ascending")])


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per turn: its role in the legal sequence, the action, empty turns before and after it, and its rendering.

    The renderings of a conversation in the order of its turns, one after the other, are the formatted conversation: a
    merged turn continues the one before, empty turns are rendered with it. Turns of equal number go by role and text;
    null numbers come first; rows with a null conversation are one conversation; null texts are empty; roles other
    than system, user (human) and assistant (bot, gpt) are unknown. An empty table gives none.
    """
    spark = turns.sparkSession
    base = turns.select(F.col(conv_col).cast("long").alias("__conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    order = ["__conv", "turn", "role", F.xxhash64("text")]
    placed = base.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    placed, _ = write_table(placed.withColumn("part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), "turns")

    def edges(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        parts, roles, part = _fragments(table), table.column("role").to_pylist(), table.column("part")[0].as_py()
        chosen = {0, len(parts) - 1}
        rows = [(part, k, len(parts), name, matrix([_given(r) for r in roles[a:b]]).reshape(-1).tolist()) for k, (name, a, b) in enumerate(parts) if k in chosen]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64())))], ["part", "place", "n", "conv", "costs"])

    # At most two matrices a partition.
    found = placed.groupBy("part").applyInArrow(edges, "part int, place int, n int, conv long, costs array<double>").toArrow().sort_by([("part", "ascending"), ("place", "ascending")]).to_pylist()
    bounds: dict[tuple[int, int], tuple[int, int | None]] = {}
    at = 0
    while at < len(found):
        end = at + 1
        while end < len(found) and found[end]["place"] == 0 and found[end]["conv"] == found[end - 1]["conv"] and found[end - 1]["place"] == found[end - 1]["n"] - 1:
            end += 1
        chain = found[at:end]
        if len(chain) > 1:
            for fragment, ends in zip(chain, _chain([np.array(x["costs"]).reshape(4, 4) for x in chain])):
                bounds[fragment["part"], fragment["place"]] = ends
        at = end
    shared = spark.sparkContext.broadcast(bounds)

    def rewrite(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        parts, part = _fragments(table), table.column("part")[0].as_py()
        names, numbers, roles, texts = (table.column(c).to_pylist() for c in ("__conv", "turn", "role", "text"))
        out = []
        for k, (_, a, b) in enumerate(parts):
            start, end = shared.value.get((part, k), (0, None))
            path = solve([_given(r) for r in roles[a:b]], start, end)
            for i, (role, step) in enumerate(path):
                last = i == len(path) - 1 and end is None
                after = ENDS[role] if last else ()
                head = "" if step.action.startswith("merge") else f"<|{ROLES[role]}|>\n"
                lead = "\n" if not head else ""
                empty = lambda rs: "".join(f"<|{ROLES[r]}|>\n\n" for r in rs)
                text = f"{empty(step.inserted)}{lead}{head}{texts[a + i] or ''}\n{empty(after)}"
                out.append((names[a + i], numbers[a + i], roles[a + i], ROLES[role], step.action, ",".join(ROLES[r] for r in step.inserted), ",".join(ROLES[r] for r in after), text))
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 6]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [f.split()[0] for f in TURNS.split(", ")])

    return placed.groupBy("part").applyInArrow(rewrite, TURNS).withColumnRenamed("__conv", conv_col)


def _chain(matrices: list[np.ndarray]) -> list[tuple[int, int | None]]:
    """The states before and after each fragment of one conversation; the last may end anywhere (None)."""
    costs, back = np.array([0.0, FAR, FAR, FAR]), []
    for m in matrices:
        total = costs[:, None] + m
        back.append(total.argmin(axis=0))
        costs = total.min(axis=0)
    end = min(range(1, 4), key=lambda q: (costs[q] + INSERT * len(ENDS[q]), q))
    out: list[tuple[int, int | None]] = []
    for k in range(len(matrices) - 1, -1, -1):
        before = int(back[k][end])
        out.append((before, None if k == len(matrices) - 1 else end))
        end = before
    return out[::-1]
