"""Role repair against brute force, over partition edges, and odd rows."""

import itertools
import random

from predial.llm import chat


def brute(given):
    """The least cost over all role sequences."""
    best = chat.FAR
    for roles in itertools.product((1, 2, 3), repeat=len(given)):
        cost, before = chat.INSERT * len(chat.ENDS[roles[-1]]), 0
        for g, q in zip(given, roles):
            cost += chat.STEPS[g][before][q].cost
            before = q
        best = min(best, cost)
    return best


def cost(given, path):
    return sum(step.cost for _, step in path) + chat.INSERT * len(chat.ENDS[path[-1][0]])


def test_solve_is_optimal_and_splits():
    rng = random.Random(1)
    for _ in range(150):
        given = [rng.randrange(4) for _ in range(rng.randint(1, 7))]
        assert abs(cost(given, chat.solve(given)) - brute(given)) < 1e-9
        cut = sorted(rng.sample(range(1, len(given)), min(2, len(given) - 1)))
        parts = [given[a:b] for a, b in zip([0, *cut], [*cut, len(given)])]
        path = [x for p, (s, e) in zip(parts, chat._chain([chat.matrix(p) for p in parts])) for x in chat.solve(p, s, e)]
        assert abs(cost(given, path) - brute(given)) < 1e-9


def legal(roles):
    rest = roles[1:] if roles[:1] == ["system"] else roles
    return len(rest) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(rest))


def test_repair(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "User", "tool", None]), rng.choice(["hi", "", None, "x" * 3])) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(99, t, "user" if t % 3 else "assistant", f"m{t}") for t in range(400)] + [rows[0], (None, None, None, None)]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema)
    found = chat.repair(df).collect()
    assert len(found) == len(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in found if r.conv_id == conv), key=lambda r: (r.turn is not None, r.turn or 0, r.role is not None, r.role or ""))
        if len({(r.turn, r.role) for r in mine}) == len(mine):
            roles = [x for r in mine for x in [*filter(None, r.inserted_before.split(",")), *([] if r.action.startswith("merge") else [r.role_out]), *filter(None, r.inserted_after.split(","))]]
            assert legal(roles), (conv, roles)
            text = "".join(r.rendered for r in mine)
            assert text.count("<|") == len(roles)
    assert chat.repair(df.limit(0)).count() == 0
