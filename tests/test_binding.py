import random
from collections import deque

import pytest

from tests.test_graph import edge, make, node  # noqa: F401
from weftgraph import schema as S
from weftgraph.operators import binding as B
from weftgraph.operators import impact as I


def walk(edges, adapters, nodes, looks):
    """The search, an edge at a time."""
    order = sorted({(e[0], e[1], S.EDGE_KINDS.index(e[2]), e[4]) for e in edges})
    steps, owners, examined = {}, {}, 0
    queue = deque()
    for a in sorted(adapters):
        if len(steps) == nodes:
            return steps, owners, examined, True
        steps[a] = (a, None)
        queue.append(a)
    while queue:
        at = queue.popleft()
        for out in (0, 1):
            for s, t, k, origin in order:
                if (s if out else t) != at:
                    continue
                if examined == looks:
                    return steps, owners, examined, True
                examined += 1
                if not out and S.EDGE_KINDS[k] == "MEMBER" and s not in steps and s not in owners:
                    if len(steps) + len(owners) == nodes:
                        return steps, owners, examined, True
                    owners[s] = at
                if out and S.EDGE_KINDS[k] == "CALL" and origin == "BYTECODE" and t not in steps:
                    if len(steps) + len(owners) == nodes:
                        return steps, owners, examined, True
                    steps[t] = (steps[at][0], at)
                    queue.append(t)
    return steps, owners, examined, False


@pytest.mark.parametrize("nodes,looks", [(1000, 1000), (1000, 17), (9, 1000), (14, 26), (2, 1000), (1000, 60)])
def test_budgets(make, spark, nodes, looks):  # noqa: F811
    r = random.Random(11)
    ids = [f"method:p/C{i // 3}#m{i}()V" for i in range(24)]
    classes = [f"class:p/C{i}" for i in range(8)]
    edges = [edge(r.choice(ids), r.choice(ids), r.choice(["CALL", "CALL", "CALL", "REFERENCE"]), origin=r.choice(["BYTECODE", "BYTECODE", "RUNTIME_MODEL"])) for _ in range(45)]
    edges += [edge(classes[i // 3], m, "MEMBER") for i, m in enumerate(ids)] + [edge(r.choice(ids), r.choice(classes)) for _ in range(5)]
    adapters = ids[4:7]
    steps, owners, examined, truncated = walk(edges, adapters, nodes, looks)
    g = make([node(i, kind="METHOD") for i in ids] + [node(c) for c in classes], edges)
    got = B.uncertainty(g, spark.createDataFrame([(a,) for a in adapters], "id string"), nodes, looks)
    assert {x.id: (x.adapter, x.caller) for x in got.steps.collect()} == steps
    assert [x.id for x in got.steps.orderBy("rank").collect()] == list(steps)
    assert {x.id: x.member for x in got.owners.collect()} == owners
    assert (got.examined, got.truncated) == (examined, truncated)
    every = g.nodes.select("id")
    assert got.requires_review(every).count() == (every.count() if truncated else len({*steps, *owners}))


@pytest.mark.parametrize("budget", [0, 7, 100, 640, None])
def test_paths_share_a_budget(spark, budget):
    r = random.Random(2)
    rows = [(r.randrange(2), f"n{i:03}", r.choice([1, 1, 2, 3, 5, 9])) for i in range(300)]
    left, expected = 10**9 if budget is None else budget, {}
    for k in sorted(rows):
        expected[k] = k[2] <= left
        left -= k[2] if expected[k] else 0
    df = spark.createDataFrame(rows, "nth int, id string, steps int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = I.budgeted(df, budget, ["nth", "id"])
        assert {(x.nth, x.id, x.steps): x.shown for x in got.collect()} == expected
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert budget in (0, None) or len(set(expected.values())) == 2


def test_impact_leaves_out_paths_beyond_the_budget(make, spark):  # noqa: F811
    g = make([node(x, kind="METHOD", path="src/main/a.kt") for x in "abcde"], [edge("b", "a"), edge("c", "b"), edge("d", "c"), edge("e", "a")])
    changed = spark.createDataFrame([("a",)], "id string")
    got = {x.id: x.path_status for x in I.impact({"BASE": g, "CURRENT": g}, changed, path_limit=8).collect()}
    # b 1, c 2, d 3, e 1 of the base, then b 1; what is left is too little for c and d, and gone at e
    assert got == {"b": "COMPLETE", "c": "PARTIAL", "d": "PARTIAL", "e": "PARTIAL"}
    assert {x.path_status for x in I.impact({"BASE": g, "CURRENT": g}, changed).collect()} == {"COMPLETE"}
