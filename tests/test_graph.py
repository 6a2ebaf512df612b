import random
from collections import deque

import pytest

from weftgraph import schema as S
from weftgraph.graph import Graph, first_nodes
from weftgraph.iterate import bfs, paths, ranked_bfs, strong_components
from weftgraph.operators import architecture as A
from weftgraph.operators import impact as I
from weftgraph.operators import reach as R
from weftgraph.operators import traverse as T


def node(id_, **kw):
    base = {"id": id_, "name": id_.split("/")[-1], "kind": "CLASS", "module": None, "path": None, "line": None, "visibility": "PUBLIC", "modifiers": [], "attributes": [], "annotations": [], "supertypes": [], "synthesized": False, "enum_constants": None}
    return tuple((base | kw).values())


def edge(s, t, kind="CALL", weight=1, origin="BYTECODE", lines=()):
    return (s, t, kind, weight, origin, list(lines))


@pytest.fixture(scope="module")
def make(spark):
    def f(nodes, edges):
        return Graph.of(spark.createDataFrame(nodes, S.NODES), spark.createDataFrame(edges, S.EDGES))

    return f


def random_graph(seed, n=14):
    r = random.Random(seed)
    ids = [f"class:p{r.randint(0, 3)}/N{i:02}" for i in range(n)]
    edges = {(r.choice(ids), r.choice(ids)) for _ in range(r.randint(n, 3 * n))}
    return ids, sorted(e for e in edges if e[0] != e[1])


def test_first_input_wins_and_unknown_is_not_empty(spark):
    rows = [(*node("class:a", enum_constants=["X"]), 1), (*node("class:a", name="b", enum_constants=["X"]), 0), (*node("class:e", enum_constants=["X"]), 0), (*node("class:e", enum_constants=[]), 1)]
    out = {r.id: r for r in first_nodes(spark.createDataFrame(rows, S.NODES + ", seq int")).collect()}
    assert out["class:a"].name == "b" and out["class:a"].enum_constants == ["X"] and out["class:e"].enum_constants is None


def test_edges_merge_and_dangling_go(make):
    g = make([node("class:a"), node("class:b")], [edge("class:a", "class:b", lines=[3]), edge("class:a", "class:b", weight=2, lines=[1, 3]), edge("class:a", "class:zz")])
    (e,) = g.edges.collect()
    assert e.weight == 3 and e.lines == [1, 3]


def test_dispatch_adds_no_dependency(make):
    nodes = [node("class:up/A", module="up"), node("class:low/B", module="low")]
    g = make(nodes, [edge("class:up/A", "class:low/B"), edge("class:low/B", "class:up/A", "OVERRIDE"), edge("class:low/B", "class:up/A", "REFERENCE", origin="DISPATCH_MODEL")])
    assert [(r.source, r.target) for r in A.unit_graph(g).collect()] == [("up", "low")]
    assert {r.unit: (r.ca, r.ce) for r in A.martin_metrics(g).collect()} == {"up": (0, 1), "low": (1, 0)}
    assert A.layer_violations(g, [("u", ["up"]), ("l", ["low"])], [{"from": "u", "deny": ["l"]}]).count() == 1


def test_cycle_with_weakest_edges(spark):
    e = spark.createDataFrame([("b", "c"), ("c", "a"), ("a", "b"), ("a", "x")], "source string, target string")
    (c,) = A.cycles(e).collect()
    assert (c.component, c.length, c.path) == ("a", 3, ["a", "b", "c", "a"])


@pytest.mark.parametrize("seed", range(3))
def test_strong_components(spark, seed):
    ids, edges = random_graph(seed)
    reach = {a: {a} for a in ids}
    for _ in ids:
        for a, b in edges:
            for x in ids:
                if a in reach[x]:
                    reach[x].add(b)
    expected = {a: min(b for b in ids if b in reach[a] and a in reach[b]) for a in ids if any(b != a and b in reach[a] and a in reach[b] for b in ids)}
    found = strong_components(spark.createDataFrame(edges, "source string, target string"))
    assert {r.id: r.component for r in found.collect()} == expected


@pytest.mark.parametrize("seed,limit", [(1, None), (2, 6)])
def test_ranked_search_is_the_queue(spark, seed, limit):
    ids, edges = random_graph(seed)
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    pred, queue, order = {ids[3]: None, ids[0]: None}, deque([ids[3], ids[0]]), []
    while queue and (limit is None or len(order) < limit):
        x = queue.popleft()
        order.append(x)
        for y in sorted(out.get(x, [])):
            if y not in pred:
                pred[y] = x
                queue.append(y)
    df = spark.createDataFrame(edges, "source string, target string")
    found = ranked_bfs(df, spark.createDataFrame([(ids[3], 0), (ids[0], 1)], "id string, ord int"), visit_limit=limit)
    assert [r.id for r in found.orderBy("rank").collect()] == order
    assert {r.id: r.pred for r in found.collect()} == {x: pred[x] for x in order}
    for r in paths(found, found.select("id")).collect():
        walk = [r.id]
        while pred[walk[0]]:
            walk.insert(0, pred[walk[0]])
        assert r.path == walk


def test_forward_reach_is_reverse_impact(spark, make):
    ids, edges = random_graph(8)
    g = make([node(i) for i in ids], [edge(a, b) for a, b in edges])
    pairs = {(a.id, r) for r in ids[:3] for a in bfs(g.edges, spark.createDataFrame([(r,)], "id string")).collect()}
    t = g.edges.selectExpr("source", "target", "'call' AS relationship", "'DIRECT' AS tier", "CAST(NULL AS STRING) AS class_role")
    roots = spark.createDataFrame([(r,) for r in ids[:3]], "id string")
    rows = T.traverse(t, roots, "none").collect()
    assert {(r.id, x) for r in rows for x in r.roots} == {(a, b) for a, b in pairs if a != b}
    for target in ids[:4]:
        back = {r.id for r in I.affected(g, spark.createDataFrame([(target,)], "id string")).collect()}
        assert {r for r in ids[:3] if (target, r) in pairs} == back & set(ids[:3])


def test_relations_and_budget(spark, make):
    g = make([node(f"class:{c}") for c in "abcd"], [edge("class:b", "class:a"), edge("class:c", "class:b", "INHERITANCE"), edge("class:d", "class:b")])
    changed = spark.createDataFrame([("class:a",)], "id string")
    rows = {r.id: r for r in I.impact({"CURRENT": g}, changed).collect()}
    assert {k: v.relation for k, v in rows.items()} == {"class:b": "DIRECT", "class:c": "STRUCTURAL", "class:d": "TRANSITIVE"}
    items = spark.createDataFrame([("a", 3), ("b", 9), ("c", 2)], "id string, steps int")
    assert {r.id: r.shown for r in I.budgeted(items, 5).collect()} == {"a": True, "b": False, "c": True}


def test_test_paths(spark):
    cases = {"src/test/A.kt": True, "src/main/java/src/test/A.kt": False, "src/androidTestDebug/A.kt": True, "src/LoadTest/app/src/main/A.kt": False, "a/src/integrationTest/kotlin/A.kt": True, "test/A.kt": False}
    df = spark.createDataFrame([(k,) for k in cases], "path string")
    assert {r.path: r.t for r in df.select("path", I.is_test_path(df.path).alias("t")).collect()} == cases


def test_dead_findings_of_facades(make, spark):
    nodes = [node("class:F", attributes=["FILE_FACADE"]), node("method:F#f()V", name="f", kind="METHOD"), node("method:F#main()V", name="main", kind="METHOD", modifiers=["STATIC"]), node("class:G", synthesized=True)]
    g = make(nodes, [edge("class:F", "method:F#f()V", "MEMBER"), edge("class:F", "method:F#main()V", "MEMBER")])
    found = R.dead_findings(g, R.reach(g, spark.createDataFrame([], S.RETENTION)))
    assert {r.id for r in found.collect()} == {"class:F", "method:F#f()V"}
