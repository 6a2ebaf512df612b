"""What queries may not do, so that larger tables fit: build what they do not read, search twice, cut."""

import random

import pytest

from weftgraph import graph as G
from weftgraph import schema as S
from weftgraph.operators import impact as I
from weftgraph.operators import query as Q
from weftgraph.operators import traverse as T
from weftgraph.plans import extra, more, star  # noqa: F401
from weftgraph.plans.queries import QUERIES

from .test_graph import edge, make, node  # noqa: F401

SMALL = "/root/testdata/sf0.001"


def _refuse(*_, **__):
    raise AssertionError("not needed")


def _mixed(make, n=40, m=160, seed=3):  # noqa: F811
    r = random.Random(seed)
    ids = ["class:part/5", *(f"class:n{i}" for i in range(n))]
    kinds = (*["CALL"] * 8, "REFERENCE", "INHERITANCE", "OVERRIDE", "FIELD_ACCESS")
    pairs = {(*r.sample(ids, 2), r.choice(kinds), r.choice(("BYTECODE", "DISPATCH_MODEL", "RUNTIME_MODEL"))) for _ in range(m)}
    return make([node(i) for i in ids], [edge(s, t, k, origin=o) for s, t, k, o in pairs])


@pytest.mark.parametrize("name", ["input_hints", "edge_inherited_call", "runtime_value_counts", "edge_runtime_values", "callback_flows", "callback_summary"])
def test_queries_of_nodes_make_no_edges(spark, monkeypatch, name):
    monkeypatch.setattr(star, "graph", _refuse)
    assert QUERIES[name](spark, SMALL).count()


@pytest.mark.parametrize("few", [0, 100])
def test_connected_is_canonical(spark, monkeypatch, few):
    monkeypatch.setattr(G, "FEW", few)
    nodes = spark.createDataFrame([node("class:a"), node("class:b"), node("class:c")], S.NODES)
    rows = [edge("class:a", "class:b", lines=[3]), edge("class:a", "class:b", lines=[1, 3]), edge("class:a", "class:gone"), edge("class:gone", "class:b"), edge(None, "class:b"), edge("class:c", "class:a", "MEMBER")]
    edges = spark.createDataFrame(rows, S.EDGES)
    found = G.connected(nodes, edges)
    want = G.canonical(G.Graph(nodes, edges)).edges
    assert sorted(map(tuple, found.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert len(found.columns) == len(want.columns)


def test_kept_graph_shuffles_whole_edges_once(spark, monkeypatch):
    """Each row of an edge goes through one shuffle, that of the merge."""
    plans, real = [], G.written
    monkeypatch.setattr(star, "_kept", {})
    monkeypatch.setattr(G, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    g = star.graph(spark, SMALL)
    assert sum("hashpartitioning(source" in x and "kind" in x for p in plans for x in p.splitlines() if "Exchange" in x) == 1
    raw = star.frame(spark, SMALL, "raw_edges").withColumn("lines", star.F.when(star.F.col("line").isNotNull(), star.F.array("line")).otherwise(star.F.array().cast("array<int>")))
    want = G.canonical(G.Graph(star.nodes(spark, SMALL), raw))
    for a, b in ((g.edges, want.edges), (g.nodes, want.nodes)):
        a = a.select(*b.columns)
        assert a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_neighbors_query_has_no_limit(make, monkeypatch):  # noqa: F811
    g = make([node("class:nation/7"), *(node(f"class:n{i}") for i in range(9))], [edge(f"class:n{i}", "class:nation/7") for i in range(9)])
    assert Q.neighbors(g, "class:nation/7", limit=None).count() == 9
    monkeypatch.setattr(star, "graph", lambda spark, d: g)
    monkeypatch.setattr(Q, "neighbors", lambda *a, real=Q.neighbors, **k: real(*a, **k | {"limit": min(k["limit"] or 9, 9) if k["limit"] is None else 4}))
    rows = QUERIES["neighbors"](g.nodes.sparkSession, "").collect()
    assert len(rows) == 9 and not any(r.truncated for r in rows)


def test_traversal_searches_once_for_roots(make, monkeypatch):  # noqa: F811
    g, calls = _mixed(make), []
    monkeypatch.setattr(star, "graph", lambda spark, d: g)
    monkeypatch.setattr(T, "pairs", lambda *a, real=T.pairs: calls.append(1) or real(*a))
    for i, name in enumerate(("traverse_reverse", "traverse")):
        assert QUERIES[name](g.nodes.sparkSession, "").count()
        assert len(calls) == i + 1


def test_evidence_is_the_weakest_tier_needed(make):  # noqa: F811
    """By counting, for each set of tiers, the roots that reach a node."""
    r = random.Random(5)
    ids = [f"n{i}" for i in range(30)]
    rows = [(*r.sample(ids, 2), "call", r.choice(T.TIERS), None) for _ in range(70)]
    spark = make([node("class:a")], []).nodes.sparkSession
    e = spark.createDataFrame(rows, "source string, target string, relationship string, tier string, class_role string")
    roots = ids[:4]

    def counts(tiers):
        out = {}
        for root in roots:
            seen, todo = {root}, [root]
            while todo:
                x = todo.pop()
                for s, t, _, tier, _ in rows:
                    if s == x and tier in tiers and t not in seen:
                        seen.add(t)
                        todo.append(t)
            for x in seen - {root}:
                out[x] = out.get(x, 0) + 1
        return out

    by = [counts(T.TIERS[: i + 1]) for i in range(4)]
    want = {x: next(T.TIERS[i] for i in range(4) if by[i].get(x) == n) for x, n in by[-1].items()}
    found = T.traverse(e, spark.createDataFrame([(x,) for x in roots], "id string")).collect()
    assert {x.id: x.evidence for x in found} == want and {x.id: x.n_roots for x in found} == by[-1]


def test_impact_makes_no_witnesses(make, monkeypatch):  # noqa: F811
    g = _mixed(make, m=70)
    spark = g.nodes.sparkSession
    changed = spark.createDataFrame([("class:part/5",)], "id string")
    found = I.affected(g, changed)
    want = {r.id: bool({*r.kinds} & {*I.STRUCTURAL}) for r in I.witnesses(g, changed, found).collect()}
    assert {r.id: r.structural for r in I.related(g, changed).filter("depth > 0").collect()} == want and {*want.values()} == {True, False}
    monkeypatch.setattr(I, "witnesses", _refuse)
    monkeypatch.setattr(star, "graph", lambda spark, d: g)
    monkeypatch.setattr(star, "before", lambda spark, d: g)
    rows = QUERIES["impact_compare"](spark, "").collect()
    assert {r.id for r in rows} == {*want} and {r.id for r in rows if r.relation == "STRUCTURAL"} == {x for x, s in want.items() if s}
    assert QUERIES["impact_summary"](spark, "").count()


def test_test_only_takes_the_graph_as_it_is(spark, monkeypatch):
    star.graph(spark, SMALL)
    monkeypatch.setattr(G, "canonical", _refuse)
    assert QUERIES["test_only"](spark, SMALL).count()


def test_callbacks_go_back_along_their_own_links(spark, monkeypatch):
    """With one target of all callers, rows that a step back meets grow with the callers, not with their square."""
    from pyspark.sql import functions as F

    from weftgraph.operators import flows as X

    n, found, real = 60, [], X._fixed_point

    def watched(front, step, keys, rounds=None):
        if rounds is None and len(keys) > 4:
            found.extend(x for x in (step(front, 1)._jdf.queryExecution().optimizedPlan().toString(),))
        return real(front, step, keys, rounds)

    monkeypatch.setattr(X, "_fixed_point", watched)
    ids = ["hub", *(f"c{i}" for i in range(n))]
    take = lambda x: f"method:{x}#take(F)V"
    nodes = [node(take(x), kind="METHOD") for x in ids] + [node(f"method:o{i}#run()V", kind="METHOD") for i in range(n)]
    g = G.Graph(spark.createDataFrame(nodes, S.NODES), spark.createDataFrame([], S.EDGES))
    uses = [(take(x), 0, "DECLARED", None, None, None) for x in ids] + [(take(f"c{i}"), 0, "ARGUMENT", take("hub"), "STATIC", 0) for i in range(n)]
    uses.append((take("hub"), 0, "RECEIVER", "method:java/lang/Runnable#run()V", "INTERFACE", None))
    arguments = [(f"method:o{i}#make()V", f"method:o{i}#run()V", take(f"c{i}"), "STATIC", 0, "run()V") for i in range(n)]
    edges, flows = X.callback_flows(g, spark.createDataFrame(arguments, X.ARGUMENTS), spark.createDataFrame(uses, X.USES), spark.createDataFrame([], X.ESCAPES))
    assert edges.count() == 2 * n and flows.filter(F.col("outcome") == "bound").count() == n
    # the join back is by the start, too
    (plan,) = found
    join = next(x for x in plan.splitlines() if "Join Inner" in x)
    assert "s_method" in join and "s_parameter" in join


def test_searches_leave_no_edges_behind(make, monkeypatch):  # noqa: F811
    from weftgraph import iterate as It

    g, made = _mixed(make), []
    spark = g.nodes.sparkSession
    for at in (It, T):
        monkeypatch.setattr(at, "settled", lambda df, real=It.settled: made.append(real(df)) or made[-1])
    seeds = spark.createDataFrame([("class:part/5", 0)], "id string, ord int")
    for search in (It.bfs, It.ranked_bfs, T.pairs):
        made.clear()
        assert search(g.edges, seeds).count()
        assert made[0].columns == ["source", "target"]
        (folder,) = {x.rsplit("/", 1)[0].removeprefix("file://") for x in made[0].inputFiles()}
        assert not __import__("os").path.exists(folder)
