import json

from tests.test_graph import edge, make, node  # noqa: F401
from weftgraph import schema as S
from weftgraph import verbs
from weftgraph.operators import dispatch as D
from weftgraph.operators import persistence as P
from weftgraph.sources import configs


def small(make):  # noqa: F811
    nodes = [node("class:p/Main", path="src/main/Main.kt"), node("class:p/Used", path="src/main/Used.kt"), node("class:p/Kept", annotations=["androidx/annotation/Keep"]), node("class:p/Dead", path="src/main/Dead.kt"), node("class:p/Old", path="src/main/Old.kt"), node("class:q/Ruled")]
    return make(nodes, [edge("class:p/Main", "class:p/Used"), edge("class:p/Dead", "class:p/Used"), edge("class:p/Dead", "class:p/Old")])


def test_dead(make, spark):  # noqa: F811
    g = small(make)
    given = spark.createDataFrame([("class:p/Main", "MANIFEST_COMPONENT", "m.xml", 1)], S.RETENTION)
    known = spark.createDataFrame([("dead|class:p/Old|src/main/Old.kt",)], "fingerprint string")
    open_ = spark.createDataFrame([("src/main/Dead.kt", 2)], "path string, channels long")
    inputs = verbs.Inputs(evidence=given, rules=configs.keep_rules("-keep class q.*"), baseline=known, channels=open_)
    assert {r.id: r.depth for r in verbs.reach(g, inputs).collect()} == {"class:p/Main": 0, "class:p/Used": 1, "class:p/Kept": 0, "class:q/Ruled": 0}
    assert {r.id: (r.status, r.confidence) for r in verbs.dead(g, inputs).collect()} == {"class:p/Dead": ("new", "REVIEW"), "class:p/Old": ("baseline", "STATIC")}


def test_impact_and_its_document(make, spark):  # noqa: F811
    g = small(make)
    r = verbs.impact({"BASE": g, "CURRENT": g}, symbols=["p.Used", "none"], sort="PATH_DEPTH", limit=1, path_limit=1)
    assert [x.id for x in r.rows.collect()] == ["class:p/Dead"]
    assert {(x.code, x.n) for x in r.limitations.collect()} == {("LONG_PATHS", 2), ("OTHER_PAGES", 1), ("STATIC_VIEW", None), ("NO_FILE", 2)}
    lines = [json.loads(x.line) for x in r.document.orderBy("ord", "line").collect()]
    assert lines[0] == {"format": "change-impact", "record": "header", "version": 1}
    assert {x["requested"]: x["status"] for x in lines if x["record"] == "seed"} == {"p.Used": "found", "none": "notFound"}
    assert [x["id"] for x in lines if x["record"] == "candidate"] == ["class:p/Dead"]
    assert "2 item(s) without a full path: more than 1 edges in all" in {x["text"] for x in lines if x["record"] == "limitation"}


def test_traverse_and_its_document(make, spark):  # noqa: F811
    g = small(make)
    r = verbs.traverse(g, D.tiers(g), ["class:p/Dead", "nobody"], max_depth=1)
    assert {x.id for x in r.rows.collect()} == {"class:p/Used", "class:p/Old"}
    assert {x.code for x in r.limitations.collect()} == {"NO_SUCH_ROOT", "TOO_DEEP", "STATIC_VIEW"}
    assert sum('"record":"node"' in x.line for x in r.document.collect()) == 2


def test_rules(make):  # noqa: F811
    text = "layers:\n  - name: low\n    match: [p]\nrules:\n  - name: none\n    from: low\n    deny: [low]\n"
    violations, rest = verbs.rules(small(make), text)
    assert violations.count() == 0 and rest.count() == 1


def test_calls_that_persistence_explains(spark):
    from weftgraph.graph import Graph

    base = P.REPOSITORIES[1]
    nodes = [node("class:p/Repo", kind="INTERFACE", supertypes=[base, "p/Extra"], path="src\\Repo.kt"), node("class:p/Extra", kind="INTERFACE"), node("class:p/Other", kind="INTERFACE"), node("method:p/Extra#count()J", kind="METHOD"), node("method:p/Use#go()V", kind="METHOD", line=4), node("class:p/Use")]
    call = lambda n, owner, name, line, kind="INTERFACE": ("method:p/Use#go()V", owner, name, "()J", kind, None, line, n, [], "UNRESOLVED", None)
    calls = [call(0, "p/Repo", "findAll", 7), call(1, "p/Repo", "count", 7), call(2, "p/Repo", "findAll", 8), call(3, "p/Repo", "save", None), call(4, "p/Other", "x", 7), call(5, "p/Repo", "findAll", 7, "STATIC")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    sites = frame([("method:p/Use#go()V", 7, "orders"), ("method:p/Use#go()V", 4, "orders"), ("method:p/Use#go()V", 8, "else")], P.CALL_SITES)
    declared = frame([("src/Repo.kt", "orders")], P.DECLARATIONS)
    g = Graph.of(frame(nodes, S.NODES), frame([], S.EDGES), external_calls=frame(calls, S.EXTERNAL_CALLS))
    found = P.persistence_modeled(g, sites, declared)
    assert sorted(r.ordinal for r in found.collect()) == [0, 3]
    assert {r.caller: r.n for r in P.unresolved_without(g, found).collect()} == {"method:p/Use#go()V": 3}
    own = Graph.of(frame([*nodes, node("class:p/Mine", supertypes=["p/Repo"])], S.NODES), frame([], S.EDGES), external_calls=frame(calls, S.EXTERNAL_CALLS))
    assert P.persistence_modeled(own, sites, declared).count() == 0
