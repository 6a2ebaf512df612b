import pytest

from tests.test_graph import edge, node
from weftgraph import schema as S
from weftgraph.graph import Graph
from weftgraph.operators import callbacks as C
from weftgraph.operators import query as Q
from weftgraph.operators import reach as R
from weftgraph.operators import retention as K
from weftgraph.operators import review as W
from weftgraph.sources import configs


@pytest.fixture(scope="module")
def make(spark):
    def f(nodes, edges=(), **facts):
        return Graph.of(spark.createDataFrame(nodes, S.NODES), spark.createDataFrame(list(edges), S.EDGES), **facts)

    return f


def method(id_, **kw):
    return node(id_, **({"kind": "METHOD", "name": id_.split("#")[1].split("(")[0]} | kw))


def pairs(df):
    return sorted((r.source, r.target) for r in df.collect())


def test_callbacks_of_library_types(make, spark):
    view = "android/webkit/WebViewClient"
    nodes = [node("class:a/Mine", supertypes=[view]), node("class:a/Below", supertypes=["a/Mine"]), node("class:a/Other")]
    nodes += [method("method:a/Below#go()V"), method("method:a/Below#hidden()V", visibility="PRIVATE"), method("method:a/Below#s()V", modifiers=["STATIC"]), method("method:a/Other#go()V")]
    g = make(nodes)
    assert pairs(C.runtime_callbacks(g)) == [("class:a/Below", "method:a/Below#go()V")]
    library = spark.createDataFrame([(f"class:{view}", "go()V", "PROTECTED"), (f"class:{view}", "hidden()V", "PUBLIC")], "owner string, signature string, visibility string")
    assert pairs(C.library_overrides(g, library)) == [("class:a/Below", "method:a/Below#go()V")]
    assert C.library_overrides(g, library, limit=1).count() == 0


def test_interface_calls_mean_the_most_specific_declaration(make, spark):
    face = lambda id_, *up: node(id_, kind="INTERFACE", supertypes=list(up))
    nodes = [face("class:Top"), face("class:Mid", "Top"), face("class:Low", "Mid"), face("class:Body"), face("class:Two", "Mid", "Body")]
    nodes += [method(f"method:{x}#run()V", modifiers=["ABSTRACT"]) for x in ("Top", "Mid")] + [method("method:Body#run()V")]
    calls = spark.createDataFrame([("method:X#a()V", "class:Low", "run()V", "INTERFACE"), ("method:X#a()V", "class:Low", "run()V", "INTERFACE"), ("method:X#b()V", "class:Two", "run()V", "INTERFACE"), ("method:X#c()V", "class:Mid", "run()V", "INTERFACE"), ("method:X#d()V", "class:Low", "hashCode()I", "INTERFACE")], "caller string, owner string, signature string, kind string")
    out = C.inherited_interface_calls(make(nodes), calls).collect()
    assert [(r.source, r.target, r.weight) for r in out] == [("method:X#a()V", "method:Mid#run()V", 2)]
    direct = spark.createDataFrame([("method:X#a()V", "method:Low#run()V", 5, [9, 3])], "source string, target string, weight int, lines array<int>")
    (r,) = C.inherited_interface_calls(make(nodes), calls, direct).collect()
    assert (r.weight, r.lines) == (5, [3, 9])


def test_call_declarations(spark):
    classes = spark.createDataFrame([("class:p/Top", None, False, False), ("class:p/Mid", "class:p/Top", False, True), ("class:q/Low", "class:p/Mid", False, True), ("class:q/Use", None, False, True), ("class:p/Face", None, True, False)], "id string, parent string, interface boolean, project boolean")
    declared = spark.createDataFrame([("class:p/Top", "a()V", "PUBLIC", False), ("class:p/Mid", "b()V", "PROTECTED", False), ("class:p/Mid", "s()V", "PUBLIC", True), ("class:p/Mid", "p()V", "PRIVATE", False), ("class:p/Face", "f()V", "PUBLIC", False)], "owner string, signature string, visibility string, static boolean")
    use, low = "method:q/Use#x()V", "method:q/Low#x()V"
    calls = [(use, "class:q/Low", "a()V", "VIRTUAL"), (use, "class:q/Low", "b()V", "VIRTUAL"), (low, "class:q/Low", "b()V", "VIRTUAL"), (low, "class:p/Mid", "b()V", "SPECIAL"), (use, "class:p/Mid", "a()V", "SPECIAL"), (use, "class:q/Low", "s()V", "STATIC"), (use, "class:q/Low", "s()V", "VIRTUAL"), (use, "class:p/Mid", "p()V", "VIRTUAL"), (use, "class:no/Where", "a()V", "VIRTUAL"), (use, "class:p/Face", "f()V", "INTERFACE")]
    out = C.call_declarations(spark.createDataFrame(calls, "caller string, owner string, signature string, kind string"), classes, declared).collect()
    assert sorted((r.caller, r.kind, r.target, r.scope, len(r.chain)) for r in out) == sorted([
        (use, "VIRTUAL", "method:p/Top#a()V", "EXTERNAL", 3), (low, "VIRTUAL", "method:p/Mid#b()V", "PROJECT", 2), (low, "SPECIAL", "method:p/Mid#b()V", "PROJECT", 1),
        (use, "STATIC", "method:p/Mid#s()V", "PROJECT", 2), (use, "INTERFACE", "method:p/Face#f()V", "EXTERNAL", 1),
    ])


def test_generated_classes_enclose_generated_ones(spark):
    nodes = spark.createDataFrame([node("class:A", annotations=["dagger/internal/DaggerGenerated"]), node("class:A$B"), method("method:A$B#x()V"), node("class:C")], S.NODES)
    inner = spark.createDataFrame([("class:A", "class:A$B")], "source string, target string")
    assert {r.id: r.synthesized for r in C.generated_marking(nodes, inner).collect()} == {"class:A": True, "class:A$B": True, "method:A$B#x()V": True, "class:C": False}


def test_keep_rules_with_access_descriptors_and_unknown_hierarchies(make, spark):
    nodes = [node("class:a/One", supertypes=["lib/Base"]), node("class:a/Two", supertypes=["a/One"], visibility="PRIVATE"), node("class:a/Face", kind="INTERFACE")]
    nodes += [method("method:a/One#on(I)V"), method("method:a/One#on(J)V"), method("method:a/One#off()V", modifiers=["STATIC"])]
    g = make(nodes, [edge("class:a/One", m, "MEMBER") for m in ("method:a/One#on(I)V", "method:a/One#on(J)V", "method:a/One#off()V")])
    ids = lambda text, **kw: sorted({(r.node_id, r.reason) for r in K.keep_rules(g, configs.keep_rules(text), **kw).collect()})
    kept = lambda *names: [(n, "KEEP_RULE") for n in names]
    assert ids("-keep class a.One { void on(int); }") == kept("class:a/One", "method:a/One#on(I)V")
    assert ids("-keep !interface a.* { !static *; }") == kept("class:a/One", "class:a/Two", "method:a/One#on(I)V", "method:a/One#on(J)V")
    assert ids("-keepclasseswithmembers class a.* { void off(); void on(long); }") == kept("class:a/One", "method:a/One#off()V", "method:a/One#on(J)V")
    known = spark.createDataFrame([("lib/Base", [])], "name string, supertypes array<string>")
    assert ids("-keep class * extends a.One", hierarchy=known) == kept("class:a/Two")
    with pytest.raises(ValueError, match="rules.pro:1"):
        ids("-keep class * extends lib.Other")
    unknown = K.keep_rules(g, configs.keep_rules("-keep class * extends lib.Other"), lenient=True)
    assert {r.reason for r in unknown.collect()} == {"UNKNOWN_KEEP_RULE"} and unknown.count() == 6
    rules = [*configs.keep_rules("-keep class b.**"), {"unresolved": True, "path": "x.pro", "line": 9}]
    assert [(r.path, r.line) for r in K.unmatched_rules(rules, K.keep_rules(g, rules)).collect()] == [("rules.pro", 1)]


def test_hints_and_tests(make, spark):
    g = make([node("class:a/Main", annotations=["dagger/hilt/android/AndroidEntryPoint"], path="app/src/main/java/a/Main.kt"), node("class:a/MainTest", path="app/src/test/java/a/MainTest.kt"), node("class:a/MainTest$In"), method("method:a/MainTest$In#x()V")])
    assert [r.hint for r in W.input_hints(g, 1, 0, 2).orderBy("ord").collect()] == ["MISSING_CLASSPATH", "HILT_TRANSFORM_NOT_OBSERVED"]
    assert {r.id for r in W.test_nodes(g).collect()} == {"class:a/MainTest", "class:a/MainTest$In", "method:a/MainTest$In#x()V"}
    out, said = W.test_scope(g, spark.createDataFrame([("class:a/Main",)], "id string"))
    assert [r.id for r in out.nodes.collect()] == ["class:a/Main"] and tuple(said.first()) == ("TESTS_LEFT_OUT", 3)
    out, said = W.test_scope(g, spark.createDataFrame([("class:a/MainTest",)], "id string"))
    assert out is g and tuple(said.first()) == ("TEST_ROOTS", 1)


def test_symbol_and_why_documents(make, spark):
    import json

    g = make([node("class:p/A"), node("class:p/B", name="B"), node("class:p/C"), node("class:q/B", name="B")], [edge("class:p/A", "class:p/B", lines=[7]), edge("class:p/B", "class:p/C", "REFERENCE")])
    evidence = spark.createDataFrame([("class:p/A", "KEEP_RULE", "r.pro", 3)], S.RETENTION)
    reached = R.reach(g, evidence)
    doc = lambda name: json.loads(Q.symbol_document(g, evidence, reached, name).first().document)
    r = doc("p.B")["result"]
    assert r["reachability"] == {"state": "reachable", "path": ["p.A", "p.B"], "suppressed_by_baseline": False}
    assert [x["id"] for x in r["used_by"]] == ["class:p/A"] and [x["id"] for x in r["depends_on"]] == ["class:p/C"]
    assert doc("B")["status"] == "ambiguous" and len(doc("B")["candidates"]) == 2 and doc("nothing")["status"] == "notFound"
    lines = [r.line for r in Q.why_document(g, evidence, reached, "p.B", ["static"]).orderBy("ord", "line").collect()]
    assert lines == ["subject\tclass:p/B\tp.B\tclass\t-", "state\treachable", "path\tp.A -> p.B", "usedBy\t1", "caller\tp.A\tcall", "limitation\tstatic"]


def test_keep_rules_on_annotated_members(make, spark):
    nodes = [node("class:a/b/c/One"), node("class:Plain"), method("method:a/b/c/One#x()V", annotations=["a/Keep"]), method("method:a/b/c/One#y()V"), method("method:Plain#z()V", annotations=["a/Keep", "a/Other"])]
    g = make(nodes, [edge("class:a/b/c/One", "method:a/b/c/One#x()V", "MEMBER"), edge("class:a/b/c/One", "method:a/b/c/One#y()V", "MEMBER"), edge("class:Plain", "method:Plain#z()V", "MEMBER")])
    ids = lambda text: sorted(r.node_id for r in K.keep_rules(g, configs.keep_rules(text)).collect())
    assert ids("-keepclassmembers class * { @a.Keep *; }") == ["method:Plain#z()V", "method:a/b/c/One#x()V"]
    assert ids("-keepclassmembers class a.b.** { @a.* public void *(); }") == ["method:a/b/c/One#x()V"]
    assert ids("-keepclasseswithmembers class * { @a.Other <methods>; }") == ["class:Plain", "method:Plain#z()V"]
    assert ids("-keep class Plain\n-keep class a.b.c.One\n-keep class a.b.x.One\n") == ["class:Plain", "class:a/b/c/One"]
