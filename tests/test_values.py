import pytest

from tests.test_graph import make, node  # noqa: F401
from weftgraph.operators import values as V


def method(id_, kind="METHOD", **kw):
    return node(id_, kind=kind, **kw)


@pytest.fixture(scope="module")
def run(make, spark):  # noqa: F811
    nodes = [node("class:a/One", supertypes=["a/Up", "a/Face"]), node("class:a/Two"), node("class:a/Up"), node("class:a/Face", kind="INTERFACE"), node("class:a/P")]
    nodes += [method("method:a/One#<init>()V", "CONSTRUCTOR"), method("method:a/One#<init>(ILjava/lang/String;[J)V", "CONSTRUCTOR"), method("method:a/Up#go(I)V"), method("method:a/One#go()V", visibility="PRIVATE"), method("method:a/One#own()V", visibility="PRIVATE")]
    nodes += [method("field:a/Up#F:I", "FIELD"), method("field:a/Face#F:I", "FIELD"), method("field:a/One#G:I", "FIELD", visibility="PRIVATE")]
    g = make(nodes, [])

    def f(constants, copies, operations, calls, opaque=(), limit=V.LIMIT):
        values = V.propagate(spark.createDataFrame(constants, V.CONSTANTS), spark.createDataFrame([(x,) for x in opaque], "var string"), spark.createDataFrame(copies, V.COPIES), spark.createDataFrame(operations, V.OPERATIONS), limit)
        services = spark.createDataFrame([("a/Face", "a/P"), ("a/Face", "b/Gone")], "service string, provider string")
        edges, counts = V.runtime_values(g, values, spark.createDataFrame(calls, V.CALLS), services)
        return {(r.source, r.target): r.weight for r in edges.collect()}, {(r.operation, r.state): r.n for r in counts.collect()}, {(r.var, r.value) for r in values.known.collect()}, {r.var for r in values.uncertain.collect()}

    return f


def test_names_become_classes_and_members(run):
    constants = [("p", "STRING", "a."), ("o", "STRING", "One"), ("go", "STRING", "go"), ("f", "STRING", "F"), ("g", "STRING", "G"), ("own", "STRING", "own"), ("no", "STRING", "b.No"), ("svc", "CLASS", "a/Face")]
    operations = [("n", "CONCAT", "p", "o"), ("c", "CLASS_OF_NAME", "n2", None), ("m", "METHOD_OF", "c", "go"), ("mf", "FIELD_OF", "c", "f"), ("mg", "FIELD_OF", "c", "g"), ("dg", "DECLARED_FIELD_OF", "c", "g"), ("d", "DECLARED_METHOD_OF", "c", "own"), ("nc", "CLASS_OF_NAME", "no", None), ("bad", "CONCAT", "svc", "o")]
    calls = [("x", 0, "CLASS_LOADING", "c", None), ("x", 5, "CLASS_LOADING", "c", None), ("k", 0, "CONSTRUCTION", "c", 3), ("k2", 0, "CONSTRUCTION", "c", None), ("i", 0, "METHOD_INVOCATION", "m", None), ("i2", 0, "METHOD_INVOCATION", "m", 0), ("j", 0, "METHOD_INVOCATION", "d", 0),
             ("q", 0, "FIELD_ACCESS", "mf", None), ("q2", 0, "FIELD_ACCESS", "mg", None), ("q3", 0, "FIELD_ACCESS", "dg", None), ("s", 0, "SERVICE_LOADING", "svc", None), ("z", 0, "CLASS_LOADING", "nc", None), ("z2", 0, "CLASS_LOADING", "bad", None), ("z3", 0, "CLASS_LOADING", "o", None)]
    edges, counts, known, uncertain = run(constants, [("n", "n2")], operations, calls)
    assert ("n2", "a.One") in known and not uncertain
    assert edges == {("x", "class:a/One"): 2, ("k", "method:a/One#<init>(ILjava/lang/String;[J)V"): 1, ("k2", "method:a/One#<init>()V"): 1, ("k2", "method:a/One#<init>(ILjava/lang/String;[J)V"): 1, ("i", "method:a/Up#go(I)V"): 1, ("j", "method:a/One#own()V"): 1, ("q", "field:a/Face#F:I"): 1, ("q3", "field:a/One#G:I"): 1, ("s", "class:a/P"): 1}
    assert counts == {("CLASS_LOADING", "resolved"): 2, ("CLASS_LOADING", "outside"): 1, ("CLASS_LOADING", "unresolved"): 2, ("CONSTRUCTION", "resolved"): 2, ("METHOD_INVOCATION", "resolved"): 2, ("METHOD_INVOCATION", "outside"): 1, ("FIELD_ACCESS", "resolved"): 2, ("FIELD_ACCESS", "outside"): 1, ("SERVICE_LOADING", "resolved"): 1}


def test_unknown_values_leave_known_ones(run):
    calls = [("x", 0, "CLASS_LOADING", "j", None), ("y", 0, "CLASS_LOADING", "k", None)]
    edges, counts, _, uncertain = run([("a", "CLASS", "a/One"), ("k", "CLASS", "a/Two")], [("a", "j"), ("b", "j")], [], calls, opaque=["b"])
    assert edges == {("x", "class:a/One"): 1, ("y", "class:a/Two"): 1} and uncertain == {"b", "j"}
    assert counts == {("CLASS_LOADING", "unresolved"): 1, ("CLASS_LOADING", "resolved"): 1}


def test_too_many_values_are_none_and_what_came_from_them_goes(run):
    constants = [("s", "STRING", ""), ("one", "STRING", "x"), ("few", "CLASS", "a/One")] + [(f"v{i}", "CLASS", f"a/C{i}") for i in range(5)]
    copies = [("loop", "s"), ("few", "out")] + [(f"v{i}", "many") for i in range(5)] + [("many", "out"), ("out", "end")]
    _, _, known, uncertain = run(constants, copies, [("loop", "CONCAT", "s", "one")], [("x", 0, "CLASS_LOADING", "end", None)], limit=4)
    assert {v for k, v in known if k == "end"} == {"a/One"} and not {k for k, _ in known} & {"s", "loop", "many"}
    assert {"s", "loop", "many", "out", "end"} <= uncertain and "few" not in uncertain
