import pytest

from tests.test_graph import make, node  # noqa: F401
from weftgraph.operators import universe as U

SCHEMAS = {"inventories": U.INVENTORIES, "sources": U.SOURCES, "bodies": U.BODIES, "methods": U.METHODS, "outputs": U.OUTPUTS, "coverage": U.COVERAGE}
A, B = "method:p/A#a()V", "method:p/A#b()V"


def facts():
    return {
        "inventories": [("i", "m", False, "s1")],
        "sources": [("i", "A.kt")],
        "bodies": [("i", "b1", "A.kt", "ORDINARY_METHOD", [A], True, True, 3, 9), ("i", "b2", "A.kt", "ABSTRACT_METHOD", [B], False, True, 12, 14)],
        "methods": [("i", A, "b1", True, False, True), ("i", B, "b2", False, True, True)],
        "outputs": [("i", "p/A")],
        "coverage": [(A, "A.kt", 3, 9, "s1", True)],
    }


def changed(name, i, **kw):
    """The facts with some values of one row replaced; without any, with the row left out."""
    out = facts()
    columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
    if kw:
        out[name][i] = tuple((dict(zip(columns, out[name][i], strict=True)) | kw).values())
    else:
        del out[name][i]
    return out


CASES = [
    ("whole", facts(), "COMPLETE", set()),
    ("partial", changed("coverage", 0, whole=False), "INCOMPLETE", {("COVERAGE_PARTIAL", None)}),
    ("kind", changed("bodies", 0, kind="LAMBDA"), "INCOMPLETE", {("BODY_KIND", "LAMBDA")}),
    ("no coverage", changed("coverage", 0), "UNKNOWN", {("COVERAGE_MISSING", None)}),
    ("other compiler", changed("coverage", 0, stamp="s2"), "UNKNOWN", {("COVERAGE_MISSING", None)}),
    ("no code", changed("methods", 0, code=False), "UNKNOWN", {("BODY_CONTRADICTS", None)}),
    ("two methods", changed("bodies", 0, methods=[A, B]), "UNKNOWN", {("BODY_WITHOUT_METHOD", None)}),
    ("projected", changed("inventories", 0, projected=True), "UNKNOWN", {("OUTPUT_PROJECTED", None)}),
    ("no source", changed("sources", 0), "UNKNOWN", {("SOURCE_MISSING", None), ("SOURCES_DIFFER", None)}),
    ("class", changed("outputs", 0, owner="p/Z"), "UNKNOWN", {("CLASSES_DIFFER", None)}),
    ("origin", changed("methods", 1, origin_known=False), "UNKNOWN", {("ORIGIN_UNKNOWN", None)}),
]


@pytest.mark.parametrize("name,rows,status,codes", CASES, ids=[c[0] for c in CASES])
def test_authored_universe(make, spark, name, rows, status, codes):  # noqa: F811
    g = make([node("class:p/A"), node(A, kind="METHOD"), node(B, kind="METHOD")], [])
    frames = {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()}
    kinds = ("ORDINARY_METHOD", "ABSTRACT_METHOD", "LAMBDA")
    u = U.authored_universe(g, spark.createDataFrame([("m", "A.kt")], U.SCOPE), kinds, frames, whole=True)
    state = u.state.first()
    assert (state.status, state.bodies) == (status, 2)
    assert {(r.code, r.detail) for r in u.faults.collect()} == codes


def test_resources(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    definitions = frame([("r/layout/a.xml", "a"), ("r/layout-land/a.xml", "a"), ("r/layout/b.xml", "b"), ("r/layout/c.xml", "c"), ("r/layout/d.xml", "d")], U.DEFINITIONS)
    includes = frame([("1", "b", "a", True), ("2", "c", "b", True), ("3", "a", "c", True), ("4", "d", "a", False)], U.INCLUDES)
    fields = frame([("a", "R.a"), ("b", None), ("c", "R.c"), ("d", "R.d")], U.FIELDS)
    asked = frame([(x,) for x in ("r/layout/a.xml", "r/layout/gone.xml", "q/layout/a.xml", "../layout/a.xml", "r/values/a.xml")], "path string")
    got = U.resource_impact(asked, definitions, includes, ["r"], fields)
    assert got.status == "ADMITTED"
    assert {r.path: r.status for r in got.files.collect()} == {"r/layout/a.xml": "MATCHED", "r/layout/gone.xml": "ABSENT", "q/layout/a.xml": "OUTSIDE_ROOT", "../layout/a.xml": "INVALID_PATH", "r/values/a.xml": "INVALID_PATH"}
    assert {(r.key, r.depth, r.field) for r in got.resources.collect()} == {("a", 0, "R.a"), ("b", 1, None), ("c", 2, "R.c")}
    assert sorted(r.include for r in got.includes.collect()) == ["1", "2", "3"]
    for limits in ((4, 9, 9, 9), (9, 2, 9, 9), (9, 9, 3, 9), (9, 9, 9, 2)):
        got = U.resource_impact(asked, definitions, includes, ["r"], fields, limits)
        assert got.status == "REFUSED" and not got.resources.count() and {r.status for r in got.files.collect()} == {"BUDGET_EXCEEDED"}
    assert {r.status for r in U.resource_impact(asked, None, None, [], fields).files.collect()} == {"EVIDENCE_UNAVAILABLE", "INVALID_PATH"}
    got = U.resource_impact(asked, definitions, includes, ["r"], None)
    assert got.status == "UNAVAILABLE" and {r.status for r in got.files.collect()} == {"BINDING_UNAVAILABLE", "INVALID_PATH"}
