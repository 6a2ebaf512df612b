from tests.test_graph import node
from weftgraph import schema as S
from weftgraph.functions.headers import headers
from weftgraph.sources.locations import declaration_locations, source_headers

JAVA = '''// class Fake { void no() {} }
package a.b;
import java.util.*;
@Deprecated(since = "class X { int y; }")
public final class Outer<T extends Comparable<T>> implements Runnable {
    private static final int A = f(1, 2), B[] = {1, 2};
    Map<String, List<T>> map;
    static { int local = 3; }
    public Outer() { this(1); }
    Outer(int a) { class Local { void hidden() {} } }
    @Override public void run() { if (true) { call(); } }
    <R> R pair(Map<String, R> m, R... rest) throws Exception { return null; }
    void run(int n) {}
    abstract static class Inner { abstract int size(); int[] many() { return new int[0]; } }
    enum Color { RED, GREEN(2) { void x() {} }, BLUE; int code; Color() {} Color(int c) {} }
    record Point(int x, int y) { int sum() { return x + y; } }
    @interface Mark { String value() default ""; }
}
interface Other { void go(); }
'''
KOTLIN = '''package a.b
/* fun no() {} */
class Box<T>(val size: Int, name: String = "fun x()") : Base(size) {
    constructor(a: Int) : this(a, "") { val local = 1 }
    private val cache: Map<String, Int> = mapOf("a" to 1)
    var count = 0
    fun go(a: Int, f: (Int, Int) -> Int = { x, y -> x + y }): Int = f(a, a)
    fun <R> map(x: R): R { fun inner() {}; return x }
    companion object { fun make() = Box<Int>(1) }
    object Named { val z = 1 }
    fun String.ext() = 1
}
interface Face { fun one(); fun two(a: Int) }
data class Plain(val a: Int)
class Last
fun top(x: Int) {}
'''


def shape(text, kotlin):
    package, found = headers(text, kotlin)
    assert all(text[h.offset :].startswith(h.name if h.kind != "CONSTRUCTOR" else h.owners[-1]) or text[h.offset :].startswith("constructor") for h in found if h.name != "Companion")
    return package, [("$".join(h.owners), h.kind[0], h.name, h.arity) for h in found]


def test_java():
    package, found = shape(JAVA, False)
    assert package == "a.b"
    assert found == [
        ("Outer", "T", "Outer", None), ("Outer", "F", "A", None), ("Outer", "F", "B", None), ("Outer", "F", "map", None), ("Outer", "C", "<init>", 0), ("Outer", "C", "<init>", 1), ("Outer", "M", "run", 0), ("Outer", "M", "pair", 2), ("Outer", "M", "run", 1),
        ("Outer$Inner", "T", "Inner", None), ("Outer$Inner", "M", "size", 0), ("Outer$Inner", "M", "many", 0), ("Outer$Color", "T", "Color", None), ("Outer$Color", "F", "RED", None), ("Outer$Color", "F", "GREEN", None), ("Outer$Color", "F", "BLUE", None), ("Outer$Color", "F", "code", None),
        ("Outer$Color", "C", "<init>", 0), ("Outer$Color", "C", "<init>", 1), ("Outer$Point", "T", "Point", None), ("Outer$Point", "M", "sum", 0), ("Outer$Mark", "T", "Mark", None), ("Outer$Mark", "M", "value", 0), ("Other", "T", "Other", None), ("Other", "M", "go", 0),
    ]


def test_kotlin():
    package, found = shape(KOTLIN, True)
    assert package == "a.b"
    assert found == [
        ("Box", "T", "Box", None), ("Box", "C", "<init>", 2), ("Box", "F", "size", None), ("Box", "C", "<init>", 1), ("Box", "F", "cache", None), ("Box", "F", "count", None), ("Box", "M", "go", 2), ("Box", "M", "map", 1), ("Box$Companion", "T", "Companion", None), ("Box$Companion", "M", "make", 0),
        ("Box$Named", "T", "Named", None), ("Box$Named", "F", "z", None), ("Face", "T", "Face", None), ("Face", "M", "one", 0), ("Face", "M", "two", 1), ("Plain", "T", "Plain", None), ("Plain", "C", "<init>", 1), ("Plain", "F", "a", None), ("Last", "T", "Last", None), ("", "M", "top", 1),
    ]


def test_odd_texts_end():
    for text in ("", "{", "}", "class", "class A {", "class A { int", "@", "class A { void f(", "<", "package", "fun", "class A(", '"', "enum E { A", "class A { x = ", "} class B {}"):
        for kotlin in (False, True):
            headers(text, kotlin)


def test_only_unique_matches_are_located(spark):
    sources = spark.createDataFrame([("src/Outer.java", JAVA), ("src/Box.kt", KOTLIN), ("readme.md", "class X {}"), ("e.java", None)], "path string, text string")
    ids = ["class:a/b/Outer", "class:a/b/Outer$Inner", "method:a/b/Outer#run()V", "method:a/b/Outer#run(I)V", "method:a/b/Outer#pair(Ljava/util/Map;[Ljava/lang/Object;)V", "field:a/b/Outer#map:Ljava/util/Map;", "method:a/b/Box#go(ILx/F;)I", "class:c/Outer", "method:a/b/Outer#none()V"]
    kind = lambda i: "CLASS" if i.startswith("class") else "FIELD" if i.startswith("field") else "METHOD"
    nodes = spark.createDataFrame([node(i, kind=kind(i)) for i in ids] + [node("method:a/b/Outer#run(J)V", kind="METHOD")], S.NODES)
    paths = nodes.select("id").selectExpr("id", "CASE WHEN id LIKE '%Box%' THEN 'src/Box.kt' ELSE 'src/Outer.java' END AS path")
    got = {r.id: (r.line, r.column, r.offset) for r in declaration_locations(nodes, source_headers(sources), paths).collect()}
    # two nodes have a run of one parameter; the class of another package has no header
    assert set(got) == {*ids[:3], *ids[4:7]}
    line, column, offset = got["method:a/b/Outer#run()V"]
    assert (line, column) == (11, 27) and JAVA[offset:].startswith("run()")
