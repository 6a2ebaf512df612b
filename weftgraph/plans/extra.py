"""More registered queries over the star graph: callbacks, declarations, reviews, uses, documents, functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph import graph as G
from weftgraph.operators import callbacks as C
from weftgraph.operators import dispatch as V
from weftgraph.operators import impact as I
from weftgraph.operators import query as Q
from weftgraph.operators import reach as R
from weftgraph.operators import retention as K
from weftgraph.operators import review as W
from weftgraph.operators import traverse as T
from weftgraph.plans import star
from weftgraph.plans.queries import query, walk

# callbacks and declarations


@query("""SELECT 'class:customer/' || o_custkey AS source, 'method:customer/' || o_custkey || '#order' || o_orderkey || '()V' AS target, 'REFERENCE' AS kind, 'RUNTIME_MODEL' AS origin
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey WHERE n_regionkey = 2 AND o_orderkey % 3 <> 0""", plain=True)
def edge_runtime_callbacks(spark, d):
    return C.runtime_callbacks(star.graph(spark, d), ("region/2",))


def _faces(spark, d):
    """Nations as interfaces below regions; regions of even key declare run()V, and one has a body."""
    n = star.nodes(spark, d).filter("id LIKE 'class:region/%' OR id LIKE 'class:nation/%' OR id LIKE 'class:customer/%'").withColumn("kind", F.when(F.col("id").startswith("class:customer"), "CLASS").otherwise("INTERFACE"))
    region = n.filter("id LIKE 'class:region/%' AND line % 2 = 1").withColumns({"id": F.concat(F.lit("method:"), F.expr("substr(id, 7)"), F.lit("#run()V")), "name": F.lit("run"), "kind": F.lit("METHOD"), "modifiers": F.when(F.col("line") == 5, F.array().cast("array<string>")).otherwise(F.array(F.lit("ABSTRACT")))})
    calls = n.filter("id LIKE 'class:customer/%'").select(F.col("id").alias("caller"), F.concat(F.lit("class:"), F.get("supertypes", F.lit(0))).alias("owner"), F.lit("run()V").alias("signature"), F.lit("INTERFACE").alias("kind"))
    return G.Graph(n.unionByName(region), star.graph(spark, d).edges), calls


@query("""SELECT 'class:customer/' || c_custkey AS source, 'method:region/' || n_regionkey || '#run()V' AS target, CAST(1 AS BIGINT) AS weight
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE n_regionkey IN (0, 2)""", plain=True)
def edge_inherited_interface_call(spark, d):
    g, calls = _faces(spark, d)
    return C.inherited_interface_calls(g, calls).select("source", "target", "weight")


@query("""SELECT 'method:order/' || o_orderkey || '#go()V' AS caller, 'class:customer/' || o_custkey AS owner,
  CASE WHEN n_nationkey % 3 = 0 THEN 'method:nation/' || n_nationkey ELSE 'method:region/' || n_regionkey END || '#run()V' AS target,
  CASE WHEN n_nationkey % 3 = 0 THEN 'PROJECT' ELSE 'EXTERNAL' END AS scope,
  'class:customer/' || o_custkey || ',class:nation/' || n_nationkey || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE ',class:region/' || n_regionkey END AS chain
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey WHERE n_nationkey % 3 = 0 OR n_regionkey % 2 = 0""", plain=True)
def call_declaration(spark, d):
    t = lambda name: star.table(spark, d, name)
    classes = t("customer").selectExpr("'class:customer/' || c_custkey AS id", "'class:nation/' || c_nationkey AS parent", "true AS project")
    classes = classes.union(t("nation").selectExpr("'class:nation/' || n_nationkey", "'class:region/' || n_regionkey", "true")).union(t("region").selectExpr("'class:region/' || r_regionkey", "CAST(NULL AS STRING)", "false"))
    classes = classes.union(t("orders").selectExpr("'class:order/' || o_orderkey", "CAST(NULL AS STRING)", "true")).withColumn("interface", F.lit(False))
    declared = t("nation").filter("n_nationkey % 3 = 0").selectExpr("'class:nation/' || n_nationkey AS owner").union(t("region").filter("r_regionkey % 2 = 0").selectExpr("'class:region/' || r_regionkey"))
    declared = declared.selectExpr("owner", "'run()V' AS signature", "'PUBLIC' AS visibility", "false AS static")
    calls = t("orders").selectExpr("'method:order/' || o_orderkey || '#go()V' AS caller", "'class:customer/' || o_custkey AS owner", "'run()V' AS signature", "'VIRTUAL' AS kind")
    return C.call_declarations(calls, classes, declared).select("caller", "owner", "target", "scope", F.array_join("chain", ",").alias("chain"))


@query("""SELECT id, synthesized OR id IN (SELECT id FROM made) OR 'class:' || split_part(substr(id, 8), '#', 1) IN (SELECT id FROM made) AS synthesized FROM nodes""",
       walk("SELECT 'class:nation/' || n_nationkey AS id FROM nation WHERE n_nationkey % 5 = 0", "SELECT source, target FROM edges WHERE kind = 'MEMBER' AND target LIKE 'class:customer/%'", "made"))
def generated_marking(spark, d):
    g = star.graph(spark, d)
    inner = g.edges.filter("kind = 'MEMBER' AND target LIKE 'class:customer/%'").select("source", "target")
    start = star.table(spark, d, "nation").filter("n_nationkey % 5 = 0").selectExpr("'class:nation/' || n_nationkey AS id")
    return C.generated_marking(g.nodes, inner, start).select("id", "synthesized")


# reviews


@query("SELECT * FROM (VALUES (0, 'MISSING_KEEP_RULES'), (2, 'MANIFEST_WITHOUT_COMPONENTS')) AS t(ord, hint)", plain=True)
def input_hints(spark, d):
    return W.input_hints(star.vertices(spark, d), keep_rules=0, classpath=3, manifest_components=0).select("ord", "hint")


@query("SELECT o_orderpriority AS path, CAST(sum(o_orderkey % 3 + o_orderkey % 5) AS BIGINT) AS channels FROM {orders} GROUP BY o_orderpriority", plain=True)
def channel_counts(spark, d):
    seen = star.table(spark, d, "orders").selectExpr("o_orderpriority AS path", "CAST(o_orderkey % 3 AS INT) AS reflection_calls", "CAST(o_orderkey % 5 AS INT) AS native_methods")
    return W.channel_counts(seen)


@query("""WITH s AS (SELECT p_brand || '/F' || p_partkey || '.kt' AS path, 'F' || p_partkey || '.kt' AS file, CAST(p_size AS BIGINT) * 10 AS modified FROM {part}
  UNION ALL SELECT 'other/F' || p_partkey || '.kt', 'F' || p_partkey || '.kt', 0 FROM {part} WHERE p_partkey % 13 = 0),
o AS (SELECT 'F' || l_partkey || '.kt' AS file, CAST(l_quantity AS BIGINT) * 12 AS made, CASE WHEN l_linenumber % 2 = 0 THEN 200 ELSE 0 END AS precision_ms FROM {lineitem})
SELECT path, CASE WHEN count(DISTINCT other) > 1 OR count(made) = 0 THEN 'unknown' WHEN bool_or(CASE WHEN precision_ms = 0 THEN modified > made ELSE modified >= made + precision_ms END) THEN 'stale'
  WHEN bool_or(modified > made) THEN 'unknown' ELSE 'current' END AS status
FROM (SELECT s.*, x.path AS other FROM s JOIN s x USING (file)) LEFT JOIN o USING (file) GROUP BY path""", plain=True)
def staleness(spark, d):
    part, line = star.table(spark, d, "part"), star.table(spark, d, "lineitem")
    sources = part.selectExpr("p_brand || '/F' || p_partkey || '.kt' AS path", "CAST(p_size AS BIGINT) * 10 AS modified").union(part.filter("p_partkey % 13 = 0").selectExpr("'other/F' || p_partkey || '.kt'", "0L"))
    outputs = line.selectExpr("'F' || l_partkey || '.kt' AS file", "CAST(l_quantity AS BIGINT) * 12 AS modified", "CASE WHEN l_linenumber % 2 = 0 THEN 200 ELSE 0 END AS precision_ms")
    return W.staleness(sources, outputs)


TESTS = {"tests": "SELECT id FROM nodes WHERE path LIKE 'src/test/%'"}


@query("SELECT id FROM tests", TESTS)
def test_nodes(spark, d):
    return W.test_nodes(star.graph(spark, d))


@query("SELECT 'TESTS_IN_USE' AS code, count(*) AS n FROM edges WHERE kind <> 'OVERRIDE' AND target IN (SELECT id FROM tests) AND source NOT IN (SELECT id FROM tests)", TESTS)
def test_scope(spark, d):
    g = star.graph(spark, d)
    return W.test_scope(g, g.nodes.filter("id = 'class:region/1'").select("id"))[1]


@query("""SELECT kind, origin, count(*) AS n, (SELECT count(*) FROM tests) AS left_out FROM edges
WHERE kind IN ('MEMBER', 'INHERITANCE', 'OVERRIDE') AND source NOT IN (SELECT id FROM tests) AND target NOT IN (SELECT id FROM tests) GROUP BY kind, origin""", TESTS)
def test_scope_excluding(spark, d):
    """Without the references into tests, these are left out."""
    g = star.graph(spark, d)
    tests = W.test_nodes(g)
    safe = g.edges.filter("kind = 'INHERITANCE' OR kind = 'OVERRIDE'").unionByName(g.edges.filter("kind = 'MEMBER'").join(tests.withColumnRenamed("id", "target"), "target", "left_anti").select(*g.edges.columns))
    safe = safe.join(tests.withColumnRenamed("id", "target"), "target", "left_anti").select(*g.edges.columns).unionByName(safe.filter("kind = 'OVERRIDE'").join(tests.withColumnRenamed("id", "target"), "target", "left_semi").select(*g.edges.columns))
    scoped, said = W.test_scope(G.Graph(g.nodes, safe, g.facts), g.nodes.filter("id = 'class:region/1'").select("id"))
    return scoped.edges.groupBy("kind", "origin").agg(F.count("*").alias("n")).crossJoin(said.filter("code = 'TESTS_LEFT_OUT'").select(F.col("n").alias("left_out")))


@query("SELECT id FROM nodes WHERE path LIKE '%/NATION_3/customer.kt' OR path = 'src/main/region.kt'")
def changed_since(spark, d):
    files = spark.createDataFrame([("repo/src/main/java/NATION_3/customer.kt",), ("src/main/region.kt",), ("java/none.kt",)], "path string")
    return W.changed_since(star.graph(spark, d), files)


@query("""SELECT o AS ord, code, CAST(n AS BIGINT) AS n, CAST(bound AS BIGINT) AS bound FROM (
  SELECT 0 AS o, 'LONG_PATHS' AS code, count(*) AS n, 9 AS bound FROM {orders} WHERE o_orderpriority <> '5-LOW'
  UNION ALL SELECT 2, 'OTHER_PAGES', count(*) - 100, NULL FROM {orders} UNION ALL SELECT 3, 'STATIC_VIEW', NULL, NULL
  UNION ALL SELECT 4, 'NO_FILE', count(*), NULL FROM {part} WHERE p_partkey % 11 = 0)""", plain=True)
def impact_limitations(spark, d):
    items = star.table(spark, d, "orders").select(F.when(F.col("o_orderpriority") == "5-LOW", "COMPLETE").otherwise("PARTIAL").alias("path_status"))
    return W.impact_limitations(items, star.nodes(spark, d), 9, 1000, [], limit=100)


@query("""SELECT o AS ord, code, CAST(n AS BIGINT) AS n, CAST(NULL AS BIGINT) AS bound FROM (SELECT 0 AS o, 'ONLY_GIVEN_ROOTS' AS code, NULL AS n UNION ALL SELECT 2, 'NO_ARTIFACTS', NULL
UNION ALL SELECT 3, 'SCOPE_NOT_JUDGED', count(*) FROM {part} WHERE p_brand LIKE '%2' HAVING count(*) > 0 UNION ALL SELECT 4, 'NO_CLASSES', count(*) FROM {part} WHERE p_brand LIKE '%3' HAVING count(*) > 0)""", plain=True)
def dep_limitations(spark, d):
    status = F.when(F.col("p_brand").endswith("2"), "skipped").when(F.col("p_brand").endswith("3"), "withoutClasses").otherwise("used")
    return W.dependency_limitations(star.table(spark, d, "part").select(status.alias("status")), test_given=True, resolved_given=False)


@query("""SELECT o AS ord, code, CAST(n AS BIGINT) AS n, CAST(bound AS BIGINT) AS bound FROM (SELECT 0 AS o, 'NO_SUCH_ROOT' AS code, 1 AS n, NULL AS bound
UNION ALL SELECT 1, 'TOO_DEEP', NULL, max(depth) FROM found HAVING max(depth) > 0 UNION ALL SELECT 2, 'TOO_MANY', count(*), 20 FROM found HAVING count(*) >= 20 UNION ALL SELECT 3, 'STATIC_VIEW', NULL, NULL)""",
       {"found": """SELECT id, min(depth) AS depth FROM (SELECT target AS id, 1 AS depth FROM edges WHERE source = 'class:region/1' AND kind = 'MEMBER'
         UNION ALL SELECT b.target, 2 FROM edges a JOIN edges b ON a.target = b.source WHERE a.source = 'class:region/1' AND a.kind = 'MEMBER' AND b.kind = 'MEMBER'
         UNION ALL SELECT c.target, 3 FROM edges a JOIN edges b ON a.target = b.source JOIN edges c ON c.source = b.target WHERE a.source = 'class:region/1' AND a.kind = 'MEMBER' AND b.kind = 'MEMBER' AND c.kind = 'MEMBER') GROUP BY id"""})
def trav_limitations(spark, d):
    """Of what region 1 holds, at any remove."""
    g = star.graph(spark, d)
    asked = ["class:region/1", "no such"]
    roots = T.resolve_roots(g.nodes, asked)
    e = g.edges.filter("kind = 'MEMBER'").select("source", "target", F.lit("member").alias("relationship"), F.lit("DIRECT").alias("tier"), F.lit(None).cast("string").alias("class_role"))
    return W.traversal_limitations(T.traverse(e, roots, max_depth=3, max_reached=None), roots, asked, max_depth=3, max_reached=20)


# uses in source, enum decisions, layouts

USES = "SELECT 'method:customer/' || o_custkey || '#order' || o_orderkey || '()V' AS source, 'class:part/' || l_partkey AS target, 'f' || l_linenumber AS path, CAST(l_linenumber AS INT) AS line FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey UNION ALL SELECT 'class:part/' || p_partkey, 'class:part/' || (p_partkey + 1), 'p', 1 FROM {part}"


def _uses(spark, d):
    return spark.sql(USES, **{t: star.table(spark, d, t) for t in ("lineitem", "orders", "part")})


@query("SELECT source, target, path, line FROM uses WHERE target IN ('class:part/5', 'class:part/6', 'class:part/77') AND source NOT IN ('class:part/5', 'class:part/6', 'class:part/77')", {"uses": star.filled(USES)})
def source_edit_impact(spark, d):
    changed = spark.createDataFrame([("class:part/5",), ("class:part/6",), ("class:part/77",)], "id string")
    return I.source_edit_impact(_uses(spark, d), changed).select("source", "target", "path", "line")


SUBJECT = "WHERE u.source = 'class:part/77' OR u.target = 'class:part/77'"


@query(f"""SELECT u.source, u.target, u.path, u.line, CASE WHEN u.target = 'class:part/77' THEN 'incoming' ELSE 'outgoing' END AS direction,
  EXISTS (SELECT 1 FROM edges e WHERE e.source = u.source AND e.target = u.target AND e.kind = 'CALL' AND e.origin = 'BYTECODE') AS matching_bytecode_call FROM uses u {SUBJECT}""", {"uses": star.filled(USES)})
def source_use_query(spark, d):
    return I.source_use_query(_uses(spark, d), star.graph(spark, d), "class:part/77").select("source", "target", "path", "line", "direction", "matching_bytecode_call")


@query(f"""SELECT n AS matching, callers, least(10, n - least(5, n)) AS returned, least(5, n) AS omitted_before, n - least(5, n) - least(10, n - least(5, n)) AS omitted_after
FROM (SELECT count(*) AS n, count(DISTINCT source) AS callers FROM uses u {SUBJECT})""", {"uses": star.filled(USES)})
def source_use_page(spark, d):
    return W.source_use_page(_uses(spark, d), star.graph(spark, d), "class:part/77", ["target", "source", "path", "line"], limit=10, offset=5)[1].select(*(F.col(c).cast("long").alias(c) for c in ("matching", "callers", "returned", "omitted_before", "omitted_after")))


@query("""SELECT count(*) AS units, CAST(sum(l_quantity) AS BIGINT) AS observed, CAST(sum(l_linenumber) AS BIGINT) AS admitted, CAST(sum(l_linenumber % 2) AS BIGINT) AS unmapped,
  CAST(sum(l_linenumber - l_linenumber % 3) AS BIGINT) AS retained_uses, 'partial' AS coverage FROM {lineitem}""", plain=True)
def source_use_coverage(spark, d):
    zero = "0 AS "
    units = star.table(spark, d, "lineitem").selectExpr("CAST(l_quantity AS INT) AS observed", zero + "emitted", "l_linenumber AS admitted", "l_linenumber % 2 AS unmapped", "l_linenumber % 3 AS view_omitted", *(zero + c for c in ("ambiguous", "outside_graph", "shadowed_caller", "shadowed_target", "outside_claimed_outputs", "source_association_unverified")))
    return W.source_use_coverage(units).select("units", "observed", "admitted", "unmapped", "retained_uses", "coverage")


SITES = "SELECT o_orderkey AS id, 'class:nation/' || c_nationkey AS enum_id, CASE WHEN o_orderkey % 4 = 0 THEN ['A'] WHEN o_orderkey % 4 = 1 THEN ['A', 'B'] ELSE ['C'] END AS constants, o_orderpriority <> '5-LOW' AS resolved FROM {orders} JOIN {customer} ON o_custkey = c_custkey"


def _sites(spark, d):
    rows = star.table(spark, d, "orders").join(star.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    constants = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("A"))).when(F.col("o_orderkey") % 4 == 1, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("C")))
    return rows.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("class:nation/"), "c_nationkey").alias("enum_id"), constants.alias("constants"), (F.col("o_orderpriority") != "5-LOW").alias("resolved"))


def _enums(spark, d):
    n = star.table(spark, d, "nation")
    of = lambda c: n.select(F.concat(F.lit("class:nation/"), "n_nationkey").alias("id"), F.lit("ENUM").alias("kind"), c.alias("enum_constants"))
    a, ab = F.array(F.lit("A")), F.array(F.lit("A"), F.lit("B"), F.lit("C"))
    return of(a), of(F.when(F.col("n_nationkey") % 2 == 0, ab).otherwise(a))


ENUMS = {"sites": star.filled(SITES), "hits": """SELECT id, enum_id, list_sort(list_filter(['B', 'C'], lambda x: NOT list_contains(constants, x))) AS missing, CASE WHEN resolved THEN 'resolved' ELSE 'unresolved' END AS attribution
FROM sites WHERE CAST(split_part(enum_id, '/', 2) AS INT) % 2 = 0"""}


@query("SELECT id, enum_id, array_to_string(missing, ',') AS missing, attribution FROM hits WHERE len(missing) > 0 OR attribution = 'unresolved'", ENUMS)
def enum_expansion(spark, d):
    return I.enum_expansion(*_enums(spark, d), _sites(spark, d)).select("id", "enum_id", F.array_join("missing", ",").alias("missing"), "attribution")


@query("SELECT attribution, count(*) AS n FROM hits WHERE attribution = 'unresolved' GROUP BY attribution", ENUMS)
def enum_reasons(spark, d):
    return W.enum_reasons(I.enum_expansion(*_enums(spark, d), _sites(spark, d)))


@query("SELECT id, enum_id FROM (SELECT * FROM hits WHERE len(missing) > 0 OR attribution = 'unresolved') ORDER BY enum_id, id LIMIT 25 OFFSET 10", ENUMS)
def enum_page(spark, d):
    rows = I.enum_expansion(*_enums(spark, d), _sites(spark, d)).withColumns({"path": F.lit("p"), "offset_utf16": F.lit(0)})
    return W.enum_page(rows, limit=25, offset=10).select("id", "enum_id")


INCLUDES = "SELECT 'l' || p_partkey AS layout, 'l' || (p_partkey // 3) AS included, p_size <> 7 AS literal FROM part WHERE p_partkey // 3 <> p_partkey"


@query("SELECT id FROM reached_layouts", {"includes": INCLUDES} | walk("SELECT 'l2' AS id UNION SELECT 'l5'", "SELECT included AS source, layout AS target FROM includes WHERE literal", "reached_layouts"))
def include_closure(spark, d):
    part = star.table(spark, d, "part").selectExpr("'l' || p_partkey AS layout", "'l' || CAST(floor(p_partkey / 3) AS BIGINT) AS included", "p_size <> 7 AS literal").filter("layout <> included")
    return I.include_closure(part, spark.createDataFrame([("l2",), ("l5",)], "id string"), limit=10**9).select("id")


# calls


@query("SELECT e.source, n.path, r.line FROM edges e JOIN nodes n ON n.id = e.source JOIN (SELECT DISTINCT source, target, line FROM raw_edges WHERE kind = 'CALL' AND line IS NOT NULL) r ON r.source = e.source AND r.target = e.target WHERE e.kind = 'CALL' AND e.target = 'class:part/77'")
def call_references(spark, d):
    return Q.call_references(star.graph(spark, d), "class:part/77")


CALLS = "SELECT 'm' || l_orderkey AS caller, CASE WHEN l_linenumber = 1 THEN 'BOOTSTRAP' WHEN l_linenumber % 2 = 0 THEN 'VIRTUAL' ELSE 'STATIC' END AS kind, CASE WHEN l_partkey % 2 = 0 THEN 'java/lang/invoke/LambdaMetafactory' ELSE 'other/Bootstrap' END AS owner, CASE WHEN l_suppkey % 3 = 0 THEN 'UNRESOLVED' WHEN l_suppkey % 3 = 1 THEN 'RUNTIME_MODEL' ELSE 'NO_PROJECT_TARGET' END AS resolution, CASE WHEN l_partkey % 5 = 0 THEN 'x' END AS model FROM {lineitem}"


@query("""SELECT caller, count(*) AS n FROM calls WHERE CASE WHEN model IS NOT NULL AND resolution <> 'RUNTIME_MODEL' THEN TRUE WHEN kind = 'BOOTSTRAP' THEN owner = 'other/Bootstrap' WHEN kind = 'VIRTUAL' THEN resolution = 'UNRESOLVED' ELSE FALSE END GROUP BY caller""", {"calls": star.filled(CALLS)})
def unresolved_calls(spark, d):
    return V.unresolved_calls(spark.sql(CALLS, lineitem=star.table(spark, d, "lineitem")))


@query("""SELECT 'class:region/' || n_regionkey AS source, 'class:nation/' || n_nationkey AS target, 'contains' AS relationship FROM {nation}
UNION SELECT 'class:nation/' || c_nationkey, 'class:customer/' || c_custkey, 'contains' FROM {customer}
UNION SELECT 'class:nation/' || c_nationkey, 'method:customer/' || o_custkey || '#order' || o_orderkey || '()V', 'contains' FROM {orders} JOIN {customer} ON o_custkey = c_custkey""", plain=True)
def trav_containment(spark, d):
    g = star.graph(spark, d)
    enc = g.edges.filter("kind = 'MEMBER' AND target LIKE 'class:%' AND target NOT LIKE 'class:supplier/%'").select(F.col("target").alias("local_class"), F.col("source").alias("enclosing"))
    return V.containment(G.Graph(g.nodes, g.edges, {"enclosures": enc})).select("source", "target", "relationship")


# retention


@query("SELECT 'class:' || l || '_Impl' AS node_id FROM (SELECT 'part/' || p_partkey AS l FROM {part} WHERE p_partkey % 7 = 0)", plain=True)
def ret_generated_sibling(spark, d):
    n = star.nodes(spark, d).filter("id LIKE 'class:part/%'").withColumn("annotations", F.when(F.substring_index("id", "/", -1).cast("long") % 7 == 0, F.array(F.lit("androidx/room/Database"))).otherwise(F.array().cast("array<string>")))
    made = n.filter("id NOT LIKE '%0'").unionByName(n.filter("id LIKE '%0'")).withColumn("id", F.concat("id", F.lit("_Impl"))).withColumn("annotations", F.array().cast("array<string>"))
    return K.generated_siblings(G.Graph(n.unionByName(made), star.graph(spark, d).edges)).select("node_id")


@query("SELECT 'method:customer/' || o_custkey || '#order' || o_orderkey || '()V' AS node_id FROM {orders} WHERE o_orderkey % 97 = 0 UNION SELECT 'class:customer/' || o_custkey FROM {orders} WHERE o_orderkey % 97 = 0", plain=True)
def ret_inline_constant(spark, d):
    g = star.graph(spark, d)
    constant = F.regexp_extract("id", r"#order(\d+)", 1)
    n = g.nodes.withColumn("attributes", F.when((constant != "") & (F.try_to_number(constant, F.lit("999999999999")).cast("long") % 97 == 0), F.array(F.lit("COMPILE_TIME_CONSTANT"))).otherwise(F.array().cast("array<string>")))
    return K.inline_constants(G.Graph(n, g.edges)).select("node_id").distinct()


@query("SELECT 'class:supplier/' || s_suppkey AS node_id, 'SERVICE_PROVIDER' AS reason FROM {supplier}", plain=True)
def ret_service(spark, d):
    providers = star.table(spark, d, "supplier").selectExpr("'any' AS service", "'supplier.' || s_suppkey AS provider", "'f' AS path", "1 AS line")
    return K.services(star.graph(spark, d), providers).select("node_id", "reason")


@query("SELECT id, kind = 'METHOD' AND NOT synthesized AND name LIKE 'order%7' AND visibility = 'PUBLIC' AS launcher FROM nodes")
def launcher_main(spark, d):
    n = star.nodes(spark, d).withColumns({"name": F.when(F.col("name").rlike("^order.*7$"), "main").otherwise(F.col("name")), "modifiers": F.array(F.lit("STATIC"))})
    return n.select("id", F.coalesce(R.launcher_main(), F.lit(False)).alias("launcher"))


# documents


@query()
def symbol_document(spark, d):
    g, e = star.graph(spark, d), star.evidence(spark, d)
    return Q.symbol_document(g, e, R.reach(g, e), "nation.7", ["static graph"])


@query()
def why_document(spark, d):
    g, e = star.graph(spark, d), star.evidence(spark, d)
    return Q.why_document(g, e, R.reach(g, e), "nation.7")
