"""Further registered queries: callback flows, budgets, binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph import graph as G
from weftgraph.operators import binding as B
from weftgraph.operators import flows as X
from weftgraph.operators import impact as I
from weftgraph.operators import persistence as P
from weftgraph.operators import universe as W
from weftgraph.operators import values as VL
from weftgraph.plans import star
from weftgraph.plans.queries import query

# Callbacks.  Each order gives its lambda to its customer, who hands it on to the nation, and that to the
# region, by argument or capture; on the way it is called, kept in a field, or given to a library.

TAKE = "'method:{0}/' || {1} || '#take(F)V'"
CUSTOMER, NATION, REGION = TAKE.format("customer", "c_custkey"), TAKE.format("nation", "n_nationkey"), TAKE.format("region", "r_regionkey")
RUNS = "'method:java/lang/Runnable#run()V'"
#: method, kind, target, invocation of what is done with the lambdas.
USES = f"""
SELECT {CUSTOMER} AS method, 'DECLARED' AS kind, CAST(NULL AS STRING) AS target, CAST(NULL AS STRING) AS invocation FROM {{customer}} WHERE c_custkey % 11 <> 0
UNION ALL SELECT {CUSTOMER}, 'ARGUMENT', {TAKE.format("nation", "c_nationkey")}, 'STATIC' FROM {{customer}} WHERE c_custkey % 3 <> 1
UNION ALL SELECT {CUSTOMER}, 'RECEIVER', {RUNS}, 'INTERFACE' FROM {{customer}} WHERE c_custkey % 4 = 1
UNION ALL SELECT {CUSTOMER}, 'FIELD', 'field:customer/' || c_custkey || '#kept', NULL FROM {{customer}} WHERE c_custkey % 7 = 0
UNION ALL SELECT {CUSTOMER}, 'ARGUMENT', 'method:ext/Library#keep(F)V', 'STATIC' FROM {{customer}} WHERE c_custkey % 13 = 0
UNION ALL SELECT {NATION}, 'DECLARED', NULL, NULL FROM {{nation}}
UNION ALL SELECT {NATION}, 'RECEIVER', {RUNS}, 'INTERFACE' FROM {{nation}} WHERE n_nationkey % 4 = 0
UNION ALL SELECT {NATION}, 'ARGUMENT', {TAKE.format("region", "n_regionkey")}, 'STATIC' FROM {{nation}} WHERE n_nationkey % 3 = 1
UNION ALL SELECT {NATION}, 'CAPTURE', {TAKE.format("region", "n_regionkey")}, NULL FROM {{nation}} WHERE n_nationkey % 3 = 2
UNION ALL SELECT {NATION}, 'ARGUMENT', {TAKE.format("nation", "((n_nationkey + 5) % 25)")}, 'STATIC' FROM {{nation}} WHERE n_nationkey % 6 = 3
UNION ALL SELECT {REGION}, 'DECLARED', NULL, NULL FROM {{region}}
UNION ALL SELECT {REGION}, 'RECEIVER', {RUNS}, 'INTERFACE' FROM {{region}} WHERE r_regionkey % 2 = 1
UNION ALL SELECT {REGION}, 'RETURN', NULL, NULL FROM {{region}} WHERE r_regionkey = 2
UNION ALL SELECT {REGION}, 'ARGUMENT', {TAKE.format("nation", "r_regionkey")}, 'STATIC' FROM {{region}} WHERE r_regionkey > 2"""
FLOWS = {
    "uses": star.filled(USES),
    "declared": "SELECT DISTINCT method AS m FROM uses WHERE kind = 'DECLARED'",
    "links": "SELECT DISTINCT method AS a, target AS b, kind = 'CAPTURE' AS closure FROM uses WHERE kind IN ('ARGUMENT', 'CAPTURE') AND target NOT LIKE 'method:ext/%' AND method IN (SELECT m FROM declared)",
    "places": "SELECT DISTINCT method AS m FROM uses WHERE (kind = 'RECEIVER' OR target LIKE 'method:ext/%') AND method IN (SELECT m FROM declared)",
    "starts": f"SELECT DISTINCT {CUSTOMER} AS s FROM orders JOIN customer ON c_custkey = o_custkey",
    "walked": "SELECT s, s AS m, 0 AS depth FROM starts UNION SELECT w.s, l.b, w.depth + 1 FROM walked w JOIN links l ON l.a = w.m WHERE w.depth < 9",
    "dist": "SELECT s, m, min(depth) AS depth FROM walked GROUP BY s, m",
    "inside": "SELECT s, m FROM dist WHERE depth <= 8",
    "without": "SELECT s, s AS m FROM starts UNION SELECT w.s, l.b FROM without w JOIN links l ON l.a = w.m AND NOT l.closure JOIN inside i ON i.s = w.s AND i.m = l.b",
    "found": "SELECT i.s, i.m FROM inside i JOIN places p ON p.m = i.m",
    "leads": "SELECT s, m FROM found UNION SELECT d.s, l.a FROM leads d JOIN links l ON l.b = d.m JOIN inside i ON i.s = d.s AND i.m = l.a",
    "why": """SELECT s, 'unanalyzed' AS reason FROM inside WHERE m NOT IN (SELECT m FROM declared)
      UNION SELECT s, 'depth' FROM dist WHERE depth = 9
      UNION SELECT i.s, lower(u.kind) FROM inside i JOIN uses u ON u.method = i.m WHERE u.kind IN ('FIELD', 'RETURN') AND i.m IN (SELECT m FROM declared)
      UNION SELECT s, 'closure' FROM found WHERE (s, m) NOT IN (SELECT s, m FROM without)""",
    "handed": "SELECT DISTINCT i.s FROM inside i JOIN uses u ON u.method = i.m WHERE u.target LIKE 'method:ext/%' AND i.m IN (SELECT m FROM declared)",
    "state": """SELECT s, s IN (SELECT s FROM leads) AS edges, (SELECT string_agg(reason, ',' ORDER BY reason) FROM why w WHERE w.s = t.s) AS reasons, s IN (SELECT s FROM handed) AS handed FROM starts t""",
    "flows": f"""SELECT o_orderkey, s, CASE WHEN edges THEN CASE WHEN reasons IS NULL AND NOT handed AND o_orderkey % 17 <> 0 THEN 'bound' ELSE 'candidate' END WHEN reasons IS NOT NULL THEN 'unresolved' ELSE 'unused' END AS outcome,
      CASE WHEN edges THEN '' ELSE coalesce(reasons, '') END AS reasons FROM orders JOIN customer ON c_custkey = o_custkey JOIN state ON s = {CUSTOMER}""",
}


def recursive(sql: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in FLOWS.items()) + "\n" + sql


def _flows(spark, d):
    t = lambda name: star.table(spark, d, name)
    uses = spark.sql(USES, **{x: t(x) for x in ("customer", "nation", "region")})
    uses = uses.selectExpr("method", "0 AS parameter", "kind", "target", "invocation", "CASE WHEN kind IN ('ARGUMENT', 'CAPTURE') THEN 0 END AS position")
    orders = t("orders").selectExpr("o_orderkey", "'method:order/' || o_orderkey || '#make()V' AS caller", "'method:order/' || o_orderkey || '#make$lambda()V' AS lambda", f"{TAKE.format('customer', 'o_custkey')} AS callee")
    arguments = orders.selectExpr("caller", "lambda", "callee", "'STATIC' AS invocation", "0 AS argument", "'run()V' AS sam")
    methods = orders.select(F.explode(F.array("caller", "lambda")).alias("id")).union(t("customer").selectExpr(CUSTOMER)).union(t("nation").selectExpr(NATION)).union(t("region").selectExpr(REGION))
    full = methods.select("id", F.lit("take").alias("name"), F.lit("METHOD").alias("kind"), F.lit("PUBLIC").alias("visibility"), *(F.array().cast("array<string>").alias(c) for c in ("modifiers", "supertypes")))
    g = G.Graph(full, star.frame(spark, d, "raw_edges").limit(0))  # no edges: only their columns are asked for
    return X.callback_flows(g, arguments, uses, orders.filter("o_orderkey % 17 = 0").select("caller", "lambda"))


def registered(sql: str):
    """Registers a query with SQL over the frames of the callbacks."""
    return query(recursive(sql), plain=True)


@registered("""SELECT m AS source, 'method:order/' || o_orderkey || '#make$lambda()V' AS target, CASE outcome WHEN 'bound' THEN 'BOUND' ELSE 'CANDIDATE' END AS tier FROM flows JOIN leads USING (s)""")
def callback_flows(spark, d):
    return _flows(spark, d)[0]


@registered("""SELECT outcome, NULL AS reason, count(*) AS n FROM flows WHERE outcome <> 'unused' GROUP BY outcome
UNION ALL SELECT outcome, reason, count(*) FROM (SELECT outcome, unnest(string_split(reasons, ',')) AS reason FROM flows WHERE outcome = 'unresolved') GROUP BY ALL""")
def callback_summary(spark, d):
    return X.callback_summary(_flows(spark, d)[1])


# Budgets.

_STEPS = "SELECT CAST(c_custkey % 2 AS INT) AS nth, c_custkey AS id, CAST(1 + c_custkey % 9 + CASE WHEN c_acctbal < 0 THEN 20 ELSE 0 END AS INT) AS steps FROM {customer}"


@query(f"""WITH RECURSIVE items AS (SELECT *, row_number() OVER (ORDER BY nth, id) AS k FROM ({_STEPS})),
fold AS (SELECT CAST(0 AS BIGINT) AS k, CAST(2500 AS BIGINT) AS rest, FALSE AS shown
  UNION ALL SELECT f.k + 1, CASE WHEN i.steps <= f.rest THEN f.rest - i.steps ELSE f.rest END, i.steps <= f.rest FROM fold f JOIN items i ON i.k = f.k + 1)
SELECT nth, id, steps, shown FROM items JOIN fold USING (k)""", plain=True)
def impact_budget(spark, d):
    return I.budgeted(spark.sql(_STEPS, customer=star.table(spark, d, "customer")), 2500, ("nth", "id"))


#: Of a search from some nations' methods: what is looked at, in order, up to the budget of edges.
_LOOKS = """SELECT *, row_number() OVER (ORDER BY a, o, source, target, ko, origin) AS n FROM (
  SELECT e.*, CASE kind WHEN 'CALL' THEN 1 WHEN 'FIELD_ACCESS' THEN 2 WHEN 'REFERENCE' THEN 3 WHEN 'INHERITANCE' THEN 4 WHEN 'OVERRIDE' THEN 5 WHEN 'MEMBER' THEN 6 WHEN 'ANNOTATION' THEN 7 ELSE 8 END AS ko, s.id AS a, x.o
  FROM seeds s, (VALUES (0), (1)) AS x(o), edges e WHERE CASE WHEN x.o = 0 THEN e.target ELSE e.source END = s.id)"""
_SEEDS = "SELECT id FROM nodes WHERE id LIKE 'method:customer/%' AND path LIKE 'src/main/java/NATION_2/%' UNION SELECT id FROM nodes WHERE id LIKE 'method:customer/%' AND path LIKE 'src/main/java/NATION_3/%'"


@query("""SELECT id, CASE WHEN id LIKE 'method:%' THEN NULL ELSE a END AS caller, FALSE AS owner FROM (SELECT id, NULL AS a FROM seeds UNION ALL SELECT target, arg_min(a, n) FROM looks WHERE n <= 700 AND o = 1 AND kind = 'CALL' AND origin = 'BYTECODE' GROUP BY target)
UNION ALL SELECT source, arg_min(a, n), TRUE FROM looks WHERE n <= 700 AND o = 0 AND kind = 'MEMBER' GROUP BY source""", {"seeds": _SEEDS, "looks": _LOOKS})
def binding_uncertainty(spark, d):
    g = star.graph(spark, d)
    adapters = g.nodes.filter("id LIKE 'method:customer/%' AND (path LIKE 'src/main/java/NATION_2/%' OR path LIKE 'src/main/java/NATION_3/%')").select("id")
    u = B.uncertainty(g, adapters, node_budget=1_000_000, edge_budget=700)
    return u.steps.select("id", "caller", F.lit(False).alias("owner")).unionByName(u.owners.select("id", F.col("member").alias("caller"), F.lit(True).alias("owner")))


# Values of reflective calls: groups of ten customers hold classes by name, some of two groups, some unseen.

_GROUPS = """
SELECT 's' || c_custkey AS var, 'STRING' AS kind, 'customer.' || c_custkey AS value FROM {customer}
UNION ALL SELECT 's' || c_custkey, 'STRING', 'gone.' || c_custkey FROM {customer} WHERE c_custkey % 8 = 0"""
_ASSIGNED = """
SELECT 'k' || c_custkey AS source, 'j' || CAST(floor(c_custkey / 10) AS BIGINT) AS target FROM {customer} WHERE c_custkey % 40 <> 39
UNION ALL SELECT 'k' || c_custkey, 'j' || CAST(floor(c_custkey / 10) + 1 AS BIGINT) FROM {customer} WHERE floor(c_custkey / 10) % 7 = 0"""
_HELD = """SELECT a.target AS j, x.value FROM assigned a JOIN (SELECT 'k' || substr(var, 2) AS k, replace(value, '.', '/') AS value FROM named) x ON x.k = a.source GROUP BY ALL"""
VALUES = f"""WITH named AS ({star.filled(_GROUPS)}), assigned AS ({star.filled(_ASSIGNED)}), held AS ({_HELD}),
state AS (SELECT j, count(*) > 16 AS too_many, CAST(substr(j, 2) AS BIGINT) % 11 = 0 AS unseen FROM held GROUP BY j),
calls AS (SELECT 'method:order/' || o_orderkey || '#load()V' AS caller, 'j' || CAST(floor(o_custkey / 10) AS BIGINT) AS j FROM orders),
hits AS (SELECT caller, 'class:' || value AS target FROM calls JOIN state USING (j) JOIN held USING (j) WHERE NOT too_many AND 'class:' || value IN (SELECT 'class:customer/' || c_custkey FROM customer))
"""


def _runtime(spark, d):
    t = lambda name: star.table(spark, d, name)
    customer = t("customer")
    operations = customer.selectExpr("'k' || c_custkey AS target", "'CLASS_OF_NAME' AS op", "'s' || c_custkey AS left", "CAST(NULL AS STRING) AS right")
    opaque = customer.selectExpr("floor(c_custkey / 10) AS j").filter("j % 11 = 0").distinct().selectExpr("'j' || j AS var")
    values = VL.propagate(spark.sql(_GROUPS, customer=customer), opaque, spark.sql(_ASSIGNED, customer=customer), operations)
    calls = t("orders").selectExpr("'method:order/' || o_orderkey || '#load()V' AS caller", "0 AS ordinal", "'CLASS_LOADING' AS operation", "'j' || floor(o_custkey / 10) AS var", "CAST(NULL AS INT) AS arity")
    return VL.runtime_values(star.vertices(spark, d), values, calls, spark.createDataFrame([], "service string, provider string"))


@query(VALUES + "SELECT caller AS source, target, 'REFERENCE' AS kind, 'RUNTIME_MODEL' AS origin, CAST(1 AS BIGINT) AS weight FROM hits", plain=True)
def edge_runtime_values(spark, d):
    return _runtime(spark, d)[0]


@query(VALUES + """SELECT 'CLASS_LOADING' AS operation, CASE WHEN s.j IS NULL OR too_many OR unseen THEN 'unresolved' WHEN caller IN (SELECT caller FROM hits) THEN 'resolved' ELSE 'outside' END AS state, count(*) AS n
FROM calls LEFT JOIN state s USING (j) GROUP BY ALL""", plain=True)
def runtime_value_counts(spark, d):
    return _runtime(spark, d)[1]


# Whole sets: each customer is a source file of its region, each order a body in it, of a kind by priority.

_BODIES = """SELECT o_orderkey, 'i' || c_nationkey AS inventory, n_regionkey, 'c' || o_custkey || '.kt' AS path,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'ORDINARY_METHOD' WHEN '2-HIGH' THEN 'LOCAL_METHOD' WHEN '3-MEDIUM' THEN 'ANONYMOUS_METHOD' WHEN '5-LOW' THEN 'ABSTRACT_METHOD' ELSE 'LAMBDA' END AS kind,
  'method:customer/' || o_custkey || '#order' || o_orderkey || '()V' AS id, CAST(o_orderkey % 1000 AS INT) AS start
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"""
_KINDS = ("ORDINARY_METHOD", "LOCAL_METHOD", "ANONYMOUS_METHOD", "ABSTRACT_METHOD", "LAMBDA")


@query(f"""WITH b AS ({star.filled(_BODIES)}), f AS (SELECT n_regionkey AS scope, kind, CASE WHEN kind = 'ABSTRACT_METHOD' THEN NULL WHEN kind = 'LAMBDA' THEN 'BODY_KIND'
    WHEN n_regionkey = 2 AND o_orderkey % 97 = 0 THEN 'COVERAGE_MISSING' WHEN n_regionkey = 1 AND o_orderkey % 50 = 0 THEN 'COVERAGE_PARTIAL' END AS code FROM b WHERE n_regionkey = 1 OR (n_regionkey IN (0, 2) AND kind <> 'LAMBDA'))
SELECT CAST(scope AS INT) AS scope, code, CASE code WHEN 'BODY_KIND' THEN kind END AS detail, count(*) AS n FROM f WHERE code IS NOT NULL GROUP BY ALL
UNION ALL SELECT 2, 'SOURCE_MISSING', NULL, 1
UNION ALL SELECT scope, 'STATUS', CASE scope WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'INCOMPLETE' ELSE 'UNKNOWN' END, count(*) FROM f GROUP BY scope""", plain=True)
def authored_universe(spark, d):
    t = lambda name: star.table(spark, d, name)
    b = spark.sql(_BODIES, **{x: t(x) for x in ("orders", "customer", "nation")})
    abstract = F.col("kind") == "ABSTRACT_METHOD"
    body = F.concat(F.lit("b"), "o_orderkey").alias("body")
    files = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("'i' || c_nationkey AS inventory", "'r' || n_regionkey AS module", "'c' || c_custkey || '.kt' AS path", "n_regionkey")
    calling = b.filter(F.col("kind").isin(*_KINDS[:3]) & ~((F.col("n_regionkey") == 2) & (F.col("o_orderkey") % 97 == 0)))
    facts = {
        "inventories": t("nation").selectExpr("'i' || n_nationkey AS inventory", "'r' || n_regionkey AS module", "false AS projected", "'s' || n_nationkey AS stamp"),
        "sources": files.select("inventory", "path"),
        "bodies": b.select("inventory", body, "path", "kind", F.array("id").alias("methods"), (~abstract).alias("present"), F.lit(True).alias("written"), "start", (F.col("start") + 5).alias("end")),
        "methods": b.select("inventory", "id", body, (~abstract).alias("code"), abstract.alias("abstract"), F.lit(True).alias("origin_known")),
        "outputs": files.select("inventory", F.lit(None).cast("string").alias("owner")),
        "coverage": calling.select(F.col("id").alias("method"), "path", "start", (F.col("start") + 5).alias("end"), F.expr("'s' || substr(inventory, 2)").alias("stamp"), ((F.col("n_regionkey") != 1) | (F.col("o_orderkey") % 50 != 0)).alias("whole")),
    }
    out = None
    for region, kinds in ((0, _KINDS[:4]), (1, _KINDS), (2, _KINDS[:4])):
        scope = files.filter(F.col("n_regionkey") == region).select("module", "path")
        if region == 2:
            scope = scope.union(spark.createDataFrame([("r2", "gone.kt")], "module string, path string"))
        u = W.authored_universe(star.graph(spark, d), scope, kinds, facts)
        rows = u.faults.unionByName(u.state.select(F.lit("STATUS").alias("code"), F.col("status").alias("detail"), F.col("bodies").alias("n"))).select(F.lit(region).alias("scope"), "code", "detail", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


_PAGE = "'app/res/layout/p' || {0} || '.xml'"
_ASKED = f"SELECT {_PAGE.format('p_partkey')} AS path FROM {{part}} WHERE p_size = 7 UNION SELECT 'app/res/layout/gone' || p_size || '.xml' FROM {{part}} WHERE p_size < 3 UNION SELECT 'lib/res/layout/p1.xml' FROM {{part}} WHERE p_partkey = 1"
#: A part's layout includes that of the part at half its key, every other one by a literal.
_INCLUDES = "SELECT 'x' || p_partkey AS include, 'l' || p_partkey AS source, 'l' || CAST(floor(p_partkey / 2) AS BIGINT) AS target, p_partkey % 4 <> 3 AS literal FROM {part} WHERE p_partkey > 1"


@query(f"""WITH RECURSIVE asked AS ({star.filled(_ASKED)}), inc AS ({star.filled(_INCLUDES)}),
found AS (SELECT 'l' || p_partkey AS key, 0 AS depth FROM part WHERE p_size = 7 UNION SELECT i.source, f.depth + 1 FROM found f JOIN inc i ON i.target = f.key AND i.literal)
SELECT 'field' AS what, f.key AS name, CASE WHEN CAST(substr(f.key, 2) AS BIGINT) % 9 <> 0 THEN 'R.' || f.key END AS value, CAST(min(depth) AS INT) AS depth FROM found f GROUP BY f.key
UNION ALL SELECT 'file', path, CASE WHEN path LIKE 'lib/%' THEN 'OUTSIDE_ROOT' WHEN path LIKE '%/gone%' THEN 'ABSENT' ELSE 'MATCHED' END, NULL FROM asked
UNION ALL SELECT 'include', include, NULL, NULL FROM inc WHERE literal AND target IN (SELECT key FROM found)""", plain=True)
def resource_impact(spark, d):
    part = star.table(spark, d, "part")
    definitions = part.selectExpr(f"{_PAGE.format('p_partkey')} AS path", "'l' || p_partkey AS key")
    fields = part.selectExpr("'l' || p_partkey AS key", "CASE WHEN p_partkey % 9 <> 0 THEN 'R.l' || p_partkey END AS field")
    whole = (1 << 31,) * 4
    r = W.resource_impact(spark.sql(_ASKED, part=part), definitions, spark.sql(_INCLUDES, part=part), ["app/res"], fields, whole)
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    out = r.resources.select(F.lit("field").alias("what"), F.col("key").alias("name"), F.col("field").alias("value"), "depth")
    out = out.unionByName(r.files.select(F.lit("file").alias("what"), F.col("path").alias("name"), F.col("status").alias("value"), none("depth", "int")))
    return out.unionByName(r.includes.select(F.lit("include").alias("what"), F.col("include").alias("name"), none("value", "string"), none("depth", "int")))


# Persistence: nations are repositories below regions; orders call two of their methods, one of which a region has.

_CALLER = "'method:customer/' || o_custkey || '#order' || o_orderkey || '()V'"
_CALLS = f"""SELECT {_CALLER} AS caller, 'nation/' || c_nationkey AS owner, CASE WHEN l_linenumber % 2 = 0 THEN 'find' ELSE 'count' END AS name, '()V' AS descriptor, 'INTERFACE' AS kind, CAST(NULL AS STRING) AS path,
  CASE WHEN l_linenumber <> 6 THEN CAST(l_linenumber AS INT) END AS line, CAST(l_linenumber AS INT) AS ordinal, 'UNRESOLVED' AS resolution, CAST(NULL AS STRING) AS model FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey"""
_SITES = f"""SELECT {_CALLER} AS caller, CAST(2 + 2 * (o_orderkey % 3) AS INT) AS line, 'rel' || (o_orderkey % 2) AS relation FROM {{orders}}
UNION ALL SELECT {_CALLER}, CAST(o_orderkey % 1000 + 1 AS INT), 'rel1' FROM {{orders}} WHERE o_orderkey % 3 = 0"""


@query(f"""WITH calls AS ({star.filled(_CALLS)}), sites AS ({star.filled(_SITES)})
SELECT DISTINCT c.caller, c.owner, c.name, c.ordinal FROM calls c JOIN nation ON c.owner = 'nation/' || n_nationkey
JOIN (SELECT {_CALLER} AS caller, CAST(o_orderkey % 1000 + 1 AS INT) AS at FROM orders) o ON o.caller = c.caller JOIN sites s ON s.caller = c.caller AND s.line = coalesce(c.line, o.at) AND s.relation = 'rel1'
WHERE n_regionkey = 2 AND c.name = 'find'""", plain=True)
def persistence_modeled(spark, d):
    t = lambda name: star.table(spark, d, name)
    n = star.nodes(spark, d).filter("id LIKE 'class:nation/%' OR id LIKE 'class:region/%' OR id LIKE 'method:%'").withColumn("kind", F.when(F.col("id").startswith("class:"), "INTERFACE").otherwise(F.col("kind")))
    count = n.filter("id = 'class:region/2'").withColumns({"id": F.lit("method:region/2#count()V"), "name": F.lit("count"), "kind": F.lit("METHOD")})
    calls = spark.sql(_CALLS, **{x: t(x) for x in ("lineitem", "orders", "customer")}).withColumn("resolved_targets", F.array().cast("array<string>"))
    g = G.Graph(n.unionByName(count), star.graph(spark, d).edges.limit(0), {"external_calls": calls})
    declarations = n.filter("id LIKE 'class:nation/%'").select("path", F.lit("rel1").alias("relation"))
    found = P.persistence_modeled(g, spark.sql(_SITES, orders=t("orders")), declarations, ("region/2",), ())
    return found.select("caller", "owner", "name", "ordinal").distinct()
