"""A graph made of the star-schema tables, so that every operator has queries to run on.

The frames are SQL that Spark and DuckDB both run: {name} stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import Graph, connected, first_nodes
from weftgraph.shared import modified, removed, written

GRAPH_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
TABLES = (*GRAPH_TABLES, "events", "pages")

PARTS = {
    "nodes": """
SELECT 'class:region/' || r_regionkey AS id, r_name AS name, 'INTERFACE' AS kind, r_name AS module, 'src/main/region.kt' AS path,
       CAST(r_regionkey + 1 AS INT) AS line, 'PUBLIC' AS visibility, 'ABSTRACT' AS modifiers, '' AS annotations, '' AS supers, FALSE AS synthesized FROM {region}
UNION ALL
SELECT 'class:nation/' || n_nationkey, n_name, 'CLASS', r_name, 'src/main/java/' || r_name || '/nation.kt', CAST(n_nationkey + 1 AS INT), 'PUBLIC',
       CASE WHEN n_nationkey % 3 = 0 THEN 'ABSTRACT' ELSE '' END, '', 'region/' || r_regionkey, FALSE FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL
SELECT 'class:customer/' || c_custkey, c_name, 'CLASS', n_name, 'src/main/java/' || n_name || '/customer.kt', CAST(c_custkey % 1000 + 1 AS INT),
       CASE WHEN c_custkey % 5 = 0 THEN 'PRIVATE' ELSE 'PUBLIC' END, '', CASE WHEN c_custkey % 97 = 0 THEN 'androidx/annotation/Keep' WHEN c_custkey % 89 = 0 THEN 'javax/inject/Inject' ELSE '' END,
       'nation/' || n_nationkey, c_custkey % 50 = 0 FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL
SELECT 'class:supplier/' || s_suppkey, s_name, 'OBJECT', n_name, 'src/' || CASE WHEN s_suppkey % 4 = 0 THEN 'test' ELSE 'main' END || '/java/' || n_name || '/supplier.kt', CAST(s_suppkey + 1 AS INT), 'PUBLIC', '', '',
       'nation/' || n_nationkey, FALSE FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL
SELECT 'class:part/' || p_partkey, p_name, 'CLASS', p_brand, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 'src/main/' || p_brand || '/part.kt' END, CAST(p_size AS INT), 'PUBLIC', '', '', '', p_size = 1 FROM {part}
UNION ALL
SELECT 'method:customer/' || o_custkey || '#order' || o_orderkey || '()V', 'order' || o_orderkey, 'METHOD', n_name,
       'src/' || CASE WHEN o_orderpriority = '5-LOW' THEN 'test' ELSE 'main' END || '/java/' || n_name || '/order.kt', CAST(o_orderkey % 1000 + 1 AS INT),
       CASE WHEN o_orderkey % 3 = 0 THEN 'PRIVATE' ELSE 'PUBLIC' END, CASE WHEN o_orderkey % 101 = 0 THEN 'NATIVE' ELSE '' END,
       CASE WHEN o_orderkey % 103 = 0 THEN 'org/junit/Test' WHEN o_orderkey % 107 = 0 THEN 'org/junit/Before' ELSE '' END, '', FALSE
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "raw_edges": """
SELECT 'class:region/' || n_regionkey AS source, 'class:nation/' || n_nationkey AS target, 'MEMBER' AS kind, 'BYTECODE' AS origin, CAST(1 AS BIGINT) AS weight, CAST(NULL AS INT) AS line FROM {nation}
UNION ALL SELECT 'class:nation/' || c_nationkey, 'class:customer/' || c_custkey, 'MEMBER', 'BYTECODE', 1, NULL FROM {customer}
UNION ALL SELECT 'class:nation/' || s_nationkey, 'class:supplier/' || s_suppkey, 'MEMBER', 'BYTECODE', 1, NULL FROM {supplier}
UNION ALL SELECT 'class:customer/' || o_custkey, 'method:customer/' || o_custkey || '#order' || o_orderkey || '()V', 'MEMBER', 'BYTECODE', 1, NULL FROM {orders}
UNION ALL SELECT 'method:customer/' || o_custkey || '#order' || o_orderkey || '()V', 'class:customer/' || o_custkey, 'REFERENCE', 'BYTECODE', 1, NULL FROM {orders}
UNION ALL SELECT 'class:nation/' || n_nationkey, 'class:region/' || n_regionkey, 'REFERENCE', 'BYTECODE', 1, NULL FROM {nation}
UNION ALL SELECT 'class:customer/' || c_custkey, 'class:nation/' || c_nationkey, 'INHERITANCE', 'BYTECODE', 1, NULL FROM {customer}
UNION ALL SELECT 'class:supplier/' || s_suppkey, 'class:nation/' || s_nationkey, 'INHERITANCE', 'BYTECODE', 1, NULL FROM {supplier}
UNION ALL SELECT 'method:customer/' || o_custkey || '#order' || o_orderkey || '()V', 'class:part/' || l_partkey, 'CALL', 'BYTECODE', 1, CAST(l_linenumber AS INT) FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
UNION ALL SELECT 'method:customer/' || o_custkey || '#order' || o_orderkey || '()V', 'class:supplier/' || l_suppkey, 'CALL', 'BYTECODE', 1, CAST(l_linenumber AS INT) FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
UNION ALL SELECT DISTINCT 'class:part/' || a.l_partkey, 'class:part/' || b.l_partkey, 'REFERENCE', 'RUNTIME_MODEL', CAST(1 AS BIGINT), CAST(NULL AS INT)
  FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_quantity >= 38 AND b.l_quantity >= 38 AND a.l_partkey <> b.l_partkey
UNION ALL SELECT 'method:customer/' || o_custkey || '#order' || o_orderkey || '()V', 'class:part/' || n.next_part, 'OVERRIDE', 'DISPATCH_MODEL', 1, NULL
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN (SELECT p_partkey, lead(p_partkey) OVER (PARTITION BY p_type ORDER BY p_partkey) AS next_part FROM {part}) n ON n.p_partkey = l_partkey
  WHERE l_quantity >= 49 AND n.next_part IS NOT NULL
UNION ALL SELECT 'class:nation/' || n_nationkey, 'class:nation/' || (n_nationkey + 1), 'OVERRIDE', 'BYTECODE', 1, NULL FROM {nation} WHERE n_nationkey % 4 = 0""",
    "retention": """
SELECT 'class:customer/' || c_custkey AS node_id, 'MANIFEST_COMPONENT' AS reason, 'manifest.xml' AS path, CAST(c_custkey % 100 AS INT) AS line FROM {customer} WHERE c_acctbal > 9500
UNION ALL SELECT 'class:part/' || p_partkey, 'KEEP_RULE', 'rules.pro', 7 FROM {part} WHERE p_type LIKE 'PROMO%' AND p_size > 45
UNION ALL SELECT 'method:customer/' || o_custkey || '#order' || o_orderkey || '()V', 'RUNTIME_ENTRY_POINT', NULL, NULL FROM {orders} WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000
UNION ALL SELECT 'class:customer/' || (c_custkey + 100000000), 'EXTERNAL_BRIDGE', 'bridge.json', 1 FROM {customer} WHERE c_custkey % 211 = 0
UNION ALL SELECT 'method:customer/' || o_custkey || '#order' || o_orderkey || '()V', 'EXTERNAL_BRIDGE', 'bridge.json', 2 FROM {orders} WHERE o_orderkey % 499 = 0
UNION ALL SELECT 'class:supplier/' || s_suppkey, 'UNKNOWN_KEEP_RULE', 'rules.pro', 9 FROM {supplier} WHERE s_suppkey % 17 = 0""",
}
#: Edges that agree are one; what has no node at an end is dropped.
EDGES = """
SELECT source, target, kind, origin, CAST(sum(weight) AS BIGINT) AS weight FROM raw_edges
WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes) GROUP BY source, target, kind, origin"""


def filled(sql: str) -> str:
    return sql.format(**{t: t for t in TABLES})


def with_frames(sql: str, more: dict[str, str] | None = None) -> str:
    """DuckDB SQL with the frames before it, recursive ones allowed."""
    parts = {k: filled(v) for k, v in PARTS.items()} | {"edges": EDGES} | (more or {})
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in parts.items()) + "\n" + sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = PARTS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql})


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "retention")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ",")).alias(c)
    n = frame(spark, sf_dir, "nodes")
    return n.select("id", "name", "kind", "module", "path", "line", "visibility", listed("modifiers"), listed("annotations"), listed("supers"), "synthesized").withColumnRenamed("supers", "supertypes").withColumn("attributes", F.array().cast("array<string>")).withColumn("enum_constants", F.lit(None).cast("array<string>"))


_kept: dict[tuple, DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """The table ``make()``, written once a session for each state of the tables."""
    key = (spark.sparkContext.applicationId, sf_dir, name, tuple(modified(spark, f"{sf_dir}/{t}.parquet") for t in GRAPH_TABLES))
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def vertices(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph for those who read its nodes only: edges are a plan that has not run."""
    n = _once(spark, sf_dir, "nodes", lambda: written(first_nodes(nodes(spark, sf_dir))))
    return Graph(n, frame(spark, sf_dir, "raw_edges"))


#: What three kinds of edges come from.
SALES = "{lineitem} JOIN {orders} ON l_orderkey = o_orderkey"


def kept(spark: SparkSession, sf_dir: str, name: str, lineitem: DataFrame) -> Graph:
    """The canonical graph with the edges of ``lineitem``; all revisions have the same nodes."""
    n = vertices(spark, sf_dir).nodes

    def edges():
        # joined once, and no longer there as shuffle files while edges are merged
        sold = written(lineitem.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "o_custkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))
        sql = PARTS["raw_edges"].replace(SALES, "{sold}")
        tables = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql} | {"lineitem": lineitem, "sold": sold}
        lines = F.when(F.col("line").isNotNull(), F.array("line")).otherwise(F.array().cast("array<int>"))
        out = connected(n, spark.sql(sql, **tables).withColumn("lines", lines))
        removed(sold)
        return out

    return Graph(n, _once(spark, sf_dir, name, edges))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return kept(spark, sf_dir, "now", table(spark, sf_dir, "lineitem"))


def before(spark: SparkSession, sf_dir: str, date: str = "1997-01-01") -> Graph:
    """The graph of the line items shipped before a date: an earlier revision."""
    return kept(spark, sf_dir, date, table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") < F.lit(date).cast("timestamp")))
