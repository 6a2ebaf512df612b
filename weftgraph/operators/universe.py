"""Whether a set of facts is whole: callers that sources were written with, and fields of changed resources.

Both answer with three values.  Each row gets the first fault that holds for it, in one pass over joins;
faults have a severity, and the answer is that of the worst.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import schema as S
from weftgraph.graph import Graph
from weftgraph.iterate import bfs, settled

SCOPE = "module string, path string"
#: ``stamp`` stands for the inputs, collector and compiler that an inventory, or a row of coverage, comes from.
INVENTORIES = "inventory string, module string, projected boolean, stamp string"
SOURCES = "inventory string, path string"
BODIES = "inventory string, body string, path string, kind string, methods array<string>, present boolean, written boolean, start int, end int"
METHODS = "inventory string, id string, body string, code boolean, abstract boolean, origin_known boolean"
OUTPUTS = "inventory string, owner string"
COVERAGE = "method string, path string, start int, end int, stamp string, whole boolean"

#: Kinds of bodies whose calls are known.
CALLING = ("ORDINARY_METHOD", "LOCAL_METHOD", "ANONYMOUS_METHOD")
STATES = ("COMPLETE", "INCOMPLETE", "UNKNOWN")
#: By code: how bad it is, as a place in STATES.
SEVERITY = {
    "SOURCE_TWICE": 2, "SOURCE_MISSING": 2, "OUTPUT_PROJECTED": 2, "BODY_WITHOUT_METHOD": 2, "BODY_KIND": 1, "BODY_CONTRADICTS": 2, "COVERAGE_MISSING": 2, "COVERAGE_PARTIAL": 1,
    "CLASSES_DIFFER": 2, "METHODS_DIFFER": 2, "SOURCES_DIFFER": 2, "ORIGIN_UNKNOWN": 2,
}


@dataclass(frozen=True)
class Universe:
    """``callers`` (id, known): methods of the bodies asked for, and whether their calls are; ``faults`` (code,
    detail, n); one row of ``state`` (status, bodies)."""

    callers: DataFrame
    faults: DataFrame
    state: DataFrame


def authored_universe(g: Graph, scope: DataFrame, kinds: tuple[str, ...], facts: dict[str, DataFrame], whole: bool = False) -> Universe:
    """Callers of the bodies of ``kinds`` in the files of ``scope`` (module, path), from the frames named above
    in ``facts`` (inventories, sources, bodies, methods, outputs, coverage).

    UNKNOWN: a file, a method or its calls are missing, or rows contradict each other; INCOMPLETE: there are
    bodies of which calls are not taken down; COMPLETE: neither.  With ``whole``, classes, methods and files
    of the graph and of the inventories must be the same, each once.
    """
    scope = settled(scope.distinct())
    inventories = settled(facts["inventories"].join(scope.select("module").distinct(), "module", "left_semi"))
    mine = lambda name: facts[name].join(inventories.select("inventory", "module", "stamp"), "inventory")
    sources = settled(mine("sources").select("module", "path"))
    wrong = lambda df, code: df.select(F.lit(code).alias("code"), F.lit(None).cast("string").alias("detail"))
    faults = [
        wrong(sources.groupBy("module", "path").agg(F.count("*").alias("n")).filter("n > 1"), "SOURCE_TWICE"),
        wrong(scope.join(sources, ["module", "path"], "left_anti"), "SOURCE_MISSING"),
        wrong(inventories.filter("projected"), "OUTPUT_PROJECTED"),
    ]
    bodies = mine("bodies").join(scope, ["module", "path"], "left_semi").filter(F.col("kind").isin(*kinds)).withColumn("only", F.when(F.size("methods") == 1, F.get("methods", F.lit(0))))
    methods = facts["methods"].select("inventory", F.col("id").alias("only"), F.col("body").alias("of_body"), "code", "abstract")
    rows = F.struct(F.col("path").alias("c_path"), F.col("start").alias("c_start"), F.col("end").alias("c_end"), F.col("stamp").alias("c_stamp"), "whole")
    coverage = facts["coverage"].groupBy(F.col("method").alias("only")).agg(F.min(rows).alias("c"))
    seen = bodies.join(methods, ["inventory", "only"], "left").join(coverage, "only", "left")
    empty = (F.col("kind") == "ABSTRACT_METHOD") & ~F.col("present") & ~F.col("code") & F.col("abstract") & F.col("start").isNotNull() & F.col("written")
    agrees = (F.col("c.c_path") == F.col("path")) & F.col("c.c_start").eqNullSafe(F.col("start")) & F.col("c.c_end").eqNullSafe(F.col("end")) & (F.col("c.c_stamp") == F.col("stamp"))
    code = F.when(F.col("only").isNull() | ~F.coalesce(F.col("of_body") == F.col("body"), F.lit(False)), "BODY_WITHOUT_METHOD").when(empty, None).when(~F.col("kind").isin(*CALLING), "BODY_KIND")
    code = code.when(~(F.col("present") & F.col("code") & F.col("written")), "BODY_CONTRADICTS").when(~F.coalesce(agrees, F.lit(False)), "COVERAGE_MISSING").when(~F.col("c.whole"), "COVERAGE_PARTIAL")
    judged = settled(seen.select(F.col("only").alias("id"), "kind", code.alias("code")))
    faults.append(judged.filter("code IS NOT NULL").select("code", F.when(F.col("code") == "BODY_KIND", F.col("kind")).alias("detail")))
    if whole:
        inside = g.nodes.filter(~F.coalesce(F.array_contains("attributes", "EXTERNAL_STUB"), F.lit(False)))
        # what only one side has, or the inventories have twice
        differ = lambda a, b: a.withColumn("x", F.lit(1)).withColumn("y", F.lit(0)).unionByName(b.withColumn("x", F.lit(0)).withColumn("y", F.lit(1))).groupBy(*a.columns).agg(F.sum("x").alias("x"), F.sum("y").alias("y")).filter("x <> 1 OR y <> 1")
        classes = inside.filter(F.col("kind").isin(*S.TYPE_KINDS)).select("id")
        callables = inside.filter(F.col("kind").isin("METHOD", "FUNCTION", "CONSTRUCTOR")).select("id")
        faults.append(wrong(differ(classes, mine("outputs").filter("owner IS NOT NULL").select(F.concat(F.lit("class:"), "owner").alias("id"))), "CLASSES_DIFFER"))
        faults.append(wrong(differ(callables, mine("methods").select("id")), "METHODS_DIFFER"))
        kept = facts["sources"].join(facts["inventories"].select("inventory", "module"), "inventory").select("module", "path").distinct()
        faults.append(wrong(differ(scope.select("module", "path"), kept), "SOURCES_DIFFER"))
        faults.append(wrong(mine("methods").filter("NOT origin_known"), "ORIGIN_UNKNOWN"))
    every = faults[0]
    for f in faults[1:]:
        every = every.unionByName(f)
    counted = settled(every.groupBy("code", "detail").agg(F.count("*").alias("n")))
    place = F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))
    worst = F.get(F.array(*map(F.lit, STATES)), F.coalesce(F.max(place[F.col("code")]), F.lit(0)))
    state = counted.agg(worst.alias("status")).crossJoin(judged.agg(F.count("*").alias("bodies")))
    callers = judged.filter("code IS NULL OR code <> 'BODY_WITHOUT_METHOD'").groupBy("id").agg(F.bool_and(F.coalesce(F.col("code").isin("COVERAGE_PARTIAL"), F.lit(True))).alias("known"))
    return Universe(callers, counted, state)


DEFINITIONS = "path string, key string"
INCLUDES = "include string, source string, target string, literal boolean"
FIELDS = "key string, field string"
#: What one request may take in; beyond that it is refused, not cut.
FILES, RESOURCES, DEFINED, INCLUDED = 256, 10_000, 10_000, 20_000
LAYOUT = r"layout(-[A-Za-z0-9+_-]+)?/[a-z_][a-z0-9_]{0,127}\.xml"


def _portable(path):
    """A relative path of a layout file, with none of the parts that only some systems read alike."""
    odd = path.rlike(r"^/|^external/|[\\:\x00-\x1F]|(^|/)(\.{0,2})(/|$)")
    return F.length(path).between(1, 4096) & ~odd & path.rlike(f"(^|/){LAYOUT}$")


@dataclass(frozen=True)
class Resources:
    """``files`` (path, status), ``resources`` (key, depth, field) and ``includes`` (include) behind changed
    layouts, and ``status``: ADMITTED, UNAVAILABLE or REFUSED."""

    status: str
    files: DataFrame
    resources: DataFrame
    includes: DataFrame


def resource_impact(requested: DataFrame, definitions: DataFrame | None, includes: DataFrame | None, roots: list[str], fields: DataFrame | None, limits: tuple[int, int, int, int] = (FILES, RESOURCES, DEFINED, INCLUDED)) -> Resources:
    """Fields that changed layout files (``requested``: path) can affect: the layouts that the files define (key),
    all that include these literally, at any remove, and the field of each (``fields``: key, field, null
    where none can be told).

    Without ``definitions`` or without ``fields`` nothing can be told: UNAVAILABLE.  If the files, or all that
    is found, exceed one of ``limits`` (files, resources, definitions, includes), nothing is given: REFUSED.
    """
    spark = requested.sparkSession
    most_files, most_keys, most_defined, most_links = limits
    files = settled(requested.select("path").distinct())
    none = spark.createDataFrame([], "key string, depth int, field string"), spark.createDataFrame([], "include string")
    if files.count() > most_files:
        return Resources("REFUSED", files.orderBy("path").limit(most_files).withColumn("status", F.lit("BUDGET_EXCEEDED")), *none)
    if definitions is None or fields is None:
        missing = "EVIDENCE_UNAVAILABLE" if definitions is None else "BINDING_UNAVAILABLE"
        return Resources("UNAVAILABLE", files.withColumn("status", F.when(_portable(F.col("path")), missing).otherwise("INVALID_PATH")), *none)
    inside = F.lit(False)
    for r in roots:
        inside = inside | (F.col("path").startswith(r + "/") & F.expr(f"substring(path, {len(r) + 2})").rlike(f"^{LAYOUT}$"))
    matched = files.filter(_portable(F.col("path"))).join(definitions, "path")
    status = F.when(~_portable(F.col("path")), "INVALID_PATH").when(F.col("hit"), "MATCHED").when(inside, "ABSENT").otherwise("OUTSIDE_ROOT")
    told = files.join(matched.select("path").distinct().withColumn("hit", F.lit(True)), "path", "left").select("path", status.alias("status"))
    literal = includes.filter("literal")
    found = settled(bfs(literal.select(F.col("target").alias("source"), F.col("source").alias("target")), matched.select(F.col("key").alias("id"))).withColumnRenamed("id", "key"))
    links = settled(literal.join(found.select(F.col("key").alias("target")), "target", "left_semi").select("include").distinct())
    n_defined = definitions.join(found, "key", "left_semi").count()
    if found.count() > most_keys or n_defined > most_defined or links.count() > most_links:
        return Resources("REFUSED", files.withColumn("status", F.lit("BUDGET_EXCEEDED")), *none)
    return Resources("ADMITTED", told, found.join(fields, "key", "left").select("key", "depth", "field"), links)
