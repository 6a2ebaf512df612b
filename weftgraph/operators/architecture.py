"""Units, coupling metrics, cycles and layer rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import schema as S
from weftgraph.graph import Graph
from weftgraph.iterate import settled, strong_components


def usage_edges(g: Graph) -> DataFrame:
    return g.edges.filter(S.is_usage(F.col("kind")))


def dependency_edges(g: Graph) -> DataFrame:
    return g.edges.filter(S.is_dependency(F.col("kind"), F.col("origin")))


def units(g: Graph) -> DataFrame:
    return g.nodes.select("id", S.unit_of(F.col("module"), F.col("id")).alias("unit"))


def unit_graph(g: Graph) -> DataFrame:
    """Dependency edges between units: source, target, kind, origin, weight."""
    u = units(g)
    e = dependency_edges(g).select("source", "target", "kind", "origin", "weight")
    e = e.join(u.select(F.col("id").alias("source"), F.col("unit").alias("s")), "source").join(u.select(F.col("id").alias("target"), F.col("unit").alias("t")), "target")
    return e.filter("s <> t").groupBy(F.col("s").alias("source"), F.col("t").alias("target"), "kind", "origin").agg(F.sum("weight").alias("weight"))


def martin_metrics(g: Graph) -> DataFrame:
    """unit, ca, ce, abstract_types, total_types, instability, abstractness, distance and whether they are defined."""
    pairs = unit_graph(g).select("source", "target").distinct()
    ce = pairs.groupBy(F.col("source").alias("unit")).agg(F.count("*").alias("ce"))
    ca = pairs.groupBy(F.col("target").alias("unit")).agg(F.count("*").alias("ca"))
    written = F.col("kind").isin(*S.TYPE_KINDS) & ~F.coalesce("synthesized", F.lit(False))
    abstract = written & (F.col("kind").isin("INTERFACE", "ANNOTATION_CLASS") | F.array_contains("modifiers", "ABSTRACT"))
    types = g.nodes.select(S.unit_of(F.col("module"), F.col("id")).alias("unit"), written.alias("w"), F.coalesce(abstract, F.lit(False)).alias("a")).groupBy("unit").agg(F.count_if("a").alias("abstract_types"), F.count_if("w").alias("total_types"))
    m = types.join(ca, "unit", "left").join(ce, "unit", "left").fillna(0, ["ca", "ce"])
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    m = m.withColumn("instability", ratio(F.col("ce"), F.col("ca") + F.col("ce"))).withColumn("abstractness", ratio(F.col("abstract_types"), F.col("total_types")))
    return m.select("unit", "ca", "ce", "abstract_types", "total_types", "instability", "abstractness", F.abs(F.col("abstractness") + F.col("instability") - 1).alias("distance"), (F.col("ca") + F.col("ce") > 0).alias("instability_defined"), (F.col("total_types") > 0).alias("abstractness_defined"))


def undefined_distance(metrics: DataFrame, shown: int = 20) -> DataFrame:
    """n and the first units whose distance is a placeholder."""
    bad = metrics.filter(~(F.col("instability_defined") & F.col("abstractness_defined")))
    return bad.agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_list("unit")), 1, shown), ",").alias("units"))


def weakest_edges(edges: DataFrame) -> DataFrame:
    """Of parallel edges the lightest; of equal ones the first by kind, then origin."""
    order = F.struct("weight", S.ordinal(F.col("kind")).alias("k"), "origin", "kind")
    return edges.groupBy("source", "target").agg(F.min(order).alias("m")).select("source", "target", "m.kind", "m.origin", "m.weight")


def cycle_members(edges: DataFrame) -> DataFrame:
    return strong_components(edges)


def cycles(edges: DataFrame) -> DataFrame:
    """component, length, path of one shortest cycle through the least id of each strong component."""
    members = settled(strong_components(edges))
    e = edges.select("source", "target").distinct().join(members.select(F.col("id").alias("source"), F.col("component").alias("a")), "source").join(members.select(F.col("id").alias("target"), F.col("component").alias("b")), "target").filter("a = b").select(F.col("a").alias("component"), "source", "target")
    e = settled(e)
    # breadth first from all starts at once: of each vertex the first path, by sources in queue order
    front = e.filter("source = component").groupBy("component", F.col("target").alias("at")).agg(F.min("source").alias("s")).select("component", "at", F.array("component", "at").alias("path"))
    seen, done = front.select("component", "at"), None
    front = settled(front)
    while True:
        closed = front.filter("at = component")
        done = closed if done is None else done.unionByName(closed)
        done = settled(done)
        front = front.join(done.select("component"), "component", "left_anti")
        new = front.join(e.withColumnRenamed("source", "at"), ["component", "at"]).select("component", F.col("target").alias("at"), F.concat("path", F.array("target")).alias("path"))
        new = new.groupBy("component", "at").agg(F.min("path").alias("path"))
        front = settled(new.join(seen, ["component", "at"], "left_anti"))
        if front.isEmpty():
            return done.select("component", (F.size("path") - 1).alias("length"), "path")
        seen = settled(seen.unionByName(front.select("component", "at")))


def glob_regex(glob: str) -> str:
    """Layer pattern: * is any run, ? one character; the whole value has to match."""
    special = set(".^$+{}[]|()\\")
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in special else c for c in glob) + "$"


def layer_assign(g: Graph, layers: list[tuple[str, list[str]]]) -> DataFrame:
    """id, layer: the first layer, of it the first pattern, that one of name, module, unit, path matches.

    The rules come from a file that a person writes; they travel in the plan.
    """
    values = F.array_compact(F.array("name", "module", S.unit_of(F.col("module"), F.col("id")), "path"))
    layer = F.lit(None).cast("string")
    for name, patterns in reversed(layers):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | _any(values, glob_regex(p))
        layer = F.when(hit, name).otherwise(layer)
    return g.nodes.select("id", layer.alias("layer"))


def _any(values, pattern: str):
    return F.exists(values, lambda v: v.rlike(pattern))


def layer_violations(g: Graph, layers: list[tuple[str, list[str]]], rules: list[dict]) -> DataFrame:
    """rule, source, target, kind, source_layer, target_layer of dependency edges that a rule forbids.

    A rule has ``from`` and one of ``allow`` or ``deny``; it concerns edges into other layers.
    """
    of = layer_assign(g, layers).filter("layer IS NOT NULL")
    e = dependency_edges(g).select("source", "target", "kind", "origin")
    e = e.join(of.select(F.col("id").alias("source"), F.col("layer").alias("source_layer")), "source").join(of.select(F.col("id").alias("target"), F.col("layer").alias("target_layer")), "target").filter("source_layer <> target_layer")
    rows = [(r.get("name") or r["from"], r["from"], r.get("allow"), r.get("deny")) for r in rules]
    if any((a is None) == (d is None) for _, _, a, d in rows):
        raise ValueError("a rule has either allow or deny")
    table = g.nodes.sparkSession.createDataFrame(rows, "rule string, source_layer string, allow array<string>, deny array<string>")
    bad = F.coalesce(F.array_contains("deny", F.col("target_layer")), ~F.array_contains("allow", F.col("target_layer")))
    return e.join(table, "source_layer").filter(bad).select("rule", "source", "target", "kind", "origin", "source_layer", "target_layer")


def layer_unassigned(g: Graph, layers: list[tuple[str, list[str]]]) -> DataFrame:
    return layer_assign(g, layers).filter("layer IS NULL").select("id")
