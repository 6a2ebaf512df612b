"""A graph: named frames, made canonical once."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import schema as S
from weftgraph.shared import removed, written

EDGE_KEY = ("source", "target", "kind", "origin")


@dataclass(frozen=True)
class Graph:
    """``nodes`` and ``edges``, and facts that are not edges by name (external_calls, enclosures, ...)."""

    nodes: DataFrame
    edges: DataFrame
    facts: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame, **facts: DataFrame) -> Graph:
        return canonical(cls(nodes, edges, facts))

    def enriched(self, delta: DataFrame, replacing: str | None = None) -> Graph:
        """With the edges of ``delta``; those of one origin are dropped before."""
        kept = self.edges if replacing is None else self.edges.filter(F.col("origin") != replacing)
        return replace(self, edges=merged(dangling_dropped(kept.unionByName(delta), self.nodes)))

    def without_origin(self, *origins: str) -> Graph:
        return replace(self, edges=self.edges.filter(~F.col("origin").isin(*origins)))


def first_nodes(nodes: DataFrame) -> DataFrame:
    """One row an id: that of the least ``seq`` (if there is such a column).  Copies that disagree on
    kind, module, path or enum constants leave the constants unknown, which is null, not empty."""
    if "seq" not in nodes.columns:
        nodes = nodes.withColumn("seq", F.lit(0))
    cols = [c for c in nodes.columns if c not in ("id", "seq")]
    same = [c for c in ("kind", "module", "path", "enum_constants") if c in cols]
    marks = F.struct(*(F.to_json(F.struct(c)).alias(c) for c in same))
    rows = nodes.groupBy("id").agg(F.min_by(F.struct(*cols), "seq").alias("r"), F.min(marks).alias("lo"), F.max(marks).alias("hi"))
    out = [F.when(F.col("lo") == F.col("hi"), F.col("r.enum_constants")).alias(c) if c == "enum_constants" else F.col(f"r.{c}").alias(c) for c in cols]
    return rows.select("id", *out)


def dangling_dropped(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def merged(edges: DataFrame) -> DataFrame:
    """Edges that agree in source, target, kind and origin are one: weights add up, lines unite."""
    return edges.groupBy(*EDGE_KEY).agg(F.sum(F.col("weight").cast("long")).alias("weight"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("lines", F.array().cast("array<int>")))))).alias("lines"))


#: Ends without a node that a plan names one by one.
FEW = 100


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``merged`` edges without dangling ones, as a table; ``nodes`` is one, too.

    Ends are told once each, and only those without a node meet the edges again, so edges are shuffled once,
    for the merge.  A few such ends are left out wherever the table is read; for more it is written again.
    """
    e = written(merged(edges.filter("source IS NOT NULL AND target IS NOT NULL")))
    ends = e.select(F.col("source").alias("id")).union(e.select("target")).distinct()
    missing = written(ends.join(nodes.select("id"), "id", "left_anti"))
    some = [r.id for r in missing.limit(FEW + 1).collect()]
    if len(some) <= FEW:
        removed(missing)
        return e.filter(~F.col("source").isin(some) & ~F.col("target").isin(some)) if some else e
    out = written(e.join(missing.withColumnRenamed("id", "source"), "source", "left_anti").join(missing.withColumnRenamed("id", "target"), "target", "left_anti").select(*e.columns))
    removed(e)
    removed(missing)
    return out


def edge_errors(edges: DataFrame) -> DataFrame:
    """Edges that break the contract: weights are positive, lines ascend, are of byte-code calls only, and
    are no more than the weight."""
    n, lines = F.size("lines"), F.col("lines")
    bad = (F.col("weight") <= 0) | (F.col("weight") > 2**31 - 1)
    bad = bad | ((n > 0) & ((F.col("kind") != "CALL") | (F.col("origin") != "BYTECODE"))) | (n > F.col("weight"))
    return edges.filter(bad | F.exists(lines, lambda x: (x < 1) | (x > 65535)) | (lines != F.array_sort(F.array_distinct(lines))))


def canonical(g: Graph) -> Graph:
    nodes = first_nodes(g.nodes)
    facts, ids = dict(g.facts), nodes.select("id")
    known = lambda df, c: df.join(ids.withColumnRenamed("id", c), c, "left_semi")
    if "external_calls" in facts:
        stubs = nodes.filter(F.array_contains("attributes", "EXTERNAL_STUB")).select("id")
        calls = known(facts["external_calls"], "caller").withColumn("target", F.concat(F.lit("method:"), "owner", F.lit("#"), "name", "descriptor"))
        inside = ids.join(stubs, "id", "left_anti").withColumnRenamed("id", "target")
        targets = calls.select("caller", "ordinal", F.explode_outer("resolved_targets").alias("id")).join(ids, "id", "left_semi").groupBy("caller", "ordinal").agg(F.array_sort(F.collect_set("id")).alias("resolved"))
        facts["external_calls"] = calls.join(inside, "target", "left_anti").join(targets, ["caller", "ordinal"], "left").withColumn("resolved_targets", F.coalesce("resolved", F.array().cast("array<string>"))).drop("target", "resolved")
    if "enclosures" in facts:
        facts["enclosures"] = known(known(facts["enclosures"].filter("local_class <> enclosing"), "local_class"), "enclosing").distinct()
    return Graph(nodes, merged(dangling_dropped(g.edges, nodes)), facts)


def sort_key() -> list:
    """The order of edges: source, target, place of the kind, name of the origin."""
    return [F.col("source"), F.col("target"), S.ordinal(F.col("kind")), F.col("origin")]


def external_stubs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Minimal nodes for targets that no node has."""
    ids = edges.select(F.col("target").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    return ids.select("id", F.regexp_replace(F.regexp_replace("id", "^[a-z]+:", ""), r"^.*[/#]|[(:].*$", "").alias("name"), F.when(F.col("id").startswith("class:"), "CLASS").when(F.col("id").startswith("field:"), "FIELD").otherwise("METHOD").alias("kind"), F.array(F.lit("EXTERNAL_STUB")).alias("attributes"))


def export_edges(edges: DataFrame) -> DataFrame:
    """What exports show: dispatch candidates under a kind of their own, origins with their weights."""
    kind = F.when(F.col("origin") == "DISPATCH_MODEL", "dispatchCandidate").otherwise(F.col("kind"))
    by_origin = edges.select("source", "target", kind.alias("kind"), "origin", "weight", "lines").groupBy("source", "target", "kind", "origin").agg(F.sum("weight").alias("weight"), F.flatten(F.collect_list("lines")).alias("lines"))
    pairs = F.array_sort(F.collect_list(F.struct("origin", "weight")))
    return by_origin.groupBy("source", "target", "kind").agg(F.sum("weight").alias("weight"), F.array_sort(F.collect_set("origin")).alias("origins"), F.map_from_entries(pairs).alias("origin_weights"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))


def merge_snapshots(members: dict[str, Graph]) -> Graph:
    """Union of graphs, each with its paths below its own root; earlier members win equal ids."""
    nodes = edges = None
    for i, (root, g) in enumerate(members.items()):
        n = g.nodes.withColumn("path", F.when(F.col("path").isNotNull(), F.concat(F.lit(f"{root}/"), "path"))).withColumn("seq", F.lit(i))
        nodes = n if nodes is None else nodes.unionByName(n, allowMissingColumns=True)
        edges = g.edges if edges is None else edges.unionByName(g.edges)
    return Graph.of(nodes, edges)


def call_ordinals(calls: DataFrame) -> DataFrame:
    return calls.withColumn("ordinal", F.row_number().over(Window.partitionBy("caller").orderBy("seq")) - 1)
