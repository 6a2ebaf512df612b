"""Reachability from evidence, findings and what is new about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import schema as S
from weftgraph.graph import Graph
from weftgraph.iterate import bfs, paths, ranked_bfs

PRIVATE = ("PRIVATE", "PRIVATE_TO_THIS")
# Methods that serialization calls by name.
SERIALIZATION_CALLBACKS = ("readObject", "writeObject", "readObjectNoData", "readResolve", "writeReplace")


def usage(g: Graph) -> DataFrame:
    return g.edges.filter(S.is_usage(F.col("kind"))).select("source", "target").distinct()


def roots(g: Graph, evidence: DataFrame) -> DataFrame:
    return evidence.select(F.col("node_id").alias("id")).distinct().join(g.nodes.select("id"), "id", "left_semi")


def reach(g: Graph, evidence: DataFrame) -> DataFrame:
    """id, depth of what evidence reaches over usages."""
    return bfs(usage(g), roots(g, evidence))


def unreachable(g: Graph, reached: DataFrame) -> DataFrame:
    return g.nodes.join(reached.select("id"), "id", "left_anti")


def unmatched_evidence(g: Graph, evidence: DataFrame) -> DataFrame:
    return evidence.join(g.nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti")


def reach_paths(g: Graph, evidence: DataFrame, ends: DataFrame) -> DataFrame:
    """id, path: a representative path from evidence, by queue order (node, reason, path, line)."""
    order = F.struct("node_id", F.array_position(F.array(*map(F.lit, S.REASONS)), F.col("reason")).alias("r"), F.coalesce("path", F.lit("")).alias("p"), F.coalesce("line", F.lit(0)).alias("l"))
    seeds = evidence.select(F.col("node_id").alias("id"), order.alias("ord")).join(g.nodes.select("id"), "id", "left_semi")
    return paths(ranked_bfs(usage(g), seeds), ends)


def test_only(main: Graph, combined: Graph, evidence: DataFrame) -> DataFrame:
    """Nodes of the main graph that, unreached in it, the combined graph reaches from nodes only it has."""
    only = combined.nodes.select("id").join(main.nodes.select("id"), "id", "left_anti")
    return bfs(usage(combined), only).select("id").join(main.nodes.select("id"), "id", "left_semi").join(reach(main, evidence).select("id"), "id", "left_anti")


def launcher_main():
    return (F.col("kind") == "METHOD") & ~F.coalesce("synthesized", F.lit(False)) & (F.col("name") == "main") & F.array_contains("modifiers", "STATIC") & (F.col("visibility") == "PUBLIC")


def single_owner(g: Graph) -> DataFrame:
    """id, owner of nodes that exactly one MEMBER edge enters."""
    return g.edges.filter("kind = 'MEMBER'").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"), F.min("source").alias("owner")).filter("n = 1").select("id", "owner")


def dead_findings(g: Graph, reached: DataFrame, private_members: bool = False) -> DataFrame:
    """id, path, line of unreached declarations that are reported: types; top-level functions of file
    facades; with ``private_members`` private members of reached types, too."""
    has = lambda a: F.coalesce(F.array_contains("attributes", a), F.lit(False))
    native = F.coalesce(F.array_contains("modifiers", "NATIVE"), F.lit(False))
    nodes = unreachable(g, reached).filter(~F.coalesce("synthesized", F.lit(False)) & ~has("SOURCE_RETENTION_ANNOTATION"))
    owner = single_owner(g).join(g.nodes.select(F.col("id").alias("owner"), F.col("kind").alias("owner_kind"), F.coalesce("synthesized", F.lit(False)).alias("owner_made"), F.coalesce(F.array_contains("attributes", "FILE_FACADE"), F.lit(False)).alias("facade")), "owner")
    owner = owner.join(reached.select(F.col("id").alias("owner"), F.lit(True).alias("owner_reached")), "owner", "left")
    nodes = nodes.join(owner, "id", "left")
    private = F.col("visibility").isin(*PRIVATE)
    called = F.col("name").isin(*SERIALIZATION_CALLBACKS)
    top = F.col("kind").isin("METHOD", "FUNCTION") & F.coalesce("facade", F.lit(False))
    report_top = ~native & ~has("INLINE_FUNCTION") & ~has("PROPERTY_ACCESSOR") & ~has("COMPILE_TIME_CONSTANT") & ~called & ~launcher_main() & (F.lit(private_members) | ~private)
    member = F.lit(private_members) & F.col("kind").isin("METHOD", "FUNCTION", "FIELD", "PROPERTY") & private & ~native & ~has("COMPILE_TIME_CONSTANT") & ~has("INLINE_FUNCTION") & ~called
    member = member & F.col("owner_kind").isin(*S.TYPE_KINDS) & ~F.col("owner_made") & F.coalesce("owner_reached", F.lit(False))
    return nodes.filter(F.when(F.col("kind").isin(*S.TYPE_KINDS), True).when(top, report_top).otherwise(F.coalesce(member, F.lit(False)))).select("id", "path", "line")


def fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", F.concat_ws("|", F.lit("dead"), "id", F.coalesce("path", F.lit(""))))


def finding_delta(findings: DataFrame, baseline: DataFrame, suppressions: DataFrame, today: str) -> DataFrame:
    """Findings with status new, baseline or suppressed; a suppression counts through its last day."""
    f = fingerprint(findings)
    active = suppressions.filter(F.col("expires") >= F.lit(today).cast("date")).select("fingerprint").distinct().withColumn("s", F.lit(True))
    known = baseline.select("fingerprint").distinct().withColumn("b", F.lit(True))
    return f.join(known, "fingerprint", "left").join(active, "fingerprint", "left").select("id", "path", "line", "fingerprint", F.when(F.col("b"), "baseline").when(F.col("s"), "suppressed").otherwise("new").alias("status"))


def finding_confidence(findings: DataFrame, observed: DataFrame | None, channels: DataFrame) -> DataFrame:
    """Findings with confidence: runtime_observed over review (open channels in the file) over static."""
    out = findings.join(channels.select("path", "channels"), "path", "left")
    out = out.join(observed.select("id").distinct().withColumn("o", F.lit(True)), "id", "left") if observed is not None else out.withColumn("o", F.lit(None).cast("boolean"))
    return out.select("id", "path", "line", F.when(F.col("o"), "RUNTIME_OBSERVED").when(F.col("path").isNull(), "UNMEASURED").when(F.coalesce("channels", F.lit(0)) > 0, "REVIEW").otherwise("STATIC").alias("confidence"))
